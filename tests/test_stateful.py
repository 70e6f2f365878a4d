"""Streams whose state ends: what comes out, when, and what is forgotten."""

import datetime

from quillon.model import keyed
from quillon.sources.keyed_store import KeyedStore
from quillon.streaming import stateful

START = datetime.datetime(2024, 1, 1)


def stream(spark, folder, batches, schema, fields):
    """Batches of (key, minutes, fields…) as files that come one at a time."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(k, START + datetime.timedelta(minutes=m), *rest) for k, m, *rest in rows], schema)
        df.coalesce(1).write.parquet(f"{folder}/b={n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b=*").select("k", "at", *fields)


def test_paste_of_streams(spark, tmp_path):
    a = stream(spark, tmp_path / "a", [[("x", 0, "a1"), ("y", 1, "a2"), ("x", 2, "a3"), (None, 3, "lost")], [("z", 100, "a4")], [("y", 1, "too late"), ("end", 900, "")], [("x", 500, "again, but late"), ("last", 2000, "")]], "k string, at timestamp, a string", ["a"])
    b = stream(spark, tmp_path / "b", [[("y", 1, 5, None)], [("w", 101, 6, "c")], [], []], "k string, at timestamp, b int, c string", ["b", "c"])
    d = stream(spark, tmp_path / "d", [[("x", 2, "d1")], [("x", 2, "d0")], [], []], "k string, at timestamp, d string", ["d"])
    out = stateful.paste_all([a, b, d], "k", "at", "10 minutes")
    assert out.columns == ["k", "a", "b", "c", "d"]
    path = str(tmp_path / "out")
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start(path).awaitTermination()
    got = {r.k: tuple(r)[1:] for r in spark.read.parquet(path).collect()}
    assert got == {"x": ("a3", None, None, "d1"), "y": ("a2", "5", None, None), "z": ("a4", None, None, None), "w": (None, "6", "c", None), "end": ("", None, None, None)}


def test_running_lists_write_only_what_changed_and_end(spark, tmp_path):
    batches = [[("x", 1, "p", None), ("x", 0, "q", "1"), ("y", 2, "r", "2")], [("y", 3, "s", "3")], [("z", 500, "t", "4")], [("z", 501, "u", "5")], [("x", 502, "v", "6")]]
    rows = stream(spark, tmp_path / "in", batches, "k string, at timestamp, v string, w string", ["v", "w"])
    out = stateful.collapse_running(rows, "k", "at", ["v", "w"], "1 minute", 60 * 60 * 1000)
    kept = KeyedStore.create(keyed(spark.createDataFrame([], "k string, v string, w string"), "k"), str(tmp_path / "store"), shards=4)
    seen = []

    def write(batch, number):
        seen.append({r.k: (r.v, r.w) for r in batch.collect()})
        kept.put(keyed(batch, "k"))

    out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [b for b in seen if b] == [{"x": ("q|p", "1|"), "y": ("r", "2")}, {"y": ("r|s", "2|3")}, {"z": ("t", "4")}, {"z": ("t|u", "4|5")}, {"x": ("v", "6")}]  # x was closed
    assert {r.k: r.v for r in kept.read().df.select("k", "v").collect()} == {"x": "v", "y": "r|s", "z": "t|u"}
