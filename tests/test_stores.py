"""Tables on disk: what is read, what is written, and what a reader sees; kept filters and edges, runs, and enrichment."""

import gzip
import math
import random
import zipfile
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quillon.model import keyed
from quillon.operators import aggregate, filters, graph, joins
from quillon.operators.enrichment import adjusted, enrichment, hypergeometric_tail
from quillon.operators.knowledge import KnowledgeBase, open_knowledge
from quillon.sources import blocks, clustered, store, text
from quillon.sources.clustered import IntervalIndex
from quillon.sources.keyed_store import Conflict, KeyedStore, shard_of
from quillon.streaming import tables as streams

RULER = [("a", 3, 8), ("b", 1, 6), ("c", 4, 10), ("d", 2, 5), ("e", 4, 9), ("f", 13, 15), ("g", 9, 12)]


def test_interval_index_of_the_ruler(spark, tmp_path):
    index = IntervalIndex.save(spark.createDataFrame([*RULER, ("bad", 9, 2), ("open", 3, None)], "key string, start long, end long"), str(tmp_path / "i"), files=3)
    keys = lambda *at: {r.key for r in index.query(*at).collect()}
    assert [keys(0), keys(1), keys(3), keys(3, 4), keys(7), keys(20, 100)] == [set(), {"b"}, {"a", "b", "d"}, {"a", "b", "c", "d", "e"}, {"a", "c", "e"}, set()]
    assert index.size() == 7
    assert IntervalIndex.save(spark.createDataFrame([], "key string, start long, end long"), str(tmp_path / "none")).query(1).count() == 0


def test_interval_index_reads_few_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(n, s, s + rng.randrange(20)) for n in range(4000) for s in [rng.randrange(100_000)]] + [(9000, 10, 50_000)] + [(n, 70_000, 70_001) for n in range(10_000, 13_000)]
    index = IntervalIndex.save(spark.createDataFrame(rows, "key long, start long, end long"), str(tmp_path / "i"), files=16)
    total = len(clustered.files(spark, index.path, F.lit(True)))
    for start, end in ((60_000, 60_100), (49_990, 49_990), (0, 5), (70_000, 70_000), (99_000, 200_000)):
        assert {r.key for r in index.query(start, end).collect()} == {k for k, s, e in rows if s <= end and e >= start}
        assert set(index.query(start, end).inputFiles()) == {f"file://{index.path}/rows/{f}" for f in index.files(start, end)}
    assert total >= 12 and len(index.files(60_000, 60_100)) <= 2 and len(index.files(49_990)) <= 3  # the long interval's file, and that of the place
    asked = [(60_000, 60_100), (5, 30), (70_001, 70_001)]
    got = {(r.key, r.q_start) for r in index.query_all(asked).collect()}
    assert got == {(k, a) for k, s, e in rows for a, b in asked if s <= b and e >= a}


def people(spark, names, extra="x"):
    return keyed(spark.createDataFrame([(n, f"{extra}{n}") for n in names], "name string, value string"), "name")


def content(t):
    return {r.name: r.value for r in t.public().collect()}


def test_store_writes_only_the_shards_of_a_batch(spark, tmp_path):
    names = [f"n{i}" for i in range(40)]
    kept = KeyedStore.create(people(spark, names), str(tmp_path / "s"), shards=8)
    with pytest.raises(Conflict):
        KeyedStore.create(people(spark, names), str(tmp_path / "s"))
    before = kept.manifest()
    assert kept.put(people(spark, ["n3", "more"], "y")) == 1
    after = kept.manifest()
    shards = {str(r[0]) for r in spark.createDataFrame([("n3",), ("more",)], "k string").select(shard_of(F.col("k"), 8)).collect()}
    assert {s for s, f in after["folders"].items() if before["folders"].get(s) != f} == shards
    assert content(kept.read()) == {n: f"x{n}" for n in names} | {"n3": "yn3", "more": "ymore"} and content(kept.read(0)) == {n: f"x{n}" for n in names}
    assert content(kept.get(["n3", "n4", "nobody"])) == {"n3": "yn3", "n4": "xn4"}
    assert len({f.split("shard=")[1].split("/")[0] for f in kept.get(["n3"]).df.inputFiles()}) == 1
    kept.delete(["n3", "nobody"])
    kept.delete(spark.createDataFrame([("n5",)], "k string"))
    assert set(content(kept.read())) == {*names, "more"} - {"n3", "n5"} and kept.delete([]) == 3
    assert kept.put(people(spark, [])) == 3  # nothing to write, no version
    kept.delete([*names, "more"])
    assert content(kept.read()) == {} == content(kept.get(["n1"])) and kept.manifest()["folders"] == {}


def test_a_failed_or_second_writer_leaves_no_trace(spark, tmp_path, monkeypatch):
    kept = KeyedStore.create(people(spark, ["a", "b"]), str(tmp_path / "s"), shards=4)
    commit = KeyedStore._commit
    monkeypatch.setattr(KeyedStore, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        kept.put(people(spark, ["a"], "lost "))
    monkeypatch.setattr(KeyedStore, "_commit", commit)
    assert content(kept.read()) == {"a": "xa", "b": "xb"} and kept.versions() == [0]

    def slow(self, manifest):  # another writer is faster
        monkeypatch.setattr(KeyedStore, "_commit", commit)
        KeyedStore(spark, kept.path).put(people(spark, ["b"], "first "))
        commit(self, manifest)

    monkeypatch.setattr(KeyedStore, "_commit", slow)
    with pytest.raises(Conflict):
        kept.put(people(spark, ["b"], "second "))
    assert content(kept.read()) == {"a": "xa", "b": "first b"}
    (tmp_path / "s" / "versions" / "00000002.json").write_text('{"version": 2, "fol')  # being written
    assert content(kept.read()) == {"a": "xa", "b": "first b"}
    (tmp_path / "s" / "versions" / "00000002.json").unlink()
    assert len(kept.vacuum()) >= 2 and content(kept.read()) == {"a": "xa", "b": "first b"} and kept.versions() == [1]


def test_store_merges_lists(spark, tmp_path):
    t = lambda rows: keyed(spark.createDataFrame(rows, "k string, v array<string>"), "k", shape="double")
    kept = KeyedStore.create(t([("a", ["1"]), ("b", ["2"])]), str(tmp_path / "s"), shards=4)
    kept.merge(t([("a", ["3", "4"]), ("c", []), (None, ["lost"])]))
    assert {r.k: r.v for r in kept.read().public().collect()} == {"a": ["1", "3", "4"], "b": ["2"], "c": []}
    with pytest.raises(ValueError):
        kept.put(people(spark, ["a"]))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_runs_over_the_borders_of_parts(spark, parts):
    rng = random.Random(parts)
    keys = [k for _ in range(30) for k in [rng.choice(["a", "b", None])] for _ in range(rng.choice([1, 1, 2, 15]))]
    df = spark.createDataFrame([(k, str(i), i) for i, k in enumerate(keys)], "k string, v string, i long").repartition(parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = aggregate.collapse_runs(keyed(df, "k", ["v"], "list", "i")).df.orderBy("_ord").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = [(k, "|".join(str(i) for i, _ in run)) for k, run in ((k, list(g)) for k, g in groupby(enumerate(keys), key=lambda x: x[1]))]
    assert [(r.k, r.v) for r in got] == want
    assert aggregate.collapse_runs(keyed(df.limit(0), "k", ["v"], "list", "i")).df.count() == 0


def test_stored_paste_takes_no_shuffle(spark, tmp_path):
    rng, names, tables = random.Random(2), [], []
    for n in range(3):
        df = spark.createDataFrame([(str(k), f"{n}-{k}") for k in rng.sample(range(50), 30)], "k string, v string")
        names.append(f"stored_paste_{n}")
        tables.append(keyed(df, "k", shape="list"))
        store.save_bucketed(tables[-1], names[-1], 4, str(tmp_path / str(n)))
    found = joins.paste_stored(spark, names, "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 6
    want = joins.paste(tables)
    assert {tuple(x or "" for x in r) for r in found.collect()} == {tuple(x or "" for x in r) for r in want.public().collect()} and found.columns == ["k", "v", "v (1)", "v (2)"]
    for name in names:
        spark.sql(f"drop table {name}")


def test_kept_filters_equal_those_made_anew(spark, tmp_path):
    rows = [(f"k{i % 40}", "RED" if i % 3 == 0 else "BLUE", str(i % 7)) for i in range(120)]
    parts = [spark.createDataFrame(rows[i : i + 30], "k string, colour string, digit string") for i in range(0, 120, 30)]
    stack = filters.FilterStack(keyed(parts[0], "k"), str(tmp_path / "f")).add("colour", "RED").add("digit", "4")
    stack.append(parts[1], 1)
    stack.append(parts[2], 2)
    stack.append(parts[1], 1)  # again
    again = filters.FilterStack(keyed(parts[0], "k"), str(tmp_path / "f")).add("colour", "RED").add("digit", "4")
    again.append(parts[3], 3)
    now = keyed(spark.createDataFrame(rows, "k string, colour string, digit string"), "k")
    fresh = filters.FilterStack(now, str(tmp_path / "g")).add("colour", "RED").add("digit", "4")
    want = sorted(map(tuple, fresh.result().public().collect()))
    assert sorted(map(tuple, stack.result(now).public().collect())) == want == sorted(map(tuple, again.result(now).public().collect())) and want


def test_filters_kept_by_a_stream(spark, tmp_path):
    schema = "k string, colour string"
    for n in range(3):
        spark.createDataFrame([(f"{n}-{i}", "RED" if i % 2 else "BLUE") for i in range(10)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))
    empty = keyed(spark.createDataFrame([], schema), "k")
    stack = filters.FilterStack(empty, str(tmp_path / "f")).add("colour", "RED")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
        streams.maintain(stream, str(tmp_path / "rows"), [stack], str(tmp_path / "state")).awaitTermination()
    now = empty.with_df(spark.read.schema(schema).parquet(str(tmp_path / "rows")).withColumn("_ord", F.lit(0)))
    assert {r.k for r in stack.result(now).df.collect()} == {f"{n}-{i}" for n in range(3) for i in range(10) if i % 2}


def test_edges_kept_by_both_ends(spark, tmp_path):
    rng = random.Random(1)
    pairs = sorted({(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(3000)})
    e = spark.createDataFrame([(a, b, a + b) for a, b in pairs], "source string, target string, info string")
    kept = graph.EdgeStore.save(e, str(tmp_path / "e"), files=12)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for ask in (["007"], ["100", "250"]):
        assert rows(kept.children(ask)) == rows(graph.children(e, ask)) and rows(kept.parents(ask)) == rows(graph.parents(e, ask))
        assert rows(kept.neighbours(ask)) == rows(graph.neighbours(e, ask))
    wanted = spark.createDataFrame([("007",), ("008",)], "e string")
    assert rows(kept.children(wanted)) == rows(graph.children(e, wanted))
    read = kept.parents("007").inputFiles()
    assert len(read) <= 2 and all("by-target" in f for f in read) and len(kept.children("007").inputFiles()) <= 2 and kept.children(["~"]).count() == 0

    both = graph.undirected_closure(e.select("source", "target"))
    once = graph.EdgeStore.save(e.select("source", "target"), str(tmp_path / "u"), undirected=True, files=12)
    assert clustered.read(spark, f"{once.path}/by-source").count() == len({tuple(sorted(p)) for p in pairs})
    assert rows(once.children(["007"])) == rows(graph.children(both, ["007"])) and rows(graph.EdgeStore(spark, once.path).parents(["100"])) == rows(graph.parents(both, ["100"]))
    kb = KnowledgeBase(spark)
    kb.register("r", keyed(e.select("source", "target", "info"), "source", shape="list"), source="source", target="target")
    want = rows(kb.neighbours("r", ["007"]))
    kb.keep_edges("r", str(tmp_path / "kb"))
    assert rows(kb.neighbours("r", ["007"])) == want and kb.keep_edges("r", str(tmp_path / "kb")).undirected is False


def test_tail_and_false_discovery_rate(spark):
    rng = random.Random(6)
    cases = [(h, m, d, t) for t in (1, 5, 40, 900) for m in {0, 1, t // 3, t} for d in {0, 1, t // 2, t} for h in range(min(m, d) + 1)]
    cases = rng.sample(cases, min(len(cases), 400))
    exact = lambda h, m, d, t: sum(math.comb(m, i) * math.comb(t - m, d - i) for i in range(h, min(m, d) + 1) if d - i >= 0) / math.comb(t, d)
    df = spark.createDataFrame(cases, "h long, m long, d long, t long")
    for r in df.withColumn("p", hypergeometric_tail(*map(F.col, "hmdt"))).collect():
        want = exact(r.h, r.m, r.d, r.t)
        assert abs(r.p - want) <= 1e-9 * max(want, 1e-30) + 1e-15
    ps = [(i, rng.choice([0.001, 0.02, 0.5, rng.random(), 1.0])) for i in range(9000)]
    order, low, want = sorted(ps, key=lambda x: (x[1], x[0])), 1.0, {}
    for rank in range(len(ps), 0, -1):
        low = min(low, order[rank - 1][1] * len(ps) / rank)
        want[order[rank - 1][0]] = low
    got = {r.i: r.adjusted for r in adjusted(spark.createDataFrame(ps, "i long, p double"), "p", "i").collect()}
    assert all(abs(got[i] - w) < 1e-12 for i, w in want.items())


def test_enrichment_of_a_list(spark):
    edges = spark.createDataFrame([(f"s{i}", f"t{i % 3}") for i in range(12)] + [("s0", "t1"), ("s0", "t1")], "source string, target string")
    got = {r.target: (r.n, r.hits) for r in enrichment(edges, spark.createDataFrame([("s0",), ("s3",), ("s0",), ("nobody",)], "e string")).collect()}
    assert got == {"t0": (4, 2), "t1": (5, 1), "t2": (4, 0)}
    assert enrichment(edges.limit(0), edges.select("source")).count() == 0


def test_lines_over_the_borders_of_blocks(spark, tmp_path):
    rng = random.Random(9)
    for n, lines in enumerate(([f"line {i} " + "x" * rng.choice([0, 1, 30, 400]) for i in range(300)], [""] * 50, ["y" * 5000] * 3 + ["", "z"], [], ["Ünï" * 7] * 40)):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, i int").coalesce(1).sortWithinPartitions("i")
        file, = blocks.write_lines(df, f"file://{tmp_path}/{n}", in_block=64)
        plain = gzip.decompress((tmp_path / str(n) / file.rsplit("/", 1)[1]).read_bytes()).decode()
        assert plain == "".join(v + "\n" for v in lines)  # any gzip reader can read it
        for split in (37, 100, 1009, 1 << 20):
            parts = blocks.BlockReader({"path": file, "splitBytes": str(split)}).partitions()
            got = [line for p in parts for line in blocks._lines(p)]
            assert [v for v, _ in got] == lines and [p for _, p in got] == sorted({p for _, p in got})
        spark.dataSource.register(blocks.BlockLines)
        read = spark.read.format("block_lines").option("splitBytes", 500).load(file)
        assert [r.value for r in read.orderBy("place").collect()] == lines
    bad = tmp_path / "bad.bgz"
    bad.write_bytes(blocks.block(b"a\nb") + blocks.block(b"c\nd\r\n")[:-3])
    with pytest.raises(ValueError):
        list(blocks._lines(blocks.Part(f"file://{bad}", 0, 1 << 20)))


def test_tables_in_archives_and_blocks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.tsv", "#: :type=:list\n#ID\tV\na\t1\nb\t2")  # no line end at the end of a member
        z.writestr("folder/", "")
        z.writestr("folder/b.tsv", "c\t3\r\n")
    t = text.read_tsv(spark, f"{tmp_path}/t.zip", shape="list")
    assert t.key == "ID" and sorted(map(tuple, t.public().collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    body = "".join(f"k{i}\t{i}\n" for i in range(500))
    (tmp_path / "t.bgz").write_bytes(blocks.block(b"#ID\tV\n") + blocks.block(body.encode()) + blocks.LAST)
    t = text.read_tsv(spark, f"{tmp_path}/t.bgz", shape="list")
    assert {r.ID: r.V for r in t.public().collect()} == {f"k{i}": str(i) for i in range(500)}
    assert [r.V for r in t.df.orderBy("_ord").limit(3).collect()] == ["0", "1", "2"]


def test_rules_over_several_knowledge_bases(spark, tmp_path):
    def base(name, pairs, **relations):
        kb = KnowledgeBase(spark, name, entity_options={"b": {"format": name}})
        for relation, rows in {"knows": pairs, **relations}.items():
            kb.register(relation, keyed(spark.createDataFrame(rows, "a string, b string, since string"), "a", shape="list"), source="a", target="b")
        return kb

    kb = base("mine", [("x", "y", "1")])
    base("one", [("x", "z", "1"), ("y", "z", "2")], likes=[("z", "x", "1")]).save(str(tmp_path / "one"))
    kb.include("one", open_knowledge(spark, str(tmp_path / "one")))
    kb.include("two", base("two", [("z", "x", "2")]))
    paths = lambda rules: sorted(tuple(r[c] for c in sorted(r.asDict())) for r in kb.traverse(rules).paths.collect())
    assert paths("?a knows@one ?b") == [("x", "z"), ("y", "z")]
    assert paths("?a knows@?kb ?b") == [("x", "z", "one"), ("y", "z", "one"), ("z", "x", "two")]
    assert paths("z ?r@?kb ?b") == [("x", "one", "likes"), ("x", "two", "knows")]
    assert paths("?a knows ?b\n?b knows@?kb ?c\n?c ?r@?kb ?a") == [("x", "y", "z", "one", "likes")]
    assert paths("?a knows@?kb ?b - since=2") == [("y", "z", "one"), ("z", "x", "two")]
    assert kb.others["one"].entity_options == {"b": {"format": "one"}}
    e = kb.others["one"].typed_edges("knows")
    assert e.schema["target"].metadata == {"entity": "b", "namespace": "one", "format": "one"} and e.schema["source"].metadata == {"entity": "a", "namespace": "one"}
    for wrong in ("?a hates@one ?b", "?a knows@nobody ?b", "?a knows@one ?b - height=1"):
        with pytest.raises(KeyError):
            kb.traverse(wrong)
