"""Structured Streaming forms of the row-wise operators, and windows over event time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import split_cell
from ..model import KeyedTable, quoted
from ..operators.filters import FilterStack
from ..sources.store import exists
from ..sources.text import split_row


def stream_lines(spark: SparkSession, folder: str, names: Sequence[str], sep: str = "\t", sep2: str | None = None) -> DataFrame:
    """New files of a folder as rows of named cells; lists if sep2 is given."""
    cells = split_row(F.col("value"), sep)
    lines = spark.readStream.text(folder).filter(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    cell = lambda i: F.get(cells, F.lit(i))
    return lines.select(cell(0).alias(names[0]), *[(split_cell(cell(i), sep2) if sep2 else cell(i)).alias(n) for i, n in enumerate(names) if i])


def attach_static(stream: DataFrame, key: str, other: KeyedTable) -> DataFrame:
    """A stream with the fields of a static table."""
    right = other.public().withColumnRenamed(other.key, "__k")
    return stream.join(right, quoted(key) == F.col("__k"), "left").drop("__k")


def merge_running(stream: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Lists by key over an unbounded stream; for output mode "complete" or "update"."""
    return stream.groupBy(quoted(key)).agg(*[F.array_sort(F.collect_list(quoted(f))).alias(f) for f in fields])


def windowed(events: DataFrame, time: str, length: str, keys: Sequence[str], *aggregates: Column, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; works alike on batches and, with late, on streams."""
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.window(time, length, slide) if slide else F.window(time, length), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def sessions(events: DataFrame, time: str, gap: str, keys: Sequence[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in out.columns if c != "session_window"])


def concat_streams(streams: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Rows of all streams under the same names."""
    return reduce(DataFrame.unionByName, [s.toDF(*names) for s in streams])


def paste_streams(left: DataFrame, right: DataFrame, key: str, time: str, within: str, late: str) -> DataFrame:
    """Rows of two streams with equal keys whose times are within a span; a left row that meets none comes once with nulls,
    when the watermark has passed. The right stream's columns must have other names but for key and time."""
    a = left.withWatermark(time, late).alias("a")
    b = right.withWatermark(time, late).withColumnsRenamed({key: "__k", time: "__t"}).alias("b")
    met = (quoted(key) == F.col("__k")) & F.col("__t").between(quoted(time) - F.expr(f"interval {within}"), quoted(time) + F.expr(f"interval {within}"))
    return a.join(b, met, "left").drop("__k", "__t")


def collapse_stream(stream: DataFrame, key: str, fields: Sequence[str], sep: str = "|") -> DataFrame:
    """Rows of a key as one row of joined texts, in order of the texts; for output mode "complete" or "update"."""
    lists = merge_running(stream, key, fields)
    return lists.select(quoted(key), *[F.array_join(quoted(f), sep, "").alias(f) for f in fields])


def maintain(stream: DataFrame, path: str, stacks: Sequence[FilterStack], checkpoint: str):
    """Append a stream's rows to the table at path, a folder a batch, and keep saved filters over it up to date. A batch that comes again
    changes nothing. A started query, for all that is there now."""

    def take(batch: DataFrame, number: int) -> None:
        if not exists(batch.sparkSession, f"{path}/batch={number}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for stack in stacks:
            stack.append(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number}"), number + 1)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
