"""Stateful streams by key whose state ends: an outer join of any number of inputs, and running lists.

Both keep their state in RocksDB (use_rocksdb() sets that for a session) and close a key by a timer on event time: when the watermark is past
its last row (paste) or past that by a span (collapse), the state is dropped. Rows later than the watermark are ignored, as in any
stream with one. A key that comes again after it was closed begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..model import quoted

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Closing(StatefulProcessor):
    """Closes a key when the watermark has passed its last row by idle_ms."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def seen(self, ms: int) -> None:
        """Put the key's end off to what it is by a row at ms."""
        known = self.last.get()
        if known is None or ms > known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0] + self.idle_ms)
            self.handle.registerTimer(ms + self.idle_ms)
            self.last.update((ms,))

    @staticmethod
    def on_time(rows: Iterator[Row], timers) -> list[Row]:
        """Rows after the watermark. Spark itself lets rows pass that are late by the watermark of the batch before only."""
        passed = timers.getCurrentWatermarkInMs()
        return [r for r in rows if not passed or r["__ms"] > passed]


class Paste(_Closing):
    """The last row of each input, by time, side by side."""

    def __init__(self, names: Sequence[str], sizes: Sequence[int]):
        super().__init__(1)
        self.row, self.sizes = Row(*names), list(sizes)

    def init(self, handle) -> None:
        super().init(handle)
        self.inputs = handle.getMapState("inputs", "n int", "ms long, cells array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best: dict[int, tuple] = {}
        for r in self.on_time(rows, timerValues):
            new = (r["__ms"], [c if c is not None else "" for c in r["__cells"]], list(r["__cells"]))
            if r["__n"] not in best or new[:2] > best[r["__n"]][:2]:
                best[r["__n"]] = new
        for n, (ms, plain, cells) in best.items():
            known = self.inputs.getValue((n,)) if self.inputs.containsKey((n,)) else None
            if known is None or (ms, plain) > (known[0], [c if c is not None else "" for c in known[1]]):
                self.inputs.updateValue((n,), (ms, cells))
        if best:
            self.seen(max(ms for ms, *_ in best.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = {k[0]: v[1] for k, v in self.inputs.iterator()}
        self.inputs.clear()
        self.last.clear()
        yield self.row(key[0], *[c for n, size in enumerate(self.sizes) for c in found.get(n, [None] * size)])


class Collapse(_Closing):
    """A key's rows joined field by field in order of time, again whenever new ones come."""

    def __init__(self, names: Sequence[str], sep: str, idle_ms: int):
        super().__init__(idle_ms)
        self.row, self.sep = Row(*names), sep

    def init(self, handle) -> None:
        super().init(handle)
        self.rows = handle.getListState("rows", "ms long, cells array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["__ms"], [c if c is not None else "" for c in r["__cells"]]) for r in self.on_time(rows, timerValues)]
        if not new:
            return
        self.rows.appendList(new)
        self.seen(max(ms for ms, _ in new))
        lines = sorted((r[0], list(r[1])) for r in self.rows.get())
        yield self.row(key[0], *[self.sep.join(cells) for cells in zip(*[cells for _, cells in lines], strict=True)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.rows.clear()
        self.last.clear()
        return iter(())


def _cells(stream: DataFrame, key: str, time: str, fields: Sequence[str], n: int) -> DataFrame:
    ms: Column = F.unix_millis(F.col(time).cast("timestamp"))
    return stream.select(quoted(key).cast("string").alias(key), quoted(time).cast("timestamp").alias(time), F.lit(n).alias("__n"), ms.alias("__ms"), F.array(*[quoted(f).cast("string") for f in fields]).alias("__cells")).filter(quoted(key).isNotNull())


def paste_all(streams: Sequence[DataFrame], key: str, time: str, late: str) -> DataFrame:
    """A full outer join by key of any number of streams with columns key, time and fields of their own: one row a key, when the watermark, `late` behind
    the latest row of all, has passed it; of several rows of a key in one stream the last by time. Fields are text; null rows of a missing stream."""
    fields = [[c for c in s.columns if c not in (key, time)] for s in streams]
    names = [key, *[f for fs in fields for f in fs]]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"{names} are not all different")
    use_rocksdb(streams[0].sparkSession)
    rows = reduce(DataFrame.unionByName, [_cells(s, key, time, fs, n) for n, (s, fs) in enumerate(zip(streams, fields, strict=True))])
    schema = ", ".join(f"`{n}` string" for n in names)
    return rows.withWatermark(time, late).groupBy(quoted(key)).transformWithState(Paste(names, [len(f) for f in fields]), schema, "Append", "EventTime")


def collapse_running(stream: DataFrame, key: str, time: str, fields: Sequence[str], late: str, idle_ms: int, sep: str = "|") -> DataFrame:
    """Rows of a key as one row of joined texts, in order of time; for output mode "update": only keys with new rows come. A key without any for
    idle_ms of event time is closed and its rows forgotten."""
    use_rocksdb(stream.sparkSession)
    names = [key, *fields]
    schema = ", ".join(f"`{n}` string" for n in names)
    return _cells(stream, key, time, fields, 0).withWatermark(time, late).groupBy(quoted(key)).transformWithState(Collapse(names, sep, idle_ms), schema, "Update", "EventTime")
