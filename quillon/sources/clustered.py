"""Tables in sorted files, with a small table of what range of values each file holds, so that a reader opens only the files it needs.

    <path>/rows/...parquet          sorted by `order`, in ranges, a range a file
    <path>/files/...parquet         file, n, low, high (of the first column of `order`), reach, through

For intervals, `reach` is the greatest end in a file and `through` the greatest end in it and all files before: intervals are sorted by start
only, and `through`, which never falls, tells from which file on a position can be reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import quoted

INTERVAL = ("start", "end")


def write(df: DataFrame, path: str, order: Sequence[str], reach: str | None = None, files: int | None = None) -> None:
    """Write df in ranges of `order`, about `files` of them (else as Spark sees fit). Rows are told apart by all columns of
    order, so that a frequent first value is dealt to several files."""
    by = [quoted(c) for c in order]
    dealt = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.parquet(f"{path}/rows")
    first, reach = quoted(order[0]), quoted(reach or order[0])
    found = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows").groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    found = found.agg(F.count("*").alias("n"), F.min(first).alias("low"), F.max(first).alias("high"), F.max(reach).alias("reach"))
    through = F.max("reach").over(Window.orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row a file
    found.withColumn("through", through).coalesce(1).write.parquet(f"{path}/files")


def files(spark: SparkSession, path: str, needed: Column) -> list[str]:
    """The files that a condition on low, high, reach and through asks for; a row each comes to the driver."""
    return sorted(r[0] for r in spark.read.parquet(f"{path}/files").filter(needed).select("file").collect())


def read(spark: SparkSession, path: str, needed: Column | None = None) -> DataFrame:
    """The rows of the files that a condition asks for; without one, of all."""
    rows = spark.read.parquet(f"{path}/rows")
    if needed is None:
        return rows
    chosen = files(spark, path, needed)
    return spark.read.schema(rows.schema).parquet(*[f"{path}/rows/{f}" for f in chosen]) if chosen else rows.limit(0)


def having(values: Sequence) -> Column:
    """Files whose range holds any of the values."""
    out = F.lit(False)
    for v in values:
        out = out | F.lit(v).between(F.col("low"), F.col("high"))
    return out


class IntervalIndex:
    """Intervals (start and end inclusive, and further columns) on disk, for queries by range or position."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def save(cls, ranges: DataFrame, path: str, files: int | None = None) -> IntervalIndex:
        """ranges: start, end and others. Intervals without an end, or that end before they start, are left out."""
        rest = [c for c in ranges.columns if c not in INTERVAL and dict(ranges.dtypes)[c] in ("string", "int", "bigint")]
        write(ranges.filter("start <= end"), path, [*INTERVAL, *rest], reach="end", files=files)
        return cls(ranges.sparkSession, path)

    @staticmethod
    def _needed(start: int, end: int) -> Column:
        return (F.col("through") >= start) & (F.col("low") <= end) & (F.col("reach") >= start)

    def files(self, start: int, end: int | None = None) -> list[str]:
        """The files that a query reads: from the first whose `through` reaches it to the last that starts before its end, but
        those that no interval of theirs reaches it."""
        return files(self.spark, self.path, self._needed(start, start if end is None else end))

    def query(self, start: int, end: int | None = None) -> DataFrame:
        """The intervals that overlap a range, or hold a position."""
        end = start if end is None else end
        return read(self.spark, self.path, self._needed(start, end)).filter((F.col("start") <= end) & (F.col("end") >= start))

    def query_all(self, wanted: Sequence[tuple[int, int]]) -> DataFrame:
        """q_start and q_end of each range and the intervals that overlap it, from the files of all of them; ranges are the caller's list."""
        from ..operators.ranges import overlaps

        needed = F.lit(False)
        for start, end in wanted:
            needed = needed | self._needed(start, end)
        asked = self.spark.createDataFrame([(int(a), int(b)) for a, b in wanted], "q_start long, q_end long")
        return overlaps(read(self.spark, self.path, needed), asked, max(1, max((b - a for a, b in wanted), default=1)))

    def size(self) -> int:
        return self.spark.read.parquet(f"{self.path}/files").agg(F.sum("n")).first()[0] or 0
