"""Merging by key, matrices, counts and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import STRINGS, empty_list, in_order, padded, part
from ..model import ORD, KeyedTable, quoted
from ..sources.store import written


#: Jobs that trace_times() puts in order in one task.
ROWS_PER_WINDOW = 1_000_000


def merge_by_key(t: KeyedTable, one2one: bool = False, merge: bool = True) -> KeyedTable:
    """One row a key. Lists of `flat` and `double` tables are joined in row order (one2one: an empty
    list counts as one null, so lists stay parallel); of `single` and `list` tables, and without
    merge, the last row stays."""
    if t.listed and merge:
        cells = [padded(quoted(f)) if one2one else F.coalesce(quoted(f), empty_list()) for f in t.fields]
        rows = t.df.groupBy(quoted(t.key)).agg(in_order(cells).alias("__rows"))
        joined = [F.flatten(part(F.col("__rows"), i)).alias(f) for i, f in enumerate(t.fields)]
        return t.with_df(rows.select(quoted(t.key), *joined, F.col("__rows")[0][ORD].alias(ORD)))
    if not t.fields:
        return t.with_df(t.df.groupBy(quoted(t.key)).agg(F.min(ORD).alias(ORD)))
    row = F.struct(*[quoted(f).alias(f"f{i}") for i, f in enumerate(t.fields)])
    last = t.df.groupBy(quoted(t.key)).agg(F.max_by(row, quoted(ORD)).alias("__row"), F.min(ORD).alias(ORD))
    return t.with_df(last.select(quoted(t.key), *[F.col("__row")[f"f{i}"].alias(f) for i, f in enumerate(t.fields)], ORD))


def collapse(t: KeyedTable, sep: str = "|") -> KeyedTable:
    """Rows of a key as one row of joined texts, in row order."""
    rows = t.df.groupBy(quoted(t.key)).agg(in_order([quoted(f).cast("string") for f in t.fields]).alias("__rows"))
    joined = [F.array_join(part(F.col("__rows"), i), sep, "").alias(f) for i, f in enumerate(t.fields)]
    return t.with_df(rows.select(quoted(t.key), *joined, F.col("__rows")[0][ORD].alias(ORD)))


def collapse_runs(t: KeyedTable, sep: str = "|") -> KeyedTable:
    """Neighbouring rows of one key as one row of joined texts; the same key further on is a row of its own. Rows are put
    in order in parts, runs are told in each part by itself, and a table with a row a part carries over its borders whether a
    part's first run goes on from the part before. A run must fit in a task, as its row does."""
    from ..sources.store import work_path

    path = work_path(t.df.sparkSession, "runs")
    t.df.orderBy(ORD).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = t.df.sparkSession.read.parquet(path).withColumn("__part", F.shiftright("__id", 33))
    key, order = quoted(t.key), Window.partitionBy("__part").orderBy("__id")
    new = F.when(F.row_number().over(order) == 1, F.lit(1)).otherwise((~key.eqNullSafe(F.lag(key).over(order))).cast("int"))
    rows = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))

    ends = F.struct("__id", key.alias("key"))
    parts = rows.groupBy("__part").agg(F.max("__run").alias("runs"), F.min(ends).alias("first"), F.max(ends).alias("last"))
    line = Window.orderBy("__part")  # a row a part
    before = F.lag("last").over(line)
    goes_on = (before.isNotNull() & F.col("first.key").eqNullSafe(before["key"])).cast("int")
    parts = parts.withColumns({"goes_on": goes_on, "earlier": F.coalesce(F.sum("runs").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    parts = parts.select(F.col("__part").alias("__of"), (F.col("earlier") - F.sum("goes_on").over(line)).alias("__before"))
    rows = rows.join(F.broadcast(parts), F.col("__part") == F.col("__of"))  # a row a part

    cells = [quoted(f).cast("string") for f in t.fields]
    one = rows.select(key, *map(quoted, t.fields), F.col("__id").alias(ORD), (F.col("__before") + F.col("__run")).alias("__n"))
    found = one.groupBy("__n").agg(F.first(key).alias(t.key), in_order(cells).alias("__rows"))
    joined = [F.array_join(part(F.col("__rows"), i), sep, "").alias(f) for i, f in enumerate(t.fields)]
    return t.with_df(found.select(quoted(t.key), *joined, F.col("__rows")[0][ORD].alias(ORD)))


def field_match_counts(t: KeyedTable, words: Sequence[str]) -> DataFrame:
    """field, n: how many distinct values of each column, the key included, are among words."""
    as_list = lambda c: quoted(c).cast(STRINGS) if t.listed and c != t.key else F.array(quoted(c).cast("string"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), as_list(c).alias("values")) for c in t.all_fields]))
    values = t.df.select(pairs.alias("p")).select(F.col("p.field").alias("field"), F.explode("p.values").alias("value"))
    wanted = t.df.sparkSession.createDataFrame([(w,) for w in words], "value string")
    return values.join(F.broadcast(wanted.distinct()), "value").groupBy("field").agg(F.count_distinct("value").alias("n"))  # the caller's list


def incidence(pairs: DataFrame, value: Column | None = None, targets: Sequence | None = None) -> DataFrame:
    """pairs: source, target. A row a source, a column a target: whether there is a pair, or the
    smallest value. targets: the columns, if known; else Spark looks them up first."""
    pivot = pairs.groupBy("source").pivot("target", list(targets) if targets is not None else None)
    if value is not None:
        return pivot.agg(F.min(value))
    out = pivot.agg(F.lit(True))
    return out.na.fill(False, [c for c in out.columns if c != "source"])


def adjacency(pairs: DataFrame, value: Column | None = None) -> DataFrame:
    """source, targets and values, parallel and in target order; pairs without a value go."""
    rows = pairs.select("source", "target", (value if value is not None else F.lit(True)).alias("value")).filter("value is not null")
    grouped = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("target", "value"))).alias("r"))
    return grouped.select("source", F.transform("r", lambda x: x["target"]).alias("targets"), F.transform("r", lambda x: x["value"]).alias("values"))


def summary(t: KeyedTable) -> DataFrame:
    """size, key, fields and shape, one row."""
    return t.df.agg(F.count("*").alias("size")).select("size", F.lit(t.key).alias("key"), F.lit("|".join(t.fields)).alias("fields"), F.lit(t.shape).alias("shape"))


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def trace_summary(jobs: DataFrame) -> DataFrame:
    """jobs: task, start, end (timestamps). Calls, mean and total seconds of each task, cut to whole ones."""
    seconds = (_micros("end") - _micros("start")) / 1e6
    return jobs.groupBy("task").agg(F.count("*").alias("calls"), F.floor(F.avg(seconds)).cast("bigint").alias("avg"), F.floor(F.sum(seconds)).cast("bigint").alias("total"))


def trace_times(jobs: DataFrame, by: str | None = None, drop_gaps: bool = True, rows_per_window: int = ROWS_PER_WINDOW) -> DataFrame:
    """jobs with start_s and end_s, in seconds from the first start of all (or of each `by`). Gaps, the
    times in which no job runs, are taken out of both. If more jobs than rows_per_window belong together, they are dealt to slices of
    about equal size, in order of time, so that no window is over all of them: the latest end and the gaps before a slice come from a table with a
    row a slice."""
    keys = [by] if by else []
    micros = written(jobs.withColumns({"__s": _micros("start"), "__e": _micros("end")}), "jobs")
    most = micros.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sliced = most > rows_per_window
    if sliced:
        slices = -(-micros.count() // rows_per_window)
        dealt = micros.repartitionByRange(slices, "__s", "__e", F.xxhash64(*map(quoted, micros.columns)))
        micros = written(dealt.withColumn("__cut", F.spark_partition_id()), "jobs")

    def before(rows: DataFrame, value: Column, total: Callable[[str], Column], name: str, first: str | None = None) -> DataFrame:
        """rows with the total of value over earlier slices, and the first start of all."""
        if not sliced:
            out = rows.withColumn(name, F.lit(None).cast("bigint"))
            return out.withColumn(first, F.min("__s").over(Window.partitionBy(*keys))) if first else out
        parts = rows.groupBy(*keys, "__cut").agg(value.alias("__v"), F.min("__s").alias("__low"))
        order = Window.partitionBy(*keys).orderBy("__cut")  # a row a slice
        wanted = {name: total("__v").over(order.rowsBetween(Window.unboundedPreceding, -1))} | ({first: F.min("__low").over(order)} if first else {})
        parts = parts.withColumns(wanted).select(*[F.col(k).alias(f"__of_{k}") for k in [*keys, "__cut"]], *wanted)
        same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in [*keys, "__cut"]]
        return rows.join(parts, same).drop(*[f"__of_{k}" for k in [*keys, "__cut"]])

    order = Window.partitionBy(*keys, *(["__cut"] if sliced else [])).orderBy("__s", "__e")
    out = before(micros, F.max("__e"), F.max, "__ended", "__first")
    latest = F.greatest(F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1)), "__ended")
    out = out.withColumn("__gap", F.greatest(F.col("__s") - F.coalesce(latest, F.col("__s")), F.lit(0)))
    out = before(out, F.sum("__gap"), F.sum, "__earlier")
    # Jobs with one start share a gap: the first of them has it, later ones and its equals count it as well.
    gone = F.coalesce("__earlier", F.lit(0)) + F.sum("__gap").over(order) if drop_gaps else F.lit(0)
    out = out.withColumn("__gone", gone).withColumns({"start_s": (F.col("__s") - F.col("__first") - F.col("__gone")) / 1e6, "end_s": (F.col("__e") - F.col("__first") - F.col("__gone")) / 1e6})
    return out.select(*map(quoted, jobs.columns), "start_s", "end_s")
