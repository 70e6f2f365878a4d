"""Interval and point joins by bins.

Intervals are (start, end), both inclusive. Bins come in tiers, each SPREAD times as wide as the one
below. An interval belongs to the lowest tier in which it covers SPREAD bins at most. Two intervals meet in the
higher of their tiers, in the first bin they share: an equi-join without duplicates, whatever the lengths. One
side shows itself in its own tier, the other in the tiers that the first has; both ways round make all pairs.
The left rows of each bin are counted; those of a full bin are split, and the right ones of that bin repeated for each part. Both
sides are written once, so that what they come from is worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import replicates
from ..model import KeyedTable, quoted
from ..sources.store import written

#: A power of two.
SPREAD = 64
TIERS = 8
#: Left rows of a bin that are joined as one part.
ROWS_PER_BIN = 1_000_000
#: Full bins that are broadcast; more of them are joined by shuffle.
MAX_FULL = 100_000


def intervals(t: KeyedTable, start: str, end: str | None = None) -> DataFrame:
    """key, start, end of a table (end None: points); parallel lists give an interval an element."""
    first, last = t.identify(start), t.identify(end or start)
    if not t.listed:
        return t.df.select(quoted(t.key).alias("key"), quoted(first).cast("bigint").alias("start"), quoted(last).cast("bigint").alias("end"))
    rows = t.df.select(quoted(t.key).alias("key"), F.explode(replicates([first, last])).alias("r"))
    return rows.select("key", F.col("r.f0").cast("bigint").alias("start"), F.col("r.f1").cast("bigint").alias("end"))


def floor_div(number: str, by: str) -> Column:
    """Division of SQL whole numbers that rounds down, exact for all bigints."""
    return F.expr(f"({number} - pmod({number}, {by})) div {by}")


def _tier(length: Column, width: int) -> Column:
    """The lowest tier whose bins the length needs SPREAD of at most."""
    out = F.lit(TIERS - 1)
    for n in reversed(range(TIERS - 1)):
        out = F.when(length < width * SPREAD ** (n + 1), n).otherwise(out)
    return out


def _placed(df: DataFrame, on: tuple[str, str], width: int, own: str) -> tuple[DataFrame, list[int]]:
    """Valid intervals with their tier, as a table, and the tiers there are."""
    start, end = on
    df = written(df.filter(F.col(start) <= F.col(end)).withColumns({own: _tier(F.col(end) - F.col(start), width), f"{own}_id": F.monotonically_increasing_id()}), "intervals")
    return df, sorted(r[0] for r in df.select(own).distinct().collect())


def _parts(df: DataFrame, rows_per_bin: int) -> DataFrame:
    """tier, role, bin and number of parts of the bins that hold more rows than one part may."""
    counts = df.groupBy("__tier", "__role", "__bin").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_bin)
    return written(counts.select("__tier", "__role", "__bin", F.ceil(F.col("n") / rows_per_bin).cast("int").alias("__parts")), "full-bins")


def _shown(df: DataFrame, on: tuple[str, str], width: int, tiers: list[tuple[int, int, Column]]) -> DataFrame:
    """A row for each bin of each (tier, role) whose condition holds."""

    def bins(n: int, role: int) -> Column:
        at = lambda c: floor_div(f"`{c}`", str(width * SPREAD**n))
        return F.transform(F.sequence(at(on[0]), at(on[1])), lambda b: F.struct(F.lit(n).alias("tier"), F.lit(role).alias("role"), b.alias("bin")))

    none = F.array().cast("array<struct<tier:int,role:int,bin:bigint>>")
    shown = F.concat(none, *[F.when(holds, bins(n, role)).otherwise(none) for n, role, holds in tiers])
    return df.withColumn("__b", F.explode(shown)).withColumns({"__tier": F.col("__b.tier"), "__role": F.col("__b.role"), "__bin": F.col("__b.bin")}).drop("__b")


def overlaps(left: DataFrame, right: DataFrame, width: int, left_on: tuple[str, str] = ("start", "end"), right_on: tuple[str, str] = ("q_start", "q_end"), rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """All pairs of rows whose intervals overlap. width: of the lowest bins, about a usual
    interval's length. Column names of the two sides must differ."""
    (ls, le), (rs, re_) = left_on, right_on
    a, in_a = _placed(left, left_on, width, "__own_l")
    b, in_b = _placed(right, right_on, width, "__own_r")
    own_l, own_r = F.col("__own_l"), F.col("__own_r")
    # Role 0: left rows in their own tier. Role 1: right rows in theirs, which is higher than the left row's.
    a = _shown(a, left_on, width, [(n, 0, own_l == n) for n in in_a] + [(n, 1, own_l < n) for n in in_b])
    b = _shown(b, right_on, width, [(n, 0, own_r <= n) for n in in_a] + [(n, 1, own_r == n) for n in in_b])
    full = _parts(a, rows_per_bin)
    n_full = full.count()
    if n_full:
        full = F.broadcast(full) if n_full <= MAX_FULL else full
        at = ["__tier", "__role", "__bin"]
        part = F.pmod(F.xxhash64("__own_l_id"), F.coalesce("__parts", F.lit(1)))
        a = a.join(full, at, "left").withColumn("__part", part.cast("int"))
        b = b.join(full, at, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    else:
        a, b = (x.withColumn("__part", F.lit(0)) for x in (a, b))
    joined = a.join(b, ["__tier", "__role", "__bin", "__part"])
    first = floor_div(f"greatest(`{ls}`, `{rs}`)", f"shiftleft(bigint({width}), {SPREAD.bit_length() - 1} * __tier)")
    met = (F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs)) & (F.col("__bin") == first)
    return joined.filter(met).select(*[quoted(c) for c in (*left.columns, *right.columns)])


def at_points(ranges: DataFrame, points: DataFrame, width: int, on: tuple[str, str] = ("start", "end"), point: str = "point") -> DataFrame:
    """Pairs of a range and a point inside it."""
    doubled = points.withColumn("__end", F.col(point))
    return overlaps(ranges, doubled, width, on, (point, "__end")).drop("__end")


def collapse(ranges: DataFrame, by: str) -> DataFrame:
    """by, start, end: the ranges of each `by` that overlap or touch as one."""
    order = Window.partitionBy(by).orderBy("start", "end")
    latest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = ranges.withColumn("__new", F.coalesce((F.col("start") > latest + 1).cast("int"), F.lit(1)))
    parted = parted.withColumn("__part", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy(by, "__part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__part")


def query(ranges: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """The rows that overlap one range or position; the filter reaches the scan."""
    return ranges.filter((F.col("start") <= (start if end is None else end)) & (F.col("end") >= start))


def describe(ranges: DataFrame, with_key: bool = False) -> DataFrame:
    """Overlaps as 'start:end' or 'start:end:key'."""
    return ranges.select(F.concat_ws(":", "start", "end", *(["key"] if with_key else [])).alias("overlap"))
