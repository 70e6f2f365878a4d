"""Which targets of a relation go with a list of sources more often than chance would have it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sorting import numbered

#: ln n! below this comes from a table, above it from Stirling's series, whose error is then under 1e-13.
TABLE = 32
BLOCK = 4096


def log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(TABLE)])
    return F.when(n < TABLE, F.get(small, n.cast("int"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(hits: Column, marked: Column, drawn: Column, total: Column) -> Column:
    """The chance of `hits` or more marked ones among `drawn` of `total`, of which `marked` are marked."""
    most = F.least(marked, drawn)
    least = F.greatest(hits, marked + drawn - total, F.lit(0))
    all_ = _log_choose(total, drawn)
    chance = lambda i: F.exp(_log_choose(marked, i) + _log_choose(total - marked, drawn - i) - all_)
    tail = F.aggregate(F.sequence(least, F.greatest(most, least)), F.lit(0.0), lambda a, i: a + F.when(i <= most, chance(i)).otherwise(0.0))
    return F.when(hits <= F.greatest(marked + drawn - total, F.lit(0)), F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))


def adjusted(df: DataFrame, p: str, ties: str, name: str = "adjusted") -> DataFrame:
    """df with the false discovery rate at which each row counts (Benjamini and Hochberg): the least of p * n / rank of it and all rows
    after it. Ranks come from the sorted parts, and the least from blocks of BLOCK ranks, which have a row each in a small table."""
    rows = numbered(df.orderBy(p, ties), "__rank")
    n = rows.count()
    rows = rows.withColumns({"__v": F.col(p) * n / F.col("__rank"), "__block": F.floor((F.col("__rank") - 1) / BLOCK)})
    later = Window.orderBy(F.desc("__of")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("__block").alias("__of")).agg(F.min("__v").alias("__low")).select("__of", F.min("__low").over(later).alias("__later"))
    own = F.min("__v").over(Window.partitionBy("__block").orderBy(F.desc("__rank")))
    out = rows.join(blocks, F.col("__block") == F.col("__of")).withColumn(name, F.least(own, "__later", F.lit(1.0)))
    return out.drop("__rank", "__v", "__block", "__of", "__later")


def enrichment(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges: source, target. entities: one column. target, n (its sources), hits (of them among entities), p and adjusted, of every target. Entities
    that are no source of the relation don't count; the rest of the sources are what chance draws from."""
    wanted = entities.select(F.col(entities.columns[0]).cast("string").alias("__e")).distinct().withColumn("__in", F.lit(1))
    pairs = edges.select("source", "target").distinct().join(wanted, F.col("source") == F.col("__e"), "left")
    drawn = F.count_distinct(F.when(F.col("__in") == 1, F.col("source")))
    total, drawn = pairs.agg(F.count_distinct("source"), drawn).first()
    by_target = pairs.groupBy("target").agg(F.count("*").alias("n"), F.count("__in").alias("hits"))
    p = hypergeometric_tail(F.col("hits"), F.col("n"), F.lit(drawn).cast("long"), F.lit(total).cast("long"))
    return adjusted(by_target.withColumn("p", p), "p", "target")
