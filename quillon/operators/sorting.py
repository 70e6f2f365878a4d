"""Orders, pages and heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY, ORD, KeyedTable, quoted


def sort_columns(t: KeyedTable, field: str = KEY, reverse: bool = False) -> list[Column]:
    """A total order: nulls first; lists by length, then by first element; then the key."""
    name = t.identify(field)
    parts = [F.size(quoted(name)), F.get(quoted(name), F.lit(0))] if t.listed and name != t.key else [quoted(name)]
    return [*[p.desc_nulls_last() if reverse else p.asc_nulls_first() for p in parts], quoted(t.key).asc()]


def sort_by(t: KeyedTable, field: str = KEY, reverse: bool = False, by: Column | None = None) -> DataFrame:
    order = [by.desc_nulls_last() if reverse else by.asc_nulls_first(), quoted(t.key)] if by is not None else sort_columns(t, field, reverse)
    return t.df.orderBy(*order).select(*map(quoted, t.all_fields))


def numbered(df: DataFrame, position: str = "position") -> DataFrame:
    """A sorted table with each row's place, from 1: its place in its part plus the rows of all parts before, which come from
    a table with a row a part."""
    from ..sources.store import work_path

    path = work_path(df.sparkSession, "sorted")
    df.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__p", F.shiftright("__id", 33))
    before = F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("__p").agg(F.count("*").alias("n"), F.min("__id").alias("__first")).select("__p", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id") - F.col("__first") + 1
    return rows.join(F.broadcast(parts), "__p").withColumn(position, place).drop("__id", "__p", "__first", "__before")  # a row a part


def page(t: KeyedTable, number: int, size: int, field: str = KEY, reverse: bool = False) -> DataFrame:
    """The number-th page, from 1, of the sorted rows; past the end it is empty."""
    return sort_by(t, field, reverse).offset((number - 1) * size).limit(size)


def head(t: KeyedTable, n: int = 10) -> DataFrame:
    return t.df.orderBy(ORD).limit(n).select(*map(quoted, t.all_fields))


def top(t: KeyedTable, n: int, field: str) -> DataFrame:
    return sort_by(t, field, reverse=True).limit(n)


def keys_in_order(t: KeyedTable, fields: Sequence[str] = ()) -> DataFrame:
    return t.df.orderBy(*(map(quoted, fields or [t.key]))).select(quoted(t.key))
