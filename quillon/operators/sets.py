"""Unions, overlays and differences of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import functions as F

from ..model import ORD, KeyedTable, quoted
from .aggregate import merge_by_key


def concat(tables: Sequence[KeyedTable], merge: bool = False) -> KeyedTable:
    """All rows, under the first table's names; merge: rows of a key merge, earlier tables first."""
    first = tables[0]
    parts = [t.df.select(*[quoted(c).alias(n) for c, n in zip(t.all_fields, first.all_fields, strict=True)], F.struct(F.lit(i).alias("t"), quoted(ORD).alias("o")).alias(ORD)) for i, t in enumerate(tables)]
    out = first.with_df(reduce(lambda a, b: a.unionByName(b), parts))
    return merge_by_key(out) if merge else out


def overlay(t: KeyedTable, other: KeyedTable) -> KeyedTable:
    """t's rows with other's in place of those of the same key."""
    keys = other.df.select(quoted(other.key).alias("__k")).distinct()
    rest = t.df.join(keys, quoted(t.key) == F.col("__k"), "left_anti")
    return concat([t.with_df(rest), other])


def merge_zip(t: KeyedTable, other: KeyedTable) -> KeyedTable:
    """Both tables' lists, joined by key."""
    return concat([t, other], merge=True)


def zip_new(t: KeyedTable, rows: KeyedTable) -> KeyedTable:
    """t with rows of new values: those of a known key are appended to its lists, an empty list as one null so
    that the lists stay parallel; other keys are new."""
    return merge_by_key(concat([t, rows]), one2one=True)


def without(t: KeyedTable, other: KeyedTable) -> KeyedTable:
    keys = other.df.select(quoted(other.key).alias("__k")).distinct()
    return t.with_df(t.df.join(keys, quoted(t.key) == F.col("__k"), "left_anti"))


def common_keys(tables: Sequence[KeyedTable]) -> KeyedTable:
    """The first table's rows whose key all tables have."""
    first, *rest = tables
    for other in rest:
        keys = other.df.select(quoted(other.key).alias("__k")).distinct()
        first = first.with_df(first.df.join(keys, quoted(first.key) == F.col("__k"), "left_semi"))
    return first
