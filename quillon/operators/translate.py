"""Identifier translation: paths through mapping tables, and columns translated along them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ORD, KeyedTable, find_name, quoted
from .aggregate import merge_by_key
from .joins import index, value_pairs


class NoPath(LookupError):
    """No chain of tables leads from one name to the other."""


def _finder(schemas: Sequence[Sequence[str]], name: str) -> Callable[[Sequence[str]], bool]:
    """Whether a schema has a name: exactly, if any schema has it so, else loosely."""
    exact = any(name in s for s in schemas)
    return lambda s: name in s if exact else find_name(s, name) is not None


def _shared(a: Sequence[str], b: Sequence[str], besides: str | None = None) -> str | None:
    """A name of a that b has too, exactly rather than loosely."""
    names = [n for n in a if n != besides]
    return next((n for n in names if n in b), None) or next((n for n in names if find_name(b, n)), None)


def path(schemas: Sequence[Sequence[str]], source: str, target: str, max_tables: int | None = 3) -> list[int]:
    """The numbers of the tables of a shortest chain from source to target, each sharing a name with
    the next; earlier tables first."""
    starts, ends = _finder(schemas, source), _finder(schemas, target)
    start = [[i] for i, s in enumerate(schemas) if starts(s)]
    todo, seen = deque(start), {p[0] for p in start}
    while todo:
        chain = todo.popleft()
        if ends(schemas[chain[-1]]):
            return chain
        if max_tables is not None and len(chain) >= max_tables:
            continue
        for i, s in enumerate(schemas):
            if i not in seen and _shared(schemas[chain[-1]], s):
                seen.add(i)
                todo.append([*chain, i])
    raise NoPath(f"no path from {source!r} to {target!r}")


def _pairs(t: KeyedTable, source: str, target: str) -> DataFrame:
    """value, target of one table, the first in row order."""
    return index(t, t.identify(target), [source])


def translation_index(tables: Sequence[KeyedTable], source: str | None, target: str, max_tables: int | None = 3) -> DataFrame:
    """value, target along the shortest path; first matches win. source None: from any column."""
    if source is None:
        has = _finder([t.all_fields for t in tables], target)
        t = next((t for t in tables if has(t.all_fields)), None)
        if t is None:
            raise NoPath(f"no table has {target!r}")
        return index(t, t.identify(target))
    chain = [tables[i] for i in path([t.all_fields for t in tables], source, target, max_tables)]
    here, out = source, None
    for n, t in enumerate(chain):
        there = target if n == len(chain) - 1 else _shared(t.all_fields, chain[n + 1].all_fields, t.identify(here)) or here
        # On the way all targets count, ranked by order; at the end the first one stays.
        step = value_pairs(t, t.identify(there), [t.identify(here)]).select("value", "target", "order")
        if out is None:
            out = step.select("value", "target", F.col("order").alias("__o0"))
        else:
            nxt = step.select(F.col("value").alias("__v"), F.col("target").alias("__t"), F.col("order").alias(f"__o{n}"))
            out = out.join(nxt, F.col("target") == F.col("__v")).drop("target", "__v").withColumnRenamed("__t", "target")
        here = there
    rank = F.struct(*[f"__o{n}" for n in range(len(chain))])
    return out.groupBy("value").agg(F.min_by("target", rank).alias("target"))


def translate(t: KeyedTable, field: str, target: str, tables: Sequence[KeyedTable], keep_unresolved: bool = False, merge: bool = True) -> KeyedTable:
    """The key or a column in another naming. Rows whose key has no translation go (keep_unresolved:
    the old key stays), and rows of one new key merge; a list loses elements without one, a
    scalar becomes null."""
    name = t.identify(field)
    found = translation_index(tables, name, target).withColumnsRenamed({"value": "__v", "target": "__t"})
    if name == t.key:
        joined = t.df.join(found, quoted(name).cast("string") == F.col("__v"), "left" if keep_unresolved else "inner")
        key = F.coalesce("__t", quoted(name).cast("string"))
        return merge_by_key(t.with_df(joined.select(key.alias(target), *map(quoted, t.fields), ORD), key=target), merge=merge)
    if not t.listed:
        joined = t.df.join(found, quoted(name).cast("string") == F.col("__v"), "left")
        value = F.coalesce("__t", quoted(name).cast("string")) if keep_unresolved else F.col("__t")
        columns = [value.alias(target) if f == name else quoted(f) for f in t.fields]
    else:
        # Keys and orders may repeat; rows that are alike in both and in the list have the same translations.
        row = [quoted(t.key).alias("__k"), quoted(ORD).alias("__row"), F.xxhash64(quoted(name)).alias("__same")]
        parts = t.df.select(*row, F.posexplode(quoted(name)).alias("__at", "__e"))
        parts = parts.join(found, F.col("__e") == F.col("__v"), "left" if keep_unresolved else "inner")
        lists = parts.groupBy("__k", "__row", "__same").agg(F.array_sort(F.collect_set(F.struct("__at", F.col("__t").alias("t")))).alias("__l"))
        of = [a.eqNullSafe(F.col(b)) for a, b in ((quoted(t.key), "__k"), (quoted(ORD), "__row"), (F.xxhash64(quoted(name)), "__same"))]
        joined = t.df.join(lists, reduce(lambda a, b: a & b, of), "left")
        value = F.coalesce(F.transform("__l", lambda x: x["t"]), F.array().cast("array<string>"))
        columns = [value.alias(target) if f == name else quoted(f) for f in t.fields]
    return t.with_df(joined.select(quoted(t.key), *columns, ORD), fields=[target if f == name else f for f in t.fields])


def translate_column(df: DataFrame, column: str, found: DataFrame, to: str | None = None, fallback: bool = False) -> DataFrame:
    """df with a column translated by an index (value, target); fallback: unresolved values stay."""
    index_ = found.select(F.col("value").alias("__v"), F.col("target").alias("__t"))
    joined = df.join(index_, quoted(column).cast("string") == F.col("__v"), "left")
    value = F.coalesce("__t", quoted(column).cast("string")) if fallback else F.col("__t")
    return joined.withColumn(to or column, value).drop("__v", "__t")
