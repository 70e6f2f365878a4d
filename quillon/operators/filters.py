"""Selection of rows: criteria, key lists, lookups and stacked filters."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import compare, empty_list, flat_values, is_comparison, says_true, sure, to_float, truthy
from ..model import KEY, ORD, KeyedTable, quoted

#: Longer lists of values are joined, not written into the plan.
MAX_IN = 1000


def _values(t: KeyedTable, name: str) -> Column:
    """A column's values in a row, as an array of strings."""
    if t.listed and name != t.key:
        return F.coalesce(quoted(name).cast("array<string>"), empty_list())
    return F.array(quoted(name).cast("string"))


def _any(values: Column, test: object, first: Column) -> Column:
    """Whether any of values meets a test: a value, a collection, a pattern, a comparison with the
    first number, or a function of one value."""
    if callable(test) and not isinstance(test, re.Pattern):
        return F.exists(values, lambda v: sure(test(v)))
    if isinstance(test, re.Pattern):
        return F.exists(values, lambda v: sure(v.rlike(test.pattern)))
    if is_comparison(test):
        return compare(to_float(first), test)
    if isinstance(test, (list, tuple, set, frozenset)):
        return F.arrays_overlap(values, F.array(*[F.lit(str(x)) for x in sorted(map(str, test))])) if test else F.lit(False)
    return F.array_contains(values, str(test))


def condition(t: KeyedTable, criterion: object) -> Column:
    """A criterion as a Column. A Column is itself. A value, collection or pattern is tried on the key
    and all fields. A dict maps fields (or ':key') to tests, all of which must hold; a number
    there asks for so many values at least."""
    if isinstance(criterion, Column):
        return sure(criterion)
    if not isinstance(criterion, dict):
        values = F.concat(_values(t, t.key), flat_values(t.fields, t.listed))
        return sure(_any(values, criterion, F.get(values, F.lit(0))))
    out = F.lit(True)
    for name, test in criterion.items():
        column = t.identify(name)
        values = _values(t, column)
        if isinstance(test, (int, float)) and not isinstance(test, bool):
            out = out & (F.size(F.filter(values, lambda v: v.isNotNull())) >= test)
        else:
            out = out & sure(_any(values, test, F.get(values, F.lit(0))))
    return out


def select(t: KeyedTable, criterion: object, invert: bool = False) -> KeyedTable:
    """Rows that meet a criterion, or with invert the others. A long list of keys becomes a semi-join."""
    if isinstance(criterion, dict) and len(criterion) == 1:
        (name, keys), = criterion.items()
        if t.identify(name) == t.key and isinstance(keys, (list, tuple, set, frozenset)) and len(keys) > MAX_IN:
            wanted = t.df.sparkSession.createDataFrame([(str(k),) for k in keys], "__k string").distinct()
            return t.with_df(t.df.join(wanted, quoted(t.key).cast("string") == F.col("__k"), "left_anti" if invert else "left_semi"))
    found = condition(t, criterion)
    return t.with_df(t.df.filter(~found if invert else found))


def select_value(t: KeyedTable, field: str, test: Callable[[Column], Column], invert: bool = False) -> KeyedTable:
    """Rows whose whole cell (or key) meets a test."""
    found = sure(test(quoted(t.identify(field))))
    return t.with_df(t.df.filter(~found if invert else found))


def select_named(t: KeyedTable, field: str, test: str | re.Pattern, names: DataFrame, invert: bool = False) -> KeyedTable:
    """Rows with a value of a field whose name is test, or matches it. names: value and target (its name)."""
    name = t.identify(field)
    found = F.col("target").rlike(test.pattern) if isinstance(test, re.Pattern) else F.col("target") == test
    wanted = names.filter(found).select(F.col("value").cast("string").alias("__v"))
    cells = t.df.select(quoted(t.key).alias("__k"), quoted(ORD).alias("__row"), F.explode(_values(t, name)).alias("__e"))
    hits = cells.join(wanted, F.col("__e") == F.col("__v"), "left_semi").select("__k", "__row").distinct()
    same = (quoted(t.key) == F.col("__k")) & quoted(ORD).eqNullSafe(F.col("__row"))
    return t.with_df(t.df.join(hits, same, "left_anti" if invert else "left_semi"))


def row_matches(t: KeyedTable, test: object, fields: Sequence[str] | None = None, invert: bool = False) -> Column:
    """The per-row predicate on key and values: a comparison is tried on every value, and a number asks
    for more than so many values."""
    names = [t.identify(f) for f in fields] if fields else list(t.all_fields)
    values = F.concat(*[_values(t, n) for n in names])
    if isinstance(test, (int, float)) and not isinstance(test, bool):
        found = F.size(values) > test
    elif is_comparison(test):
        found = F.exists(values, lambda v: sure(compare(to_float(v), test)))
    else:
        found = _any(values, test, F.get(values, F.lit(0)))
    return ~sure(found) if invert else sure(found)


def prefix(t: KeyedTable, start: str) -> KeyedTable:
    return t.with_df(t.df.filter(F.startswith(quoted(t.key).cast("string"), F.lit(start))))


def subset(t: KeyedTable, keys: DataFrame | Iterable[str], invert: bool = False) -> KeyedTable:
    """Rows of the given keys, by a semi-join; keys may be a DataFrame of one column. A list's order
    becomes the rows' order."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias("__k")).distinct()
        return t.with_df(t.df.join(wanted, quoted(t.key) == F.col("__k"), "left_anti" if invert else "left_semi"))
    listed = list(dict.fromkeys(map(str, keys)))
    wanted = t.df.sparkSession.createDataFrame(list(enumerate(listed)), "__o long, __k string")
    if invert:
        return t.with_df(t.df.join(wanted, quoted(t.key).cast("string") == F.col("__k"), "left_anti"))
    found = t.df.join(wanted, quoted(t.key).cast("string") == F.col("__k"))
    return t.with_df(found.select(*map(quoted, t.all_fields), F.col("__o").alias(ORD)))


def keys_of_any(stacks: Sequence[FilterStack]) -> DataFrame:
    """key: the distinct keys, sorted, of the rows that any of the stacks leaves."""
    found = [s.result().df.select(quoted(s.table.key).cast("string").alias("key")) for s in stacks]
    return reduce(DataFrame.unionByName, found).distinct().orderBy("key")


def values_at(t: KeyedTable, keys: Sequence[str]) -> DataFrame:
    """A row a requested key, in order, nulls for missing ones."""
    wanted = t.df.sparkSession.createDataFrame(list(enumerate(map(str, keys))), "position long, requested string")
    found = wanted.join(t.df, quoted(t.key).cast("string") == F.col("requested"), "left")
    return found.select("position", "requested", *map(quoted, t.fields)).orderBy("position")


class FilterStack:
    """Filters on top of a table, which all must hold: ':key' against a value or a set; a field
    against a value that its cell holds, or a list that it equals. With a folder, the keys that a filter on a field
    finds are saved there once, sorted, and read from then on by any stack of that folder; reset(True) deletes them. append()
    keeps what is saved up to date as the table grows."""

    def __init__(self, table: KeyedTable, folder: str | None = None):
        self.table, self.filters, self.folder = table, [], folder and folder.rstrip("/")
        self.saved: dict[str, Column] = {}

    def _save(self, rows: DataFrame, test: Column, path: str) -> None:
        """The keys of the rows that meet a test, unless they are there."""
        from ..sources.store import exists

        if not exists(rows.sparkSession, f"{path}/_SUCCESS"):
            keys = rows.filter(test).select(quoted(self.table.key).alias("__k")).distinct()
            keys.repartitionByRange("__k").sortWithinPartitions("__k").write.mode("overwrite").parquet(path)

    def _saved(self, match: str, value: object, test: Column) -> str:
        digest = hashlib.sha256(json.dumps([match, value], default=sorted).encode()).hexdigest()[:16]
        path = f"{self.folder}/filter-{digest}"
        self._save(self.table.df, test, f"{path}/batch=0")
        self.saved[path] = test
        return path

    def append(self, rows: DataFrame, number: int) -> None:
        """Take the keys of rows that have come into the table in what the stack's filters have saved. number, from 1, names the batch: one
        that was taken is not taken again. Only the new rows are read."""
        for path, test in self.saved.items():
            self._save(rows, test, f"{path}/batch={int(number)}")

    def add(self, match: str, value: object) -> FilterStack:
        name = match.removeprefix("field:")
        column = self.table.identify(KEY if name in ("key", KEY) else name)
        if column == self.table.key:
            test = quoted(column).cast("string").isin(list(map(str, value))) if isinstance(value, (list, set, tuple)) else quoted(column).cast("string") == str(value)
        elif isinstance(value, (list, tuple)):
            test = quoted(column).cast("array<string>") == F.array(*map(F.lit, value))
        else:
            test = F.array_contains(_values(self.table, column), str(value))
        test = sure(test)
        self.filters.append(self._saved(match, value, test) if self.folder and column != self.table.key else test)
        return self

    def pop(self) -> None:
        self.filters.pop()

    def reset(self, saved: bool = False) -> None:
        from ..sources.store import delete

        self.filters.clear()
        if saved and self.folder:
            delete(self.table.df.sparkSession, self.folder)

    @contextmanager
    def having(self, match: str, value: object):
        self.add(match, value)
        try:
            yield self.result()
        finally:
            self.pop()

    def result(self, table: KeyedTable | None = None) -> KeyedTable:
        """The rows that all filters leave, of the table or of what it is by now."""
        table = table or self.table
        df, kind = table.df, dict(table.df.dtypes)[table.key]
        for f in self.filters:
            if isinstance(f, str):
                keys = df.sparkSession.read.schema(f"__k {kind}").parquet(f).select("__k")
                df = df.join(keys, quoted(table.key) == F.col("__k"), "left_semi")
            else:
                df = df.filter(f)
        return table.with_df(df)


def edge_filter(edges: DataFrame, field: str, value: object | None = None) -> DataFrame:
    """Edges whose info field is truthy, or equals a value."""
    return edges.filter(truthy(quoted(field).cast("string")) if value is None else sure(quoted(field).cast("string") == str(value)))


def info_condition(field: str, value: str | None) -> Column:
    return says_true(quoted(field).cast("string")) if value is None else sure(quoted(field).cast("string") == value)
