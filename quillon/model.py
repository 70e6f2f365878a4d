"""The keyed table: a DataFrame with a key column, named fields, a shape and a row order.

Shapes: `single` (one scalar), `list` (a scalar a field), `flat` (one array) and `double` (an array a
field; position i of all arrays is one replicate). Column ORD holds the order of rows, for
the operators whose result depends on it; it is an order, not a result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPES = ("single", "list", "flat", "double")
ORD = "_ord"
KEY = ":key"


class UnknownField(KeyError):
    """A name that no column of a table answers to."""


def _base(name: str) -> tuple[str, str | None]:
    """'Husband (ID)' is ('Husband', 'ID')."""
    m = re.fullmatch(r"(.*?)\s*\(([^()]*)\)", name)
    return (m[1], m[2]) if m else (name, None)


def same_name(a: str, b: str) -> bool:
    """Names match if equal, if one is the other's format in parentheses, or its part before them."""
    if a == b:
        return True
    (base_a, format_a), (base_b, format_b) = _base(a), _base(b)
    return b == format_a or a == format_b or (format_a is None and a == base_b) or (format_b is None and b == base_a)


def find_name(names: Sequence[str], wanted: str, strict: bool = False) -> str | None:
    """The first name that is wanted exactly, or else matches it loosely."""
    if wanted in names:
        return wanted
    return None if strict else next((n for n in names if same_name(n, wanted)), None)


@dataclass(frozen=True)
class Meta:
    key: str
    fields: tuple[str, ...]
    shape: str = "double"
    namespace: str | None = None
    filename: str | None = None
    identifiers: tuple[KeyedTable, ...] = field(default=(), compare=False, repr=False)


@dataclass(frozen=True)
class KeyedTable:
    df: DataFrame
    meta: Meta

    key = property(lambda self: self.meta.key)
    fields = property(lambda self: self.meta.fields)
    shape = property(lambda self: self.meta.shape)
    all_fields = property(lambda self: (self.meta.key, *self.meta.fields))
    listed = property(lambda self: self.meta.shape in ("flat", "double"))

    def identify(self, name: str | int, strict: bool = False) -> str:
        """The column that a name, a field's position or ':key' means."""
        if name == KEY:
            return self.key
        if isinstance(name, int):
            return self.fields[name]
        found = find_name(self.all_fields, name, strict)
        if found is None:
            raise UnknownField(f"{name!r} is none of {self.all_fields}")
        return found

    def has(self, name: str) -> bool:
        return find_name(self.all_fields, name) is not None

    def with_df(self, df: DataFrame, **changes) -> KeyedTable:
        return KeyedTable(df, replace(self.meta, **{k: tuple(v) if k == "fields" else v for k, v in changes.items()}))

    def identified_by(self, *tables: KeyedTable) -> KeyedTable:
        """The table with mapping tables, through which attach() finds rows in other namings."""
        return self.with_df(self.df, identifiers=(*self.meta.identifiers, *tables))

    def public(self) -> DataFrame:
        """Key and fields, without the order."""
        return self.df.select(*map(quoted, self.all_fields))


def quoted(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_namespace(path: str, namespace: str | None) -> str:
    """A path with its NAMESPACE or [NAMESPACE] filled in."""
    return re.sub(r"\[NAMESPACE\]|NAMESPACE", lambda _: namespace, path) if namespace else path


def keyed(df: DataFrame, key: str, fields: Sequence[str] | None = None, shape: str = "list", order: Column | str | None = None, **meta) -> KeyedTable:
    """A table of df's columns. order: a column or expression that orders rows; without it rows are
    taken as the reader deals them."""
    if shape not in SHAPES:
        raise ValueError(f"{shape!r} is no shape")
    fields = tuple(fields) if fields is not None else tuple(c for c in df.columns if c not in (key, ORD))
    if order is None:
        order = quoted(ORD) if ORD in df.columns else F.monotonically_increasing_id()
    order = quoted(order) if isinstance(order, str) else order
    return KeyedTable(df.select(*map(quoted, (key, *fields)), order.alias(ORD)), Meta(key, fields, shape, **meta))
