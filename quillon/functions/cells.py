"""Expressions on scalar and list cells. All run inside Spark's own code generation or interpreter."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ORD, quoted

STRINGS = "array<string>"


def literal_pattern(sep: str) -> str:
    """A separator as a Java regular expression; /…/ is one already."""
    return sep[1:-1] if len(sep) > 2 and sep[0] == sep[-1] == "/" else "\\Q" + sep + "\\E"


def empty_list(of: str = "string") -> Column:
    return F.array().cast(f"array<{of}>")


def split_cell(cell: Column, sep: str = "|") -> Column:
    """The elements of a cell; the empty cell has none."""
    return F.when(cell == "", empty_list()).otherwise(F.split(cell, literal_pattern(sep), -1))


def join_cell(cell: Column, sep: str = "|") -> Column:
    return F.array_join(cell, sep, "")


def to_int(text: Column) -> Column:
    """The leading integer; 0 for other text, null for null and the empty text."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.when((text != ""), F.coalesce(F.when(number != "", number.try_cast("bigint")), F.lit(0)))


def to_float(text: Column) -> Column:
    """The leading number; 0.0 for other text, null for null and the empty text."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1)
    return F.when((text != ""), F.coalesce(F.when(number != "", number.try_cast("double")), F.lit(0.0)))


#: Casts by name, for scalars. Lists are cast element by element.
CASTS: dict[str, Callable[[Column], Column]] = {
    "to_i": to_int, "to_f": to_float, "to_s": lambda c: c.cast("string"), "to_sym": lambda c: c.cast("string"),
    "downcase": F.lower, "upcase": F.upper, "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2)))),
    "strip": F.trim, "length": lambda c: F.length(c).cast("bigint"), "reverse": F.reverse,
}


def cast_cell(cell: Column, cast: str | Callable[[Column], Column], listed: bool) -> Column:
    apply = CASTS[cast] if isinstance(cast, str) else cast
    return F.transform(cell, apply) if listed else apply(cell)


def padded(cell: Column) -> Column:
    """An empty list as one null, so that lists stay parallel when they are joined."""
    return F.when(F.size(cell) == 0, F.array(F.lit(None).cast("string"))).otherwise(cell)


def replicates(fields: Sequence[str]) -> Column:
    """An array of structs, one a replicate; short lists are padded with nulls."""
    return F.arrays_zip(*[quoted(f).alias(f"f{i}") for i, f in enumerate(fields)])


def in_order(fields: Sequence[Column]) -> Column:
    """Aggregate: the rows of a group in order, as structs of ORD and f0, f1, …"""
    return F.array_sort(F.collect_list(F.struct(quoted(ORD), *[f.alias(f"f{i}") for i, f in enumerate(fields)])))


def in_order_once(order: Column, fields: Sequence[Column]) -> Column:
    """in_order() by the given order, rows that are alike in all counting once."""
    return F.array_sort(F.collect_set(F.struct(order.alias(ORD), *[f.alias(f"f{i}") for i, f in enumerate(fields)])))


def part(rows: Column, i: int) -> Column:
    return F.transform(rows, lambda r: r[f"f{i}"])


def append_new(current: Column, new: Column) -> Column:
    """current, then what of new it doesn't hold; repeats inside new stay."""
    return F.concat(current, F.filter(new, lambda v: ~F.array_contains(current, v)))


def first_filled(*cells: Column) -> Column:
    """The first cell that is neither null nor empty text; else the first."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cells], cells[0])


def flat_values(fields: Sequence[str], listed: bool) -> Column:
    """All values of a row as one array of strings."""
    if listed:
        return F.flatten(F.array(*[F.coalesce(quoted(f).cast(STRINGS), empty_list()) for f in fields]))
    return F.array(*[quoted(f).cast("string") for f in fields])


def truthy(text: Column) -> Column:
    return F.coalesce((text != "") & (F.lower(text) != "false"), F.lit(False))


def says_true(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\btrue\b"), F.lit(False))


def sure(condition: Column) -> Column:
    """Null counts as false, so that the negation is what is left."""
    return F.coalesce(condition, F.lit(False))


def compare(value: Column, test: str) -> Column:
    """A test like '>=5' on a number."""
    m = re.fullmatch(r"\s*(<=|>=|<|>|=)\s*(-?[\d.]+)\s*", test)
    if m is None:
        raise ValueError(f"{test!r} is no comparison")
    n = F.lit(float(m[2]))
    return {"<": value < n, "<=": value <= n, ">": value > n, ">=": value >= n, "=": value == n}[m[1]]


def is_comparison(test: object) -> bool:
    return isinstance(test, str) and re.fullmatch(r"\s*(<=|>=|<|>)\s*-?[\d.]+\s*", test) is not None


def decode_array(text: Column) -> Column:
    """'Array:a|b' as a list; other text as a list of one."""
    return F.when(F.startswith(text, F.lit("Array:")), split_cell(F.substr(text, F.lit(7)))).otherwise(F.array(text))


def encode_array(cell: Column) -> Column:
    return F.concat(F.lit("Array:"), join_cell(cell))
