"""Projections, re-keying and reshaping of keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import STRINGS, cast_cell, empty_list, in_order, part, replicates
from ..model import KEY, ORD, KeyedTable, quoted
from .aggregate import merge_by_key


def to_shape(t: KeyedTable, shape: str) -> KeyedTable:
    """A table of another shape: first elements for scalars, lists of one for lists."""
    if shape == t.shape:
        return t
    cells, fields = [quoted(f) for f in t.fields], t.fields
    if shape == "single":
        fields, cells = fields[:1], [F.get(cells[0], F.lit(0)) if t.listed else cells[0]]
    elif shape == "list":
        cells = [F.get(c, F.lit(0)) if t.listed else c for c in cells]
    elif shape == "flat":
        cells = [F.flatten(F.array(*[F.coalesce(c, empty_list()) for c in cells])) if t.listed else F.array(*cells)]
        fields = fields[:1] or ("values",)
    elif not t.listed:
        cells = [F.when(c.isNull(), empty_list()).otherwise(F.array(c.cast("string"))) for c in cells]
    return t.with_df(t.df.select(quoted(t.key), *[c.alias(f) for c, f in zip(cells, fields, strict=True)], ORD), fields=fields, shape=shape)


def slice_fields(t: KeyedTable, fields: Sequence[str | int]) -> KeyedTable:
    names = [t.identify(f) for f in fields]
    return t.with_df(t.df.select(quoted(t.key), *map(quoted, names), ORD), fields=names)


def column(t: KeyedTable, field: str | int, cast: str | Callable[[Column], Column] | None = None) -> KeyedTable:
    out = slice_fields(t, [field])
    if cast is not None:
        out = process(out, out.fields[0], lambda c: cast_cell(c, cast, t.listed))
    return out.with_df(out.df, shape="flat" if t.listed else "single")


def cast_fields(t: KeyedTable, cast: str | Callable[[Column], Column], fields: Sequence[str] | None = None) -> KeyedTable:
    chosen = {t.identify(f) for f in fields} if fields is not None else set(t.fields)
    return t.with_df(t.df.withColumns({f: cast_cell(quoted(f), cast, t.listed) for f in t.fields if f in chosen}))


def process(t: KeyedTable, field: str, change: Callable[[Column], Column]) -> KeyedTable:
    name = t.identify(field)
    return t.with_df(t.df.withColumn(name, change(quoted(name))))


def add_field(t: KeyedTable, name: str, value: Column) -> KeyedTable:
    """A new last field. In a `double` table a scalar becomes a list of one and null the empty list."""
    df = t.df.withColumn(name, value)
    if t.listed and not df.schema[name].dataType.typeName() == "array":
        df = df.withColumn(name, F.when(quoted(name).isNull(), empty_list()).otherwise(F.array(quoted(name).cast("string"))))
    return t.with_df(df.select(quoted(t.key), *map(quoted, t.fields), quoted(name), ORD), fields=(*t.fields, name))


def traverse(t: KeyedTable, make: Callable[[dict[str, Column]], Column], name: str = "result", many: bool = False) -> DataFrame:
    """Key and result of each row: make gets the columns by name. A null drops the row; many: an array gives a row an element."""
    made = t.df.select(quoted(t.key), make({c: quoted(c) for c in t.all_fields}).alias(name))
    return made.select(quoted(t.key), F.explode(name).alias(name)).filter(quoted(name).isNotNull()) if many else made.filter(quoted(name).isNotNull())


def rename(t: KeyedTable, names: dict[str, str]) -> KeyedTable:
    new = {c: names.get(c, c) for c in t.all_fields}
    return t.with_df(t.df.select(*[quoted(c).alias(n) for c, n in new.items()], ORD), key=new[t.key], fields=[new[f] for f in t.fields])


def reorder(
    t: KeyedTable, key: str | int = KEY, fields: Sequence[str | int] | str | None = None, one2one: bool | str = True, merge: bool = True, uniq: bool = False, shape: str | None = None
) -> KeyedTable:
    """Re-key by a column and project. fields None: the old key first, then the others; "all": every
    column. A list-valued key gives a row an element; the cells that go with element i are
    whole lists (one2one False), element i or else the first (True), or element i or null ("strict"). Of several fields
    a `flat` table has all values in one list, and a `single` one the first. Rows of one new key merge as merge_by_key does."""
    new, shape = t.identify(key), shape or t.shape
    if fields == "all":
        names = list(t.all_fields)
    elif fields is None:
        names = list(t.fields) if new == t.key else [t.key, *[f for f in t.fields if f != new]]
    else:
        names = [t.identify(f) for f in fields]
    listed_key, asked = t.listed and new != t.key, shape
    if len(names) > 1:  # one cell of several fields is made of them at the end
        shape = {"flat": "double", "single": "list"}.get(shape, shape)
    if t.shape == "flat" and listed_key:
        df = t.df.select(F.explode(F.array_distinct(quoted(new)) if uniq else quoted(new)).alias("__key"), F.array(quoted(t.key)).alias(t.key), ORD)
        return merge_by_key(t.with_df(df.withColumnRenamed("__key", new).select(quoted(new), quoted(t.key), ORD), key=new, fields=[t.key]), merge=merge)
    as_list = lambda n: F.array(quoted(n).cast("string")) if n == t.key and t.listed else quoted(n)
    df = t.df.select(*([F.posexplode(F.array_distinct(quoted(new)) if uniq else quoted(new)).alias("__at", "__key")] if listed_key else [F.lit(0).alias("__at"), quoted(new).alias("__key")]), *[as_list(n).alias(f"__c{i}") for i, n in enumerate(names)], ORD)

    def cell(i: int, name: str) -> Column:
        c = F.col(f"__c{i}")
        if not listed_key or not t.listed:
            return c if t.listed == (shape in ("flat", "double")) else (F.get(c, F.lit(0)) if t.listed else F.array(c))
        own = F.get(c, F.col("__at"))
        if name == t.key:
            return c if shape in ("flat", "double") else F.get(c, F.lit(0))
        if one2one == "strict" or (not one2one and asked == "list"):
            return F.array(own) if shape in ("flat", "double") else own
        if one2one:
            own = F.coalesce(own, F.get(c, F.lit(0)))
            return F.array(own) if shape in ("flat", "double") else own
        return c if shape in ("flat", "double") else F.get(c, F.lit(0))

    df = df.filter(F.col("__key").isNotNull() & (F.col("__key").cast("string") != ""))
    order = F.struct(quoted(ORD).alias("o"), F.col("__at").alias("i")).alias(ORD)
    named = [cell(i, n).alias(n if n != new or fields == "all" else n) for i, n in enumerate(names)]
    key_name = new if new not in names else f"{new} (key)"
    out = t.with_df(df.select(F.col("__key").alias(key_name), *named, order), key=key_name, fields=names, shape=shape)
    return merge_by_key(to_shape(out, asked), merge=merge)


def change_key(t: KeyedTable, key: str, keep: bool = False, one2one: bool | str = False, merge: bool = True) -> KeyedTable:
    """Re-key by an own column. keep: the old key stays as the first field."""
    fields = [f for f in t.fields if f != t.identify(key)]
    return reorder(t, key, ([t.key] if keep else []) + fields, one2one=one2one, merge=merge)


def unzip(t: KeyedTable, field: str, sep: str = ":", delete: bool = True, merge: bool = False) -> KeyedTable:
    """A row a replicate, keyed 'key:value' by the field's value; merge: replicates of one new key as lists."""
    name = t.identify(field)
    rest = [f for f in t.fields if f != name or not delete]
    order = [name, *[f for f in t.fields if f != name]]
    df = t.df.select(quoted(t.key), F.posexplode(replicates(order)).alias("__at", "__r"), ORD)
    of = {f: F.col("__r")[f"f{i}"] for i, f in enumerate(order)}
    key = f"{t.key}:{name}"
    cells = [(F.array(of[f]) if merge else of[f]).alias(f) for f in rest]
    df = df.select(F.concat_ws(sep, quoted(t.key), of[name]).alias(key), *cells, F.struct(quoted(ORD).alias("o"), F.col("__at").alias("i")).alias(ORD))
    return merge_by_key(t.with_df(df, key=key, fields=rest, shape="double" if merge else "list"))


def unzip_replicates(t: KeyedTable) -> KeyedTable:
    """A row a replicate, keyed 'key(i)'."""
    df = t.df.select(quoted(t.key).alias("__key"), F.posexplode(replicates(t.fields)).alias("__at", "__r"), ORD)
    key = F.concat(F.col("__key"), F.lit("("), F.col("__at").cast("string"), F.lit(")"))
    return t.with_df(df.select(key.alias(t.key), *[F.col("__r")[f"f{i}"].alias(f) for i, f in enumerate(t.fields)], F.struct(quoted(ORD).alias("o"), F.col("__at").alias("i")).alias(ORD)), shape="list")


def zip_key(t: KeyedTable, field: str, sep: str = ":", merge: bool = True) -> KeyedTable:
    """The inverse of unzip: the key's tail becomes the first field again."""
    parts = F.split(quoted(t.key), f"\\Q{sep}\\E", 2)
    as_list = (lambda c: c) if t.listed else (lambda c: F.array(c.cast("string")))
    first = quoted(t.fields[0]) if t.fields else F.array(F.lit(""))
    tail = F.array_repeat(F.get(parts, F.lit(1)), F.size(first)) if t.listed else F.array(F.get(parts, F.lit(1)))
    key = t.key.split(sep)[0]
    df = t.df.select(F.get(parts, F.lit(0)).alias(key), tail.alias(field), *[as_list(quoted(f)).alias(f) for f in t.fields], ORD)
    return merge_by_key(t.with_df(df, key=key, fields=[field, *t.fields], shape="double"), merge=merge)


def remove_duplicates(t: KeyedTable) -> KeyedTable:
    """Distinct replicates of each row, in order."""
    df = t.df.withColumn("__r", F.array_distinct(replicates(t.fields)))
    return t.with_df(df.select(quoted(t.key), *[part(F.col("__r"), i).alias(f) for i, f in enumerate(t.fields)], ORD))


def melt(t: KeyedTable, value: str, column: str) -> KeyedTable:
    """A row a cell, keyed 'key:i'; fields: old key, value, column name."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("n"), quoted(f).cast(STRINGS if t.listed else "string").alias("v")) for i, f in enumerate(t.fields)])
    df = t.df.select(quoted(t.key).cast("string").alias("__k"), F.explode(cells).alias("c"), quoted(ORD).alias("__o"))
    key = F.concat_ws(":", "__k", F.col("c.i").cast("string"))
    return t.with_df(df.select(key.alias("ID"), F.col("__k").alias(t.key), F.col("c.v").alias(value), F.col("c.n").alias(column), F.struct(F.col("__o").alias("o"), F.col("c.i").alias("i")).alias(ORD)), key="ID", fields=[t.key, value, column], shape="list")


def transpose(t: KeyedTable, key: str, keys: Sequence[str] | None = None) -> KeyedTable:
    """Fields become rows, keys become columns. keys: the columns, if known; else Spark looks them up
    (as many as a pivot may have)."""
    long = melt(t, "__value", "__column").df
    pivot = long.groupBy(F.col("__column").alias(key)).pivot(t.key, list(keys) if keys is not None else None).agg(F.first("__value"))
    place = F.create_map(*[x for i, f in enumerate(t.fields) for x in (F.lit(f), F.lit(i))])
    columns = [c for c in pivot.columns if c != key]
    return t.with_df(pivot.withColumn(ORD, place[quoted(key)]), key=key, fields=columns)


def group_rows(t: KeyedTable, by: Column, name: str) -> KeyedTable:
    """Rows of a computed key as lists, in row order."""
    df = t.df.groupBy(by.alias(name)).agg(in_order([quoted(c).cast("string") for c in t.all_fields]).alias("__rows"))
    return t.with_df(df.select(quoted(name), *[part(F.col("__rows"), i).alias(c) for i, c in enumerate(t.all_fields)], F.col("__rows")[0][ORD].alias(ORD)), key=name, fields=t.all_fields, shape="double")
