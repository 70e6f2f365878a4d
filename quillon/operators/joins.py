"""Joins of keyed tables: attach, paste, value indexes and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import append_new, empty_list, first_filled, in_order_once, part
from ..model import ORD, KeyedTable, Meta, UnknownField, find_name, keyed, quoted, same_name
from .aggregate import merge_by_key
from .reshape import reorder, slice_fields, to_shape

#: Rows of either side that meet in one cell of join_in_cells().
ROWS_PER_CELL = 1024


def match_keys(source: KeyedTable, other: KeyedTable, match_key: str | None = None, other_key: str | None = None) -> tuple[str, str]:
    """The columns that two tables are joined by: as named, else the other's key if source has it, else
    source's key if the other has it, else the first shared name."""
    if match_key is not None and other_key is not None:
        return source.identify(match_key), other.identify(other_key)
    if match_key is not None:
        name = source.identify(match_key)
        return name, find_name(other.all_fields, name) or other.key
    if other_key is not None:
        name = other.identify(other_key)
        return find_name(source.all_fields, name) or source.key, name
    if same_name(source.key, other.key):
        return source.key, other.key
    for name in source.all_fields:
        if found := find_name(other.all_fields, name):
            return name, found
    raise UnknownField(f"{source.all_fields} and {other.all_fields} share no name")


def _through_identifiers(source: KeyedTable, other: KeyedTable, match_key: str | None, other_key: str | None) -> DataFrame | None:
    """An index from source's naming to other's if the tables share no name; None if they do, or no table leads over."""
    from .translate import NoPath, translation_index

    known = (*source.meta.identifiers, *other.meta.identifiers)
    wanted = other.identify(other_key) if other_key else other.key
    if not known or source.has(wanted) or (match_key is None and other_key is None and any(other.has(f) for f in source.all_fields)):
        return None
    try:
        return translation_index([*known, source, other], source.identify(match_key) if match_key else source.key, wanted)
    except NoPath:
        return None


def _in_shape(cell: Column, source: str, other: str) -> Column:
    """A cell of another table in the shape of source: lists of one, or the first element."""
    if source in ("flat", "double"):
        return cell if other in ("flat", "double") else F.when(cell.isNull(), empty_list()).otherwise(F.array(cell.cast("string")))
    return F.get(cell, F.lit(0)) if other in ("flat", "double") else cell


def attach(
    source: KeyedTable, other: KeyedTable, fields: Sequence[str] | None = None, match_key: str | None = None, other_key: str | None = None,
    one2one: bool | str = True, complete: bool = False, index: DataFrame | None = None,
) -> KeyedTable:
    """source with fields of other, matched by key or by a column. A list-valued match column
    collects what all its elements match, in order, each row for itself. Without a common name the
    tables are joined through the identifier tables that either has, or through either itself. Cells that both have: in a `list` table the
    first filled one stays; in a `double` table what is new is appended; in a `flat` one everything.
    index (value, target; repeated pairs count once) maps source's match values to other's keys first. complete: keys
    that only other has get rows of their own (matching by source's key only)."""
    if source.shape == "single":
        source = source.with_df(source.df, shape="list")
    if index is None:
        index = _through_identifiers(source, other, match_key, other_key)
    if index is not None:
        match, key = source.identify(match_key) if match_key else source.key, other.identify(other_key) if other_key else other.key
    else:
        match, key = match_keys(source, other, match_key, other_key)
    wanted = [other.identify(f) for f in fields] if fields is not None else [f for f in (other.key, *other.fields) if f != key and not (f != other.key and same_name(f, match))]
    if key != other.key:
        other = reorder(other, key, wanted, one2one=one2one, shape="double" if other.listed else other.shape)
        wanted = list(other.fields)
    else:
        other = merge_by_key(slice_fields(other, [f for f in wanted if f != other.key]))
        wanted = list(other.fields)
    names = {f: find_name(source.all_fields, f, strict=True) for f in wanted}
    right = other.df.select(quoted(other.key).cast("string").alias("__m"), *[_in_shape(quoted(f), source.shape, other.shape).alias(f"__o{i}") for i, f in enumerate(wanted)], F.lit(True).alias("__hit"))
    if index is not None:
        mapped = index.select(F.col("value").cast("string").alias("__v"), F.col("target").cast("string").alias("__t"))
        right = mapped.join(right, F.col("__t") == F.col("__m")).select(F.col("__v").alias("__m"), "__t", *[f"__o{i}" for i in range(len(wanted))], "__hit")

    cells = [F.col(f"__o{i}") for i in range(len(wanted))]
    scalar = (match == source.key or not source.listed) and index is None
    if scalar:
        how = "full_outer" if complete and match == source.key else "left"
        joined = source.df.join(right, quoted(match).cast("string") == F.col("__m"), how)
        new = [F.array(c) if source.listed else c for c in cells]
    else:
        # The elements of the match column with their places, joined, and put together again by row. Keys and
        # orders may repeat; rows that are alike in both and in the match column have the same matches.
        values = F.array(quoted(match).cast("string")) if match == source.key or not source.listed else quoted(match)
        row = [quoted(source.key).alias("__k"), quoted(ORD).alias("__row"), F.xxhash64(values).alias("__same")]
        place = source.df.select(*row, F.posexplode(values).alias("__at", "__v"))
        tie = ["__t"] if index is not None else []
        hits = place.join(right, F.col("__v") == F.col("__m")).groupBy("__k", "__row", "__same").agg(in_order_once(F.struct("__at", *tie), cells).alias("__rows"))
        of = [a.eqNullSafe(F.col(b)) for a, b in ((quoted(source.key), "__k"), (quoted(ORD), "__row"), (F.xxhash64(values), "__same"))]
        joined = source.df.join(hits, reduce(lambda a, b: a & b, of), "left")
        new = [F.coalesce(part(F.col("__rows"), i), F.array().cast("array<array<string>>" if source.listed else "array<string>")) for i in range(len(wanted))]
        if not source.listed:
            new = [F.get(F.filter(c, lambda v: v.isNotNull() & (v.cast("string") != "")), F.lit(0)) for c in new]
            return _attached(source, joined, wanted, names, new, complete=False)
    return _attached(source, joined, wanted, names, new, complete and scalar and match == source.key)


def _attached(source: KeyedTable, joined: DataFrame, wanted: list[str], names: dict, new: list[Column], complete: bool) -> KeyedTable:
    """The joined rows with their cells merged. new: in a listed table an array of matches, each a list."""
    cells = {f: quoted(f) for f in source.fields}
    for f, found in zip(wanted, new, strict=True):
        own = names[f]
        if own == source.key:
            continue
        if not source.listed:
            cells[f] = first_filled(quoted(own), found) if own else found
        else:
            current = F.coalesce(quoted(own), empty_list()) if own else empty_list()
            matches = F.filter(found, lambda m: m.isNotNull())
            step = (lambda acc, m: F.concat(acc, m)) if source.shape == "flat" else append_new
            cells[f] = F.aggregate(matches, current, step)
    if source.listed:
        cells = {f: F.coalesce(c, empty_list()) for f, c in cells.items()}
    key = F.coalesce(quoted(source.key).cast("string"), F.col("__m")) if complete else quoted(source.key)
    df = joined.select(key.alias(source.key), *[c.alias(f) for f, c in cells.items()], ORD)
    return source.with_df(df, fields=list(cells))


def paste(tables: Sequence[KeyedTable], all_match: bool = False, same_fields: bool = False, one2one: bool = True, prefixes: Sequence[str] | None = None) -> KeyedTable:
    """An N-way outer join by key (all_match: inner). Missing cells are "" (or empty lists); rows of a
    repeated key are collapsed. same_fields: equal fields are joined as lists, and without
    one2one missing ones leave no trace. prefixes name each table's fields apart."""
    double = same_fields or any(t.listed for t in tables)
    parts, names = [], []
    for n, t in enumerate(tables):
        t = merge_by_key(to_shape(t, "double"), one2one=same_fields and one2one)
        own = list(tables[0].fields) if same_fields else [f"{prefixes[n]}:{f}" if prefixes else f for f in t.fields]
        parts.append(t.df.select(quoted(t.key).cast("string").alias("__k"), *[quoted(f).alias(f"__{n}_{i}") for i, f in enumerate(t.fields)]))
        names.append(own)
    joined = reduce(lambda a, b: a.join(b, "__k", "inner" if all_match else "full_outer"), parts)
    missing = F.array(F.lit(None).cast("string")) if same_fields and one2one else empty_list()
    cell = lambda n, i: F.coalesce(F.col(f"__{n}_{i}"), missing)
    if same_fields:
        columns = {f: F.concat(*[cell(n, i) for n in range(len(parts))]) for i, f in enumerate(names[0])}
        if not one2one:
            columns = {f: F.array_compact(c) for f, c in columns.items()}
    else:
        columns = {}
        for n, own in enumerate(names):
            for i, f in enumerate(own):
                taken = f.lower() in {c.lower() for c in columns}  # Spark's names don't tell cases apart
                columns[f"{f} ({n})" if taken else f] = cell(n, i)
    if not double:
        columns = {f: F.array_join(c, "|", "") for f, c in columns.items()}
    df = joined.select(F.col("__k").alias(tables[0].key), *[c.alias(f) for f, c in columns.items()], F.col("__k").alias(ORD))
    return KeyedTable(df, Meta(tables[0].key, tuple(columns), "double" if double else "list"))


def paste_stored(spark: SparkSession, names: Sequence[str], key: str, prefixes: Sequence[str] | None = None) -> DataFrame:
    """An N-way outer join of catalog tables that store.save_bucketed() wrote with one number of buckets and a row a key, without a shuffle of any. Rows come
    from the first table that has their key: each table without the keys of those before, joined to those after, all bucket by
    bucket; missing cells are null. Fields that have been are named with the table's number, or by its prefix."""
    tables, taken = [], {key}
    for n, name in enumerate(names):
        fields = [c for c in spark.table(name).columns if c not in (key, ORD)]
        named = [f"{prefixes[n]}:{f}" if prefixes else f"{f} ({n})" if f in taken else f for f in fields]
        taken.update(named)
        tables.append((name, dict(zip(fields, named, strict=True))))

    def rows(n: int) -> DataFrame:
        name, fields = tables[n]
        return spark.table(name).select(quoted(key).alias(f"__k{n}"), *[quoted(f).alias(as_) for f, as_ in fields.items()])

    out = []
    for n in range(len(tables)):
        part = rows(n)
        for m in [*range(n), *range(n + 1, len(tables))]:
            other = (rows(m).select(f"__k{m}") if m < n else rows(m)).hint("merge")
            part = part.join(other, F.col(f"__k{n}") == F.col(f"__k{m}"), "left_anti" if m < n else "left")
        of = dict(part.dtypes)
        cells = [quoted(c) if c in of else F.lit(None).cast(dict(rows(m).dtypes)[c]).alias(c) for m, (_, fields) in enumerate(tables) for c in fields.values()]
        out.append(part.select(F.col(f"__k{n}").alias(key), *cells))
    return reduce(DataFrame.unionByName, out)


def join_in_cells(left: DataFrame, right: DataFrame, on: Sequence[str], counts: DataFrame | None = None, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """The inner join by equal names, for keys that many rows of both sides share, so that there are far more pairs than rows. Either side's rows of a
    key are cut by their hash into parts of about rows_per_cell, and each part of one side meets each of the other in a cell of its own: tasks share out even a
    single key. The right rows of a cell are one list, as many as a task holds at a time. The keys of several parts, fewer than one in rows_per_cell rows, are broadcast.
    counts: on and __n, the left rows of each key, where something cheaper than left itself tells them. The sides have no other name in common."""
    own = [c for c in right.columns if c not in on]
    if not own:
        return left.join(right, list(on))

    def parts(counted: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.col("__n") / rows_per_cell).cast("int")
        return F.broadcast(counted.filter(F.col("__n") > rows_per_cell).select(*map(quoted, on), n.alias(name)))

    def count(df: DataFrame) -> DataFrame:
        return df.groupBy(*map(quoted, on)).agg(F.count("*").alias("__n"))

    many = parts(count(left) if counts is None else counts, "__left"), parts(count(right), "__right")
    cell, n = [*on, "__left", "__right"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, side: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*map(quoted, df.columns)), F.coalesce(side, F.lit(1))).cast("int")
        for counted in many:
            df = df.join(counted, list(on), "left")
        df = df.withColumn(side, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return df.repartition(n, *map(quoted, cell))  # a fixed number, else the sides, which are small, end up in one task

    lists = dealt(right, "__right", "__left").groupBy(*map(quoted, cell)).agg(F.collect_list(F.struct(*map(quoted, own))).alias("__rows"))
    return dealt(left, "__left", "__right").join(lists, cell).select(*map(quoted, left.columns), F.inline("__rows"))


def value_pairs(t: KeyedTable, target: str = ":key", fields: Sequence[str] | None = None) -> DataFrame:
    """value, target, position, order: what each value of the chosen columns points at. All columns,
    the target first, if none are named."""
    name = t.identify(target)
    chosen = [t.identify(f) for f in fields] if fields is not None else [name, *[f for f in t.all_fields if f != name]]
    as_list = lambda c: quoted(c).cast("array<string>") if t.listed and c != t.key else F.array(quoted(c).cast("string"))
    first = F.get(as_list(name), F.lit(0))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), as_list(c).alias("values")) for i, c in enumerate(chosen)]))
    rows = t.df.select(first.alias("target"), quoted(ORD).alias("order"), pairs.alias("p"))
    return rows.select(F.explode("p.values").alias("value"), "target", F.col("p.position").alias("position"), "order").filter("value is not null and value <> '' and target is not null")


def index(t: KeyedTable, target: str = ":key", fields: Sequence[str] | None = None, by_field: bool = True) -> DataFrame:
    """value, target: the first target of each value, in the order of fields and then of rows, or
    (by_field False) of rows alone."""
    rank = F.struct("position", "order") if by_field else F.struct("order", "position")
    return value_pairs(t, target, fields).groupBy("value").agg(F.min_by("target", rank).alias("target"))


def lookup(t: KeyedTable, probes: DataFrame, column: str) -> DataFrame:
    """probes with the fields of their key, nulls where there is none."""
    right = t.public().withColumnRenamed(t.key, "__k")
    return probes.join(right, quoted(column) == F.col("__k"), "left").drop("__k")


def as_table(df: DataFrame, key: str, **options) -> KeyedTable:
    return keyed(df, key, **options)
