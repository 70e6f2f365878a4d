"""Delimited text with a header, and CSV, as keyed tables.

A file may begin with `#: option=value#option=value` lines, then `#`-lines of which the last is the header.
Only the first lines are read by the driver; everything else is a projection of spark.read.text, so
compressed files and any Hadoop file system work; block-gzip files and archives are read by their blocks and members.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import cast_cell, join_cell, literal_pattern, split_cell
from ..model import ORD, KeyedTable, Meta, find_name, quoted
from ..operators.aggregate import merge_by_key
from ..operators.reshape import reorder, to_shape
from . import blocks



@dataclass
class Header:
    key: str | None
    fields: list[str]
    options: dict[str, str] = field(default_factory=dict)
    preamble: list[str] = field(default_factory=list)
    lines: int = 0


def _option(value: str) -> str:
    return value.strip().removeprefix(":").strip('"')


def parse_options(line: str) -> dict[str, str]:
    """'#: :sep=/\\s+/#:type=:double' as a dict."""
    parts = re.findall(r":?(\w+)=((?:/[^/]*/|\"[^\"]*\"|[^#])*)", line[2:])
    return {k: _option(v) for k, v in parts}


def parse_header(lines: Sequence[str], sep: str = "\t", mark: str = "#") -> Header:
    options: dict[str, str] = {}
    n = 0
    if lines and lines[0].startswith("#:"):
        options, n = parse_options(lines[0]), 1
    sep = options.get("sep", sep)
    if mark == "":
        names = re.split(_python(sep), lines[n]) if n < len(lines) else []
        return Header(names[0] if names else None, names[1:], options, [], n + 1)
    marked = []
    while n < len(lines) and lines[n].startswith(mark):
        marked.append(lines[n].removeprefix(mark))
        n += 1
    if not marked:
        return Header(None, [], options, [], n)
    names = re.split(_python(sep), marked[-1].strip() if sep.startswith("/") else marked[-1])
    return Header(names[0], names[1:], options, marked[:-1], n)


def _python(sep: str) -> str:
    return sep[1:-1] if len(sep) > 2 and sep[0] == sep[-1] == "/" else re.escape(sep)


def split_row(line: Column, sep: str) -> Column:
    return F.split(line, literal_pattern(sep), -1)


def parse_lines(
    lines: DataFrame, header: Header, sep: str = "\t", sep2: str = "|", shape: str = "double", key_field: str | int | None = None,
    fields: Sequence[str | int] | str | None = None, merge: bool = True, one2one: bool = False, cast: str | Callable | None = None, select: Callable[[Column], Column] | None = None,
) -> KeyedTable:
    """lines: value and ORD. A table of the lines' cells; keys with several elements give a row each."""
    sep, shape = header.options.get("sep", sep), shape
    physical = header.options.get("type", shape)
    cast = cast or header.options.get("cast")
    body = lines.filter(F.col("value") != "")
    if select is not None:
        body = body.filter(select(F.col("value")))
    cells = split_row(F.trim("value") if sep.startswith("/") else F.col("value"), sep)
    if header.key is None:
        width = body.select(F.max(F.size(cells))).first()[0] or 1
        names = [f"column{i}" for i in range(width)]
    else:
        names = [header.key, *header.fields]
    flat = physical == "flat"
    columns = {n: F.coalesce(F.get(cells, F.lit(i)), F.lit(None)) for i, n in enumerate(names)}
    key = names[0]
    if flat:
        values = F.filter(F.flatten(F.transform(F.slice(cells, F.lit(2), F.size(cells)), lambda c: split_cell(c, sep2))), lambda v: v.isNotNull())
        name = names[1] if len(names) > 1 else "values"
        parsed = body.select(columns[key].alias(key), values.alias(name), ORD)
        meta = Meta(key, (name,), "flat")
    else:
        listed = physical == "double"
        parsed = body.select(columns[key].alias(key), *[(split_cell(columns[n], sep2) if listed else columns[n]).alias(n) for n in names[1:]], ORD)
        meta = Meta(key, tuple(names[1:]), physical)
        if physical == "single":
            parsed, meta = parsed.select(quoted(key), quoted(names[1]), ORD), Meta(key, (names[1],), "single")
    # Elements of the key, without trailing empty ones; an empty key gives no row.
    if listed_key := (physical in ("flat", "double")):
        keys = F.split(F.regexp_replace(quoted(key), f"(?:{literal_pattern(sep2)})+$", ""), literal_pattern(sep2), -1)
        parsed = parsed.select(F.posexplode(F.filter(keys, lambda k: k != "")).alias("__at", "__key"), *map(quoted, meta.fields), ORD)
        pick = (lambda f: F.array(F.coalesce(F.get(quoted(f), F.col("__at")), F.get(quoted(f), F.lit(0))))) if one2one else quoted
        parsed = parsed.select(F.col("__key").alias(key), *[pick(f).alias(f) for f in meta.fields], ORD)
    else:
        parsed = parsed.filter(quoted(key) != "")
    t = KeyedTable(parsed, meta)
    if cast:
        t = t.with_df(t.df.withColumns({f: cast_cell(quoted(f), cast, listed_key) for f in t.fields}))
    t = to_shape(t, shape) if t.shape != shape else t
    if key_field is not None and t.identify(key_field) != t.key:
        return reorder(t, key_field, fields, one2one=one2one, merge=merge)
    if fields is not None and fields != "all":
        chosen = [t.identify(f) for f in fields]
        t = t.with_df(t.df.select(quoted(t.key), *map(quoted, chosen), ORD), fields=chosen)
    return merge_by_key(t, one2one=one2one, merge=merge)


def _in_blocks(path: str | Sequence[str]) -> bool:
    return any(p.endswith((".bgz", ".zip")) for p in ([path] if isinstance(path, str) else path))


def _raw_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, file and place. Block-gzip files (.bgz) and archives (.zip) are read by their blocks and members."""
    paths = [path] if isinstance(path, str) else list(path)
    if _in_blocks(path):
        spark.dataSource.register(blocks.BlockLines)
        return spark.read.format("block_lines").option("paths", json.dumps(paths)).load()
    return spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value and ORD; the order of lines within a file is that of its splits."""
    return _raw_lines(spark, path).select("value", F.struct("file", F.col("place").alias("line")).alias(ORD))


def first_lines(spark: SparkSession, path: str, sep: str = "\t", header_mark: str = "#") -> tuple[list[str], Header]:
    """The header with all its lines, and with body lines after it if there are any. A dump's header is a file of its own."""
    from .store import exists

    if "*" not in path and exists(spark, f"{path}/header-00000.txt"):
        path = f"{path}/header-00000.txt"
    n = 64
    while True:
        lines = blocks.first_lines([path] if isinstance(path, str) else list(path), n) if _in_blocks(path) else [r[0] for r in spark.read.text(path).limit(n).collect()]
        header = parse_header(lines, sep, header_mark)
        if header.lines < len(lines) or len(lines) < n:
            return lines, header
        n *= 4


def fix_lines(lines: DataFrame, change: Callable[[Column], Column] | bool = True, stop: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines (value and ORD) with each value changed; a null goes. True repairs invalid UTF-8. stop: the first
    line that meets it goes, and so do all after it."""
    if stop is not None:
        end = lines.filter(stop(F.col("value"))).agg(F.min(ORD).alias("__end"))  # one row
        lines = lines.join(F.broadcast(end), F.col("__end").isNull() | (F.col(ORD) < F.col("__end"))).drop("__end")
    change = F.make_valid_utf8 if change is True else change
    return lines.withColumn("value", change(F.col("value"))).filter("value is not null")


def process_body(spark: SparkSession, path: str, change: Callable[[Column], Column], header_mark: str = "#") -> tuple[list[str], DataFrame]:
    """The header's lines as they are, and the body's lines (value and ORD) changed."""
    lines, header = first_lines(spark, path, header_mark=header_mark)
    body = read_lines(spark, path).filter(~F.startswith("value", F.lit(header_mark)))
    return lines[: header.lines], fix_lines(body, change)


def sibling_identifiers(spark: SparkSession, path: str, sep: str = "\t") -> tuple[KeyedTable, ...]:
    """The table `identifiers` in the folder of a file or dump, if there is one."""
    from .store import exists

    beside = path.rstrip("/").rpartition("/")[0] + "/identifiers"
    if not exists(spark, beside):
        return ()
    return (read_dump(spark, beside, sep) if exists(spark, f"{beside}/header-00000.txt") else read_tsv(spark, beside, sep),)


def read_tsv(
    spark: SparkSession, path: str, sep: str = "\t", header_mark: str = "#", grep: str | None = None, invert_grep: bool = False, fixed: bool = False, head: int | None = None, field: str | None = None,
    fix: Callable[[Column], Column] | bool = False, stop: Callable[[Column], Column] | None = None, identifiers: bool = False, **options
) -> KeyedTable:
    """A table from delimited text. grep: body lines that match (a pattern, or fixed text). head: the
    first n body lines. field: that field alone, as a `single` table. fix and stop: see fix_lines. identifiers:
    the table so named in the same folder comes with it."""
    if identifiers:
        t = read_tsv(spark, path, sep, header_mark, grep, invert_grep, fixed, head, field, fix, stop, **options)
        return t.identified_by(*sibling_identifiers(spark, path, sep))
    first, header = first_lines(spark, path, sep, header_mark)
    lines = read_lines(spark, path)
    if header_mark == "":
        # The header is the first line, by its text and place.
        lines = lines.filter((F.col("value") != first[header.lines - 1]) | (F.col(ORD)["line"] > 0))
    lines = lines.filter(~F.startswith("value", F.lit("#"))) if header_mark else lines
    if grep is not None:
        found = F.contains("value", F.lit(grep)) if fixed else F.col("value").rlike(grep)
        lines = lines.filter(~found if invert_grep else found)
    if fix or stop is not None:
        lines = fix_lines(lines, fix or (lambda v: v), stop)
    if head is not None:
        lines = lines.orderBy(ORD).limit(head)
    if field is not None:
        options = {"shape": "single", "fields": [field]} | options
        shape, fields = options.pop("shape"), options.pop("fields")
        full = parse_lines(lines, header, sep, shape="double" if header.options.get("type", "double") == "double" else "list", fields=fields, **options)
        return to_shape(full, shape)
    return parse_lines(lines, header, sep, **options)


def all_fields(spark: SparkSession, path: str, sep: str = "\t", header_mark: str = "#") -> list[str]:
    _, header = first_lines(spark, path, sep, header_mark)
    return [header.key, *header.fields] if header.key else []


def from_text(spark: SparkSession, text: str, sep: str = "\t", header_mark: str = "#", **options) -> KeyedTable:
    """A table from text in hand, for small tables and tests."""
    lines = text.strip("\n").split("\n")
    header = parse_header(lines, sep, header_mark)
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(lines[header.lines :])], f"value string, {ORD} long")
    return parse_lines(rows, header, sep, **options)


def from_spec(spark: SparkSession, rows: dict | Sequence, spec: str) -> KeyedTable:
    """Rows in hand under a spec 'ID~FieldA,FieldB#:type=:list'."""
    names, _, options = spec.partition("#")
    key, _, fields = names.partition("~")
    names, shape = [f for f in fields.split(",") if f], parse_options("#" + ":" + options.removeprefix(":")).get("type", "list") if options else "list"
    items = rows.items() if isinstance(rows, dict) else [(r[0], r[1:]) for r in rows]
    cell = "array<string>" if shape in ("flat", "double") else "string"
    as_row = lambda v: [v] if shape in ("single", "flat") else list(v)
    data = [(k, *as_row(v), i) for i, (k, v) in enumerate(items)]
    schema = ", ".join([f"`{key}` string", *[f"`{n}` {cell}" for n in names], f"{ORD} long"])
    return KeyedTable(spark.createDataFrame(data, schema), Meta(key, tuple(names), shape))


def read_csv(spark: SparkSession, path: str, headers: bool = True, shape: str = "list", key_field: str | None = None, fields: Sequence[str] | None = None, cast: str | None = None, merge: bool = False) -> KeyedTable:
    """CSV by Spark's reader. Without headers the whole row is kept under the key 'row-i'."""
    df = spark.read.csv(path, header=headers, inferSchema=False)
    df = df.withColumn(ORD, F.monotonically_increasing_id())
    names = [c for c in df.columns if c != ORD]
    if headers:
        key = find_name(names, key_field) if key_field else names[0]
        others = [f for f in names if f != key] if fields is None else [find_name(names, f) for f in fields]
        t = KeyedTable(df.select(quoted(key), *map(quoted, others), ORD), Meta(key, tuple(others), "list"))
    else:
        t = KeyedTable(df.select(F.concat(F.lit("row-"), quoted(ORD).cast("string")).alias("row"), *map(quoted, names), ORD), Meta("row", tuple(names), "list"))
    if cast:
        t = t.with_df(t.df.withColumns({f: cast_cell(quoted(f), cast, False) for f in t.fields}))
    t = to_shape(t, shape)
    return merge_by_key(t) if merge else t


def dump_lines(t: KeyedTable, sep: str = "\t", sep2: str = "|", unmerge: bool | str = False, compact: bool = False) -> DataFrame:
    """One column, the body's lines. unmerge: a line a replicate ("expand": lists of one repeat)."""
    if unmerge and t.listed:
        cells = [quoted(f) for f in t.fields]
        if unmerge == "expand":
            longest = F.greatest(*[F.size(c) for c in cells], F.lit(0)) if len(cells) > 1 else F.size(cells[0])
            cells = [F.when(F.size(c) == 1, F.array_repeat(F.get(c, F.lit(0)), longest)).otherwise(c) for c in cells]
        rows = t.df.select(quoted(t.key).alias("__k"), F.explode(F.arrays_zip(*[c.alias(f"f{i}") for i, c in enumerate(cells)])).alias("r"))
        parts = [F.coalesce(F.col("r")[f"f{i}"], F.lit("")) for i in range(len(t.fields))]
        return rows.select(F.concat_ws(sep, F.col("__k").cast("string"), *parts).alias("value"))
    text = lambda c: join_cell(F.array_compact(c) if compact else c, sep2) if t.listed else F.coalesce(c.cast("string"), F.lit(""))
    cells = [F.coalesce(text(quoted(f)), F.lit("")) for f in t.fields]
    return t.df.select(F.concat_ws(sep, quoted(t.key).cast("string"), *cells).alias("value"))


def header_lines(t: KeyedTable, sep: str = "\t") -> list[str]:
    return [f"#: :type=:{t.shape}", "#" + sep.join(t.all_fields)]


def write_tsv(t: KeyedTable, path: str, sep: str = "\t", **options) -> None:
    """Body parts in a folder, and the header as a file of its own that sorts first."""
    spark = t.df.sparkSession
    dump_lines(t, sep, **options).write.text(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/header-00000.txt")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(("\n".join(header_lines(t, sep)) + "\n").encode()))
    out.close()


def read_dump(spark: SparkSession, path: str, sep: str = "\t", **options) -> KeyedTable:
    """What write_tsv wrote."""
    first = [r[0] for r in spark.read.text(f"{path}/header-00000.txt").collect()]  # two lines
    header = parse_header(first, sep)
    return parse_lines(read_lines(spark, f"{path}/part-*"), header, sep, **({"shape": header.options.get("type", "double")} | options))
