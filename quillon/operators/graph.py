"""Binary relations as edge tables: source, target and info columns."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import replicates
from ..model import ORD, KeyedTable, quoted
from ..sources import clustered
from ..sources.store import write_text
from .translate import translation_index


def field_spec(spec: str | None) -> tuple[str | None, str | None, str | None]:
    """'Field=~Header=>Format' in its parts, each of which may be missing."""
    if not spec:
        return None, None, None
    m = re.fullmatch(r"(?P<field>.*?)(?:=~(?P<header>.*?))?(?:=>(?P<format>.*))?", spec)
    return tuple(m[k] or None for k in ("field", "header", "format"))


def end_fields(t: KeyedTable, source: str | None, target: str | None) -> tuple[str, str]:
    """The columns of both ends: as named, else the key and the first field, or what is left of them."""
    first = t.identify(source) if source else None
    second = t.identify(target) if target else None
    if first is None:
        first = t.key if second != t.key else t.fields[0]
    if second is None:
        second = next(f for f in t.all_fields[1:] if f != first) if first == t.key else t.key
    return first, second


def edges(
    t: KeyedTable, source: str | None = None, target: str | None = None, info: Sequence[str] | None = None,
    undirected: bool | None = None, multi: bool = False, identifiers: Sequence[KeyedTable] = (),
) -> DataFrame:
    """source, target and info columns of a table, an edge a replicate. The specs may name formats, to
    which the ends are translated; an end without translation drops its edge. Edges without one
    of their ends go; of equal pairs the last stays, unless multi. undirected (by default if
    both ends are one column): each edge also reversed."""
    (s, s_name, s_format), (g, g_name, g_format) = field_spec(source), field_spec(target)
    first, second = end_fields(t, s, g)
    names = [t.identify(f) for f in info] if info is not None else [f for f in t.all_fields if f not in (first, second)]
    columns = list(dict.fromkeys([first, second, *names]))
    if t.listed:
        lists = [c for c in columns if c != t.key]
        rows = t.df.select(quoted(t.key).cast("string").alias("__k"), F.posexplode(replicates(lists)).alias("__at", "__r"), quoted(ORD).alias("__o"))
        of = {c: F.col("__k") if c == t.key else F.col("__r")[f"f{lists.index(c)}"] for c in columns}
        rows = rows.select(of[first].alias("source"), of[second].alias("target"), *[of[n].alias(n) for n in names], F.struct("__o", "__at").alias(ORD))
    else:
        rows = t.df.select(quoted(first).cast("string").alias("source"), quoted(second).cast("string").alias("target"), *[quoted(n) for n in names], ORD)
    rows = rows.filter("source is not null and source <> '' and target is not null and target <> ''")
    for end, name, wanted in (("source", s_name or first, s_format), ("target", g_name or second, g_format)):
        if wanted:
            found = translation_index(identifiers, name, wanted).withColumnsRenamed({"value": "__v", "target": "__t"})
            rows = rows.join(found, F.col(end) == F.col("__v")).withColumn(end, F.col("__t")).drop("__v", "__t")
    if not multi:
        row = F.struct(*[quoted(n) for n in names]) if names else F.lit(True)
        last = rows.groupBy("source", "target").agg(F.max_by(row, quoted(ORD)).alias("__row"), F.max(ORD).alias(ORD))
        rows = last.select("source", "target", *[F.col("__row")[n].alias(n) for n in names], ORD)
    out = rows.drop(ORD)
    return undirected_closure(out) if (first == second if undirected is None else undirected) else out


def reverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("target").alias("source"), F.col("source").alias("target"), *[quoted(c) for c in e.columns if c not in ("source", "target")])


def undirected_closure(e: DataFrame) -> DataFrame:
    return e.unionByName(reverse(e)).dropDuplicates(["source", "target"])


def pair_names(e: DataFrame, sep: str = "~") -> DataFrame:
    return e.withColumn("pair", F.concat_ws(sep, "source", "target"))


def split_pairs(df: DataFrame, column: str = "pair", sep: str = "~") -> DataFrame:
    parts = F.split(quoted(column), f"\\Q{sep}\\E", 2)
    return df.withColumns({"source": F.get(parts, F.lit(0)), "target": F.get(parts, F.lit(1))})


def _among(e: DataFrame, end: str, entities: DataFrame | Sequence[str] | str) -> DataFrame:
    if isinstance(entities, DataFrame):
        wanted = entities.select(F.col(entities.columns[0]).cast("string").alias("__e")).distinct()
        return e.join(wanted, F.col(end) == F.col("__e"), "left_semi")
    return e.filter(F.col(end).isin([entities] if isinstance(entities, str) else list(map(str, entities))))


def match(e: DataFrame, entities: DataFrame | Sequence[str] | str) -> DataFrame:
    """Edges that leave any of entities."""
    return _among(e, "source", entities)


def subset(e: DataFrame, source: DataFrame | Sequence[str] | None = None, target: DataFrame | Sequence[str] | None = None, undirected: bool = False) -> DataFrame:
    """Edges from source to target (None: any). Of an undirected pair with both ends in source, the one
    to the smaller target is reported."""
    out = e if source is None else _among(e, "source", source)
    out = out if target is None else _among(out, "target", target)
    if undirected and source is not None:
        twice = _among(out.filter("target > source"), "target", source).select(F.col("source").alias("__s"), F.col("target").alias("__t"))
        out = out.join(twice, (F.col("source") == F.col("__s")) & (F.col("target") == F.col("__t")), "left_anti")
    return out


def children(e: DataFrame, entities: DataFrame | Sequence[str] | str) -> DataFrame:
    return match(e, entities)


def parents(e: DataFrame, entities: DataFrame | Sequence[str] | str) -> DataFrame:
    return _among(e, "target", entities)


def neighbours(e: DataFrame, entities: DataFrame | Sequence[str] | str, undirected: bool = False) -> DataFrame:
    """Edges at entities with their direction; in an undirected relation children are all."""
    down = children(e, entities).withColumn("direction", F.lit("child"))
    return down if undirected else down.unionByName(parents(e, entities).withColumn("direction", F.lit("parent")))


class EdgeStore:
    """Edges on disk in two copies, one sorted by source and one by target, so that either end is looked up in the files that hold it.
    Undirected edges are there once, from the smaller end to the greater, and are found from both."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.undirected = json.loads(spark.read.text(f"{self.path}/edges.json", wholetext=True).first()[0])["undirected"]

    @classmethod
    def save(cls, e: DataFrame, path: str, undirected: bool = False, files: int | None = None) -> EdgeStore:
        once = undirected_closure(e).filter("source <= target") if undirected else e
        for first, second in (("source", "target"), ("target", "source")):
            clustered.write(once, f"{path}/by-{first}", [first, second], files=files)
        write_text(e.sparkSession, f"{path}/edges.json", json.dumps({"undirected": undirected}))
        return cls(e.sparkSession, path)

    def files(self, end: str, entities: Sequence[str]) -> list[str]:
        """The files that a look-up at one end reads."""
        return clustered.files(self.spark, f"{self.path}/by-{end}", clustered.having(entities))

    def _at(self, end: str, entities: DataFrame | Sequence[str] | str) -> DataFrame:
        entities = [entities] if isinstance(entities, str) else entities
        needed = None if isinstance(entities, DataFrame) else clustered.having(list(map(str, entities)))
        return _among(clustered.read(self.spark, f"{self.path}/by-{end}", needed), end, entities)

    def children(self, entities: DataFrame | Sequence[str] | str) -> DataFrame:
        down = self._at("source", entities)
        return down.unionByName(reverse(self._at("target", entities).filter("source <> target"))) if self.undirected else down

    def parents(self, entities: DataFrame | Sequence[str] | str) -> DataFrame:
        return reverse(self.children(entities)) if self.undirected else self._at("target", entities)

    def neighbours(self, entities: DataFrame | Sequence[str] | str) -> DataFrame:
        """Edges at entities with their direction; in an undirected relation children are all."""
        down = self.children(entities).withColumn("direction", F.lit("child"))
        return down if self.undirected else down.unionByName(self.parents(entities).withColumn("direction", F.lit("parent")))
