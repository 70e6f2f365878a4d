"""Entities: typed columns, their formats, and properties computed for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import decode_array, encode_array
from ..model import KeyedTable, quoted
from ..sources.store import delete, exists, work_path, write_text
from .translate import translate_column, translation_index

KINDS = ("single", "array", "multiple")


def typed(df: DataFrame, column: str, entity: str, **options) -> DataFrame:
    """df with the entity's name and options as metadata of a column."""
    return df.withMetadata(column, df.schema[column].metadata | {"entity": entity, **options})


def entity_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("entity")


@dataclass
class Property:
    """single: a Column from a Column. array: a pandas Series from a Series, a batch at a time.
    multiple: as array, but each distinct entity is computed once and kept."""

    kind: str
    compute: Callable
    returns: str = "string"


@dataclass
class Entity:
    name: str
    formats: Sequence[str] = ()
    identifiers: Sequence[KeyedTable] = ()
    properties: dict[str, Property] = field(default_factory=dict)
    kept: dict[str, str] = field(default_factory=dict)

    def property(self, name: str, kind: str = "single", returns: str = "string") -> Callable:
        if kind not in KINDS:
            raise ValueError(f"{kind!r} is none of {KINDS}")

        def add(compute: Callable) -> Callable:
            self.properties[name] = Property(kind, compute, returns)
            return compute

        return add

    def with_property(self, df: DataFrame, column: str, name: str, *args) -> DataFrame:
        p = self.properties[name]
        if p.kind == "single":
            value: Column = p.compute(quoted(column), *args)
            return df.withColumn(name, value)
        if p.kind == "array":
            udf = F.pandas_udf(lambda s: p.compute(s, *args), p.returns)
            return df.withColumn(name, udf(quoted(column)))
        values = self._values(df.select(quoted(column).alias("__e")).distinct(), name, p, args)
        return df.join(values, quoted(column) == F.col("__e"), "left").drop("__e")

    def _values(self, distinct: DataFrame, name: str, p: Property, args: tuple) -> DataFrame:
        """entity and value of what is asked for. Values once computed are in a table in the work folder; only missing
        entities are computed, and appended to it."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"__e": b["__e"], name: p.compute(b["__e"], *args)})

        schema, key = f"__e {distinct.schema['__e'].dataType.simpleString()}, {name} {p.returns}", f"{name}{args!r}"
        spark = distinct.sparkSession
        if key in self.kept:
            distinct = distinct.join(spark.read.schema(schema).parquet(self.kept[key]).select("__e"), "__e", "left_anti")
        else:
            self.kept[key] = work_path(spark, "property")
        distinct.mapInPandas(run, schema).write.mode("append").parquet(self.kept[key])
        return spark.read.schema(schema).parquet(self.kept[key])

    def forget(self, name: str) -> None:
        spark = SparkSession.active()
        for key in [k for k in self.kept if k.startswith(f"{name}(")]:
            delete(spark, self.kept.pop(key))

    def to(self, df: DataFrame, column: str, target: str, source: str | None = None, name: str | None = None) -> DataFrame:
        """The entities of a column in another format; null where there is none."""
        return translate_column(df, column, translation_index(self.identifiers, source, target), name or target)


def kept_annotations(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame | None]) -> DataFrame | None:
    """An annotation table that is made once. That there is none (None) is kept too, as is an empty one."""
    path = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, f"{path}/_SUCCESS") and not exists(spark, f"{path}.nil"):
        made = make()
        if made is None:
            write_text(spark, f"{path}.nil", "")
        else:
            made.write.parquet(path)
    return None if exists(spark, f"{path}.nil") else spark.read.parquet(path)


def annotation_table(df: DataFrame, id_column: str, annotations: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Objects as id, literal, a JSON of scalar annotations, and lists as 'Array:a|b'."""
    info = F.to_json(F.struct(*[quoted(a).alias(a) for a in sorted(annotations)]))
    return df.select(quoted(id_column).alias("id"), info.alias("annotations"), *[encode_array(quoted(c)).alias(c) for c in lists])


def from_annotation_table(df: DataFrame, schema: str, lists: Sequence[str] = ()) -> DataFrame:
    parsed = df.withColumn("__a", F.from_json("annotations", schema))
    return parsed.select("id", "__a.*", *[decode_array(quoted(c)).alias(c) for c in lists])
