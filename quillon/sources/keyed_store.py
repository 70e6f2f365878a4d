"""A keyed table on disk that is written in place, by whole shards and versions.

    <path>/versions/00000007.json     which folder each shard lies in, as of version 7; key, fields, shape, types
    <path>/shards/<batch>/shard=3/    the rows of shard 3 as one batch of writes left them

A batch of writes (put, delete, merge) rewrites the shards that hold its keys, and no others, in a folder of its own, and then writes
the next version, which is what makes it count: whoever reads sees all of a batch or nothing of it. The file of a version is
created once; of two writers that start from one version the second fails with Conflict and may try again. What a
writer that died left behind is in no version, and vacuum() removes it.

Keys are dealt to shards by a hash; their number is fixed when the store is made, so that a shard fits a few tasks. Rows come in
order of key. A key is there once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import ORD, KeyedTable, Meta, quoted
from ..operators import sets
from ..operators.aggregate import merge_by_key
from .store import _file, delete, exists, names_in, work_path


class Conflict(RuntimeError):
    """Somebody else wrote the version that was to be written."""


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(shards)).cast("int")


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Versions

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, by default the last one that is whole."""
        for v in [version] if version is not None else reversed(self.versions()):
            text = self.spark.read.text(f"{self.path}/versions/{v:08d}.json", wholetext=True).first()
            try:
                return json.loads(text[0])
            except (TypeError, json.JSONDecodeError):  # being written
                if version is not None:
                    raise
        raise FileNotFoundError(f"no store at {self.path}")

    def _commit(self, manifest: dict) -> None:
        at, fs = _file(self.spark, f"{self.path}/versions/{manifest['version']:08d}.json")
        if fs.exists(at):
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")
        try:
            out = fs.create(at, False)  # fails if the file has come to be
        except Exception as e:
            raise Conflict(str(e)) from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    # Reading

    def _rows(self, manifest: dict, shards: Iterable[int] | None = None) -> DataFrame:
        wanted = manifest["folders"] if shards is None else {s: manifest["folders"][str(s)] for s in shards if str(s) in manifest["folders"]}
        schema = StructType.fromJson(manifest["types"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/shards/{f}" for f in sorted(wanted.values())])

    def _table(self, manifest: dict, df: DataFrame) -> KeyedTable:
        return KeyedTable(df.withColumn(ORD, quoted(manifest["key"]).cast("string")), Meta(manifest["key"], tuple(manifest["fields"]), manifest["shape"], manifest["namespace"]))

    def read(self, version: int | None = None) -> KeyedTable:
        manifest = self.manifest(version)
        return self._table(manifest, self._rows(manifest))

    def get(self, keys: Sequence[str], version: int | None = None) -> KeyedTable:
        """The rows of a few keys, from their shards alone."""
        manifest = self.manifest(version)
        asked = self.spark.createDataFrame([(str(k),) for k in keys], "k string")
        shards = [r[0] for r in asked.select(shard_of(F.col("k"), manifest["shards"])).distinct().collect()]  # of the caller's list
        return self._table(manifest, self._rows(manifest, shards).filter(quoted(manifest["key"]).cast("string").isin([str(k) for k in keys])))

    # Writing

    @classmethod
    def create(cls, t: KeyedTable, path: str, shards: int = 64) -> KeyedStore:
        """A store of a table's rows; rows of a key merge as in merge_by_key."""
        store = cls(t.df.sparkSession, path)
        if exists(store.spark, f"{store.path}/versions"):
            raise Conflict(f"there is a store at {path}")
        rows = merge_by_key(t).public()
        manifest = {"version": 0, "key": t.key, "fields": list(t.fields), "shape": t.shape, "namespace": t.meta.namespace, "shards": shards, "types": json.loads(rows.schema.json()), "folders": {}}
        store._write(manifest, rows)
        return store

    def _write(self, manifest: dict, rows: DataFrame, touched: Iterable[int] = ()) -> int:
        """Write the rows, which replace all of the touched shards, and then the version."""
        batch = uuid.uuid4().hex
        shard = shard_of(quoted(manifest["key"]), manifest["shards"])
        rows.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", quoted(manifest["key"])).write.partitionBy("shard").parquet(f"{self.path}/shards/{batch}")
        filled = {n.removeprefix("shard="): f"{batch}/{n}" for n in names_in(self.spark, f"{self.path}/shards/{batch}") if n.startswith("shard=")}
        kept = {s: f for s, f in manifest["folders"].items() if int(s) not in set(touched)}
        self._commit(manifest | {"folders": kept | filled})
        return manifest["version"]

    def _batch(self, manifest: dict, t: KeyedTable) -> tuple[KeyedTable, list[int]]:
        """The batch, once a key, under the store's names and types, written aside; and the shards of its keys."""
        names = (manifest["key"], *manifest["fields"])
        if len(t.all_fields) != len(names) or (t.shape in ("flat", "double")) != (manifest["shape"] in ("flat", "double")):
            raise ValueError(f"{t.all_fields} ({t.shape}) don't fit {names} ({manifest['shape']})")
        one = merge_by_key(t)
        types = StructType.fromJson(manifest["types"])
        df = one.df.filter(quoted(t.key).isNotNull()).select(*[quoted(c).cast(types[n].dataType).alias(n) for c, n in zip(t.all_fields, names, strict=True)])
        path = work_path(self.spark, "store-batch")
        df.withColumn("shard", shard_of(quoted(names[0]), manifest["shards"])).write.parquet(path)
        saved = self.spark.read.parquet(path)
        shards = [r[0] for r in saved.select("shard").distinct().collect()]  # a row a shard
        return self._table(manifest, saved.drop("shard")), sorted(shards)

    def _changed(self, t: KeyedTable, change: Callable[[KeyedTable, KeyedTable], KeyedTable]) -> int:
        manifest = self.manifest()
        batch, shards = self._batch(manifest, t)
        if not shards:
            return manifest["version"]
        old = self._table(manifest, self._rows(manifest, shards))
        return self._write(manifest | {"version": manifest["version"] + 1}, change(old, batch).public(), shards)

    def put(self, t: KeyedTable) -> int:
        """t's rows in place of those of the same key; the new version."""
        return self._changed(t, sets.overlay)

    def merge(self, t: KeyedTable) -> int:
        """t's lists behind those of the same key, other keys as they are; of scalars t's stay."""
        return self._changed(t, sets.merge_zip)

    def delete(self, keys: DataFrame | Sequence[str]) -> int:
        """Rows of the keys (a DataFrame of one column, or a list) go."""
        manifest = self.manifest()
        key = manifest["key"]
        wanted = keys.select(F.col(keys.columns[0]).cast("string").alias("k")) if isinstance(keys, DataFrame) else self.spark.createDataFrame([(str(k),) for k in keys], "k string")
        path = work_path(self.spark, "store-batch")
        wanted.distinct().withColumn("shard", shard_of(F.col("k"), manifest["shards"])).write.parquet(path)
        wanted = self.spark.read.parquet(path)
        shards = sorted(r[0] for r in wanted.select("shard").distinct().collect())  # a row a shard
        if not shards:
            return manifest["version"]
        rest = self._rows(manifest, shards).join(wanted.select("k"), quoted(key).cast("string") == F.col("k"), "left_anti")
        return self._write(manifest | {"version": manifest["version"] + 1}, rest, shards)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Keep the last few versions and delete the folders that none of them needs; those folders. Not while somebody writes."""
        versions = self.versions()
        for v in versions[:-keep]:
            delete(self.spark, f"{self.path}/versions/{v:08d}.json")
        used = {f.split("/")[0] for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = [n for n in names_in(self.spark, f"{self.path}/shards") if n not in used]
        for n in gone:
            delete(self.spark, f"{self.path}/shards/{n}")
        return gone
