"""Keyed tables as Parquet: plain, bucketed by key, or in shards; packed positions; cached results."""

from __future__ import annotations

import atexit
import functools
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY, ORD, KeyedTable, Meta, quoted


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _file(spark, path)
    fs.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    at, fs = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _describe(t: KeyedTable, path: str, **more) -> None:
    write_text(t.df.sparkSession, f"{path}.meta", json.dumps({"key": t.key, "fields": t.fields, "shape": t.shape, "namespace": t.meta.namespace, **more}))


def described(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.meta", wholetext=True).first()[0])


def save(t: KeyedTable, path: str, mode: str = "error", sorted_by_key: bool = False) -> None:
    """Rows, order included, and the table's description. sorted_by_key: ranges of keys a file, so that
    look-ups and prefixes read few row groups."""
    df = t.df.repartitionByRange(quoted(t.key)).sortWithinPartitions(quoted(t.key)) if sorted_by_key else t.df
    df.write.mode(mode).parquet(path)
    _describe(t, path)


def load(spark: SparkSession, path: str) -> KeyedTable:
    meta = described(spark, path)
    return KeyedTable(spark.read.parquet(path), Meta(meta["key"], tuple(meta["fields"]), meta["shape"], meta["namespace"]))


def get(t: KeyedTable, *keys: str) -> DataFrame:
    return t.df.filter(quoted(t.key).cast("string").isin(list(map(str, keys)))).select(*map(quoted, t.all_fields))


def save_bucketed(t: KeyedTable, name: str, buckets: int, path: str | None = None) -> None:
    """A catalog table bucketed and sorted by key, a file a bucket: joins by key need no shuffle of it. path: where its files lie, else
    in the warehouse."""
    out = t.df.repartition(buckets, quoted(t.key)).write.bucketBy(buckets, t.key).sortBy(t.key).mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(name)


def save_sharded(t: KeyedTable, path: str, shard: Callable[[Column], Column], mode: str = "error") -> None:
    t.df.withColumn("shard", shard(quoted(t.key))).write.mode(mode).partitionBy("shard").parquet(path)
    _describe(t, path, sharded=True)


def get_sharded(spark: SparkSession, path: str, shard: Callable[[Column], Column], keys: Sequence[str]) -> KeyedTable:
    """Rows of keys; only their shards are read, since the shards of literals fold to literals."""
    meta = described(spark, path)
    df = spark.read.parquet(path)
    if keys:
        df = df.filter(F.col("shard").isin(*[shard(F.lit(k)) for k in keys]) & quoted(meta["key"]).isin(list(keys)))
    return KeyedTable(df.drop("shard"), Meta(meta["key"], tuple(meta["fields"]), meta["shape"], meta["namespace"]))


def packed(t: KeyedTable, position: str | Column | None = None) -> DataFrame:
    """Records by integer position, a column or computed from the key; positions without one are absent, and read as null."""
    at = (position if isinstance(position, Column) else quoted(t.identify(position or KEY))).cast("bigint")
    return t.df.select(at.alias("position"), *map(quoted, t.fields))


def at_positions(records: DataFrame, positions: Sequence[int]) -> DataFrame:
    wanted = records.sparkSession.createDataFrame([(int(p),) for p in positions], "position long")
    return wanted.join(records, "position", "left")


def cached(spark: SparkSession, folder: str, name: str, options: dict, make: Callable[[], KeyedTable], update: bool = False) -> KeyedTable:
    """The table saved under name and options, made first if it isn't there (or update is set)."""
    digest = hashlib.sha256(json.dumps([name, options], sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{digest}"
    if update or not exists(spark, f"{path}.meta"):
        save(make(), path, "overwrite")
    return load(spark, path)


def upsert(t: KeyedTable, other: KeyedTable) -> KeyedTable:
    from ..operators.sets import overlay

    return overlay(t, other)


def ordered(t: KeyedTable) -> DataFrame:
    return t.df.orderBy(ORD)


@functools.cache
def _own_folder(master: str) -> str:
    """A folder of this machine, for sessions that name no shared one (tests on local[n])."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="spark-quillon-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. It is removed
    when the application ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{(found or _own_folder(spark.sparkContext.master)).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at, fs = _file(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: worked out once, however often it is read."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
