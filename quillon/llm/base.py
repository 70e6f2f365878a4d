"""What the corpus operators share: the word rule, shared-folder tables, and table access."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import delete
from ..sources.store import work_path as shared_path

#: A word is a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and return that table: the lineage ends there,
    and what an executor wrote outlives it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read any more."""
    for t in tables:
        delete(t.sparkSession, t.written_to)


def small(df: DataFrame, max_bytes: int) -> bool:
    """True if the rows of a materialized table, whole strings included, have max_bytes at most, so that
    it may be broadcast."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    row = sum(texts, F.lit(16 * len(df.columns))).cast("long")
    return (df.agg(F.sum(row)).first()[0] or 0) <= max_bytes


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each after as many underscores as it takes not to be a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; rows of one hash and id are taken for equal."""
    plain = [F.to_json(F.struct(F.col(c))) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in ((f"`{c.replace('`', '``')}`", k) for c, k in df.dtypes)]
    return F.xxhash64(*plain)


def by_bytes(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts, nulls as empty, in groups of about `size` bytes."""
    texts = pc.fill_null(texts, "")
    through = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(through, (through[at - 1] if at else 0) + size)))
        yield texts.slice(at, end - at)
        at = end


def release() -> None:
    """Give back to the system what Arrow and the allocator no longer use. A worker serves later tasks and stages too, and what
    it keeps from a large batch would add up in an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus."""
    return F.crc32(doc_id.cast("string")) % modulus
