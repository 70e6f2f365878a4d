"""Exact dedup through a sharded cuckoo-filter index of live digests.

The digest of a text is its SHA-256. Each input batch first folds its own equal digests, so a text
that a third of all rows share reaches its shard as one row a batch. A shard then holds a cuckoo
filter of 16-bit fingerprints of the live digests, and buckets with these digests whole: a filter miss proves a digest new; a hit is verified
in its bucket. A copy with a larger id supersedes the live entry, which is deleted and inserted anew; other copies only
raise its count. When the filter overflows it is made twice as large from the stored digests. Shards follow from the row count, so their
size stays bounded.

Defined results: null texts equal the empty text; of rows with equal text and equal id exactly one
stays; a null id stays only if all ids of its group are null; an empty table gives no rows; extra columns are ignored; very
long texts are read whole.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

ROWS_PER_SHARD = 50_000
SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """Fingerprints of 16 bits in two possible buckets of SLOTS each, of which either is found from the other. It may say of a key that
    it was added though it wasn't, never the other way round. A fingerprint that finds no place though the table is less than half full, as
    when many keys begin alike, is counted apart: a larger table wouldn't help."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.slots, self.apart = buckets, 0, array("H", bytes(2 * buckets * SLOTS)), Counter()

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1  # 0 is a free slot

    def _other(self, bucket: int, fp: int) -> int:
        return bucket ^ (fp * 0x5BD1E995) % self.buckets  # an involution: buckets is a power of two

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fp, b = self._print(key), int.from_bytes(key[:8], "little") % self.buckets
        return fp, b, self._other(b, fp)

    def _find(self, bucket: int, fp: int) -> int | None:
        """The first slot of a bucket that holds fp."""
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.slots[at] == fp:
                return at
        return None

    def __contains__(self, key: bytes) -> bool:
        fp, b, other = self._places(key)
        return self._find(b, fp) is not None or self._find(other, fp) is not None or (min(b, other), fp) in self.apart

    def add(self, key: bytes) -> bool:
        """False if the table is too full; then it holds the new fingerprint, but some other is lost."""
        fp, b, other = self._places(key)
        for kick in range(MAX_KICKS):
            for bucket in (b, other) if not kick else (b,):
                free = self._find(bucket, 0)
                if free is not None:
                    self.slots[free] = fp
                    self.held += 1
                    return True
            at = b * SLOTS + kick % SLOTS
            fp, self.slots[at] = self.slots[at], fp
            b = self._other(b, fp)
        if 2 * self.held >= len(self.slots):
            return False
        self.apart[min(b, self._other(b, fp)), fp] += 1
        return True

    def remove(self, key: bytes) -> None:
        """Of a key that was added."""
        fp, b, other = self._places(key)
        if self.apart.get((min(b, other), fp)):
            self.apart[min(b, other), fp] -= 1
            self.apart += Counter()  # without zeros
            return
        at = self._find(b, fp)
        self.slots[self._find(other, fp) if at is None else at] = 0
        self.held -= 1


class CuckooIndex:
    """Live keys (digests of 16 bytes at least) and their values: a cuckoo filter before content buckets, in which whole keys lie.

    A key that the filter doesn't know is new, and no bucket is looked at; one that it knows is verified against the keys of its
    bucket. When the filter overflows, it is made anew, twice as large, from the keys in the buckets."""

    def __init__(self, buckets: int = 64):
        self.filter, self.content, self.size, self.resizes, self.verified = CuckooFilter(buckets), {}, 0, 0, 0

    def _entry(self, key: bytes) -> list | None:
        if key not in self.filter:
            return None
        self.verified += 1
        return next((e for e in self.content.get(key[:8], ()) if e[0] == key), None)

    def find(self, key: bytes) -> object | None:
        entry = self._entry(key)
        return None if entry is None else entry[1]

    def update(self, key: bytes, value: object) -> None:
        """A new value for a live key, which stays where it is."""
        self._entry(key)[1] = value

    def delete(self, key: bytes) -> bool:
        entry = self._entry(key)
        if entry is None:
            return False
        bucket = self.content[key[:8]]
        bucket.remove(entry)
        if not bucket:
            del self.content[key[:8]]
        self.filter.remove(key)
        self.size -= 1
        return True

    def insert(self, key: bytes, value: object) -> None:
        """A key that isn't live."""
        self.content.setdefault(key[:8], []).append([key, value])
        self.size += 1
        whole = self.filter.add(key)
        while not whole:
            self.filter, self.resizes = CuckooFilter(self.filter.buckets * 2), self.resizes + 1
            whole = all(self.filter.add(k) for k, _ in self)

    def __iter__(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for bucket in self.content.values() for k, v in bucket)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal digests of a batch become one row: the largest (id, row) and the count."""
    for b in batches:
        b = b.sort_values(["doc_id", "row"], na_position="first")
        g = b.groupby("digest", sort=False)
        last = g.tail(1).set_index("digest")
        last["n"] = g.size()
        yield last.reset_index()[["shard", "digest", "doc_id", "row", "n"]]


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    index = CuckooIndex()
    for digest, doc_id, row, n in zip(rows["digest"], rows["doc_id"].astype("Int64"), rows["row"], rows["n"], strict=True):
        rank = (doc_id is not pd.NA, 0 if doc_id is pd.NA else int(doc_id), int(row))
        live = index.find(digest)
        if live is None:
            index.insert(digest, (rank, int(n)))
        elif rank > live[0]:  # the row that stays so far gives way
            index.delete(digest)
            index.insert(digest, (rank, live[1] + int(n)))
        else:
            index.update(digest, (live[0], live[1] + int(n)))
    out = [(k, rank[1] if rank[0] else None, rank[2], n) for k, (rank, n) in index]
    out = pd.DataFrame(out, columns=["of", "keep_id", "keep_row", "group_size"])
    out["keep_id"] = out["keep_id"].astype("Int64")
    return out


def live_entries(digests: DataFrame, n_shards: int) -> DataFrame:
    """digests: digest, doc_id, row. One row a digest: of, keep_id, keep_row, group_size."""
    sharded = digests.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int"))
    folded = sharded.mapInPandas(_fold, "shard int, digest binary, doc_id long, row long, n long")
    return folded.groupBy("shard").applyInPandas(_shard, "of binary, keep_id long, keep_row long, group_size long")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text)."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    digests = materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest.alias("digest")), "exact-digests")
    rows = digests.count()
    n_shards = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_SHARD))
    live = materialize(live_entries(digests, n_shards), "exact-live")
    return digests.join(live, F.col("digest") == F.col("of")).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
