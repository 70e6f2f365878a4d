"""Substring dedup by fixed-block anchors.

A window is WINDOW consecutive words. A window that starts in a document goes if its word sequence
also starts in a document with a smaller id; a word goes if such a window covers it.

1. Anchors. Blocks are BLOCK = (WINDOW + 1) / 2 words, so each window holds a block that starts at a
   multiple of BLOCK in its own document. Those blocks are the index; every rolling block of every
   document probes it. Hashes meet in shards by hash range.
2. Extension. A hit is extended to the windows that hold it, in the documents on both sides. Only these
   windows are named in full, by 128 bits in shards by hash range; adjacent windows that match make up the
   maximal exact repeat. The smallest id of each window decides. Blocks that only seem equal cost work but
   change nothing.
3. The marked windows meet their documents again, and covered words go.

Hot passages: before anything is shuffled, each batch settles what it can. A window that occurs several
times in a batch leaves the batch once, its later occurrences being decided there. So a shard gets a row
a batch of a passage that a third of all documents share. Pairs of documents are never formed.
Payloads are packed arrays, bytes of equal rank side by side, which compress well.

Defined results: null and empty texts have no words; fewer than WINDOW words lose none; rows of equal id
don't remove each other's words; rows with a null id neither lose words nor remove any; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
BATCH_WORDS = 1 << 20
WORDS_PER_SHARD = 4_000_000
CHARS_A_WORD = 6
FAR = np.iinfo(np.int64).max
PACKED = "shard int, keys binary, ids binary, rows binary, counts binary, places binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(hashes: np.ndarray, size: int, step: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes."""
    n = max(0, len(hashes) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(step) + hashes[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def unplanes(raw: bytes, dtype: str, columns: int = 1) -> np.ndarray:
    width = np.dtype(dtype).itemsize * columns
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype)
    return a.ravel() if columns == 1 else a


class Entries:
    """Occurrences of hashes: key (one column, or two that count together), id (of the document), row (that
    tells rows apart) and place."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, rows: np.ndarray, place: np.ndarray):
        self.key, self.ids, self.rows, self.place = key, ids, rows, place

    def __getitem__(self, which: np.ndarray | slice) -> Entries:
        return Entries(self.key[which], self.ids[which], self.rows[which], self.place[which])

    def pack(self, shard: int, with_keys: bool) -> dict | None:
        """One payload. Entries of a row stand together."""
        if not len(self.ids):
            return None
        first = np.flatnonzero(np.concatenate([[True], self.rows[1:] != self.rows[:-1]]))
        counts = np.diff(np.append(first, len(self.rows)))
        return {"shard": shard, "keys": planes(self.key) if with_keys else b"", "ids": planes(self.ids[first]), "rows": planes(self.rows[first]), "counts": planes(counts.astype("<u4")), "places": planes(self.place.astype("<u4"))}

    @classmethod
    def unpack(cls, payloads: pd.DataFrame, dtype: str, columns: int) -> Entries:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for keys, ids, rows, counts, places in zip(*(payloads[c] for c in ("keys", "ids", "rows", "counts", "places")), strict=True):
            n = unplanes(counts, "<u4")
            new = (unplanes(keys, dtype, columns), np.repeat(unplanes(ids, "<i8"), n), np.repeat(unplanes(rows, "<i8"), n), unplanes(places, "<u4"))
            for part, x in zip(parts, new, strict=True):
                part.append(x)
        none = (np.zeros((0, columns) if columns > 1 else 0, dtype), np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0, "<u4"))
        return cls(*(np.concatenate(p) if p else n for p, n in zip(parts, none, strict=True)))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts key, where groups start in it, and their sizes."""
    if key.ndim == 1:
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order]) != 0
    else:
        order = np.lexsort(key.T[::-1])
        new = (np.diff(key[order], axis=0) != 0).any(axis=1)
    first = np.flatnonzero(np.concatenate([[True], new])) if len(key) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(key)))


def _runs(a: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    if len(a):
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        yield from zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=True)


def settle_anchors(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are hits, and which must still be compared with other batches. The smallest id
    that has the block aligned is the reference; larger ids hit it, and then it is a hit itself."""
    order, first, sizes = _groups(e.key)
    hit, open_ = np.zeros(len(order), bool), np.ones(len(order), bool)
    if len(order):
        ids, aligned = e.ids[order], e.place[order] % BLOCK == 0
        smallest = np.repeat(np.minimum.reduceat(np.where(aligned, ids, FAR), first), sizes)
        later = ids > smallest
        met = np.repeat(np.logical_or.reduceat(later, first), sizes)
        hit[order] = later | (aligned & (ids == smallest) & met)
        open_[order] = ~later
    return hit, open_


def settle_windows(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Which windows also start in a smaller id, and which are of the smallest id so far."""
    order, first, sizes = _groups(e.key)
    later = np.zeros(len(order), bool)
    if len(order):
        ids = e.ids[order]
        later[order] = ids > np.repeat(np.minimum.reduceat(ids, first), sizes)
    return later, ~later


def _deal(e: Entries, n_shards: int, settle: Callable, short: bool, spread: int) -> Iterator[dict]:
    """Payloads of a batch: what it settled itself (no keys; any shard passes it on), and by shard,
    which is a range of the key, what others must see."""
    done, open_ = settle(e)
    if row := e[done].pack(spread % n_shards, False):
        yield row
    e = e[open_]
    leading = e.key if e.key.ndim == 1 else e.key[:, 0]
    shard = (((leading >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32)).astype(np.uint16 if n_shards <= 65536 else np.uint32)
    order = np.argsort(shard, kind="stable")
    key = e.key.astype("<u4") if short else e.key
    e, shard = Entries(key, e.ids, e.rows, e.place)[order], shard[order]
    for at, end in _runs(shard):
        yield e[slice(at, end)].pack(int(shard[at]), True)


def _collect(payloads: pd.DataFrame, settle: Callable, dtype: str, columns: int, n_buckets: int) -> pd.DataFrame:
    """In a shard: the entries that are hits or marked, packed by bucket, a range of hashes of rows."""
    bare = payloads["keys"].map(len) == 0
    e, settled = Entries.unpack(payloads[~bare], dtype, columns), Entries.unpack(payloads[bare].assign(keys=b""), dtype, columns)
    e = e[settle(e)[0]]
    rows, place = (np.concatenate([getattr(e, c), getattr(settled, c)]) for c in ("rows", "place"))
    bucket = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_buckets
    order = np.lexsort((rows, bucket))
    rows, place, bucket = rows[order], place[order], bucket[order]
    out = []
    for at, end in _runs(bucket):
        row = Entries(place[at:end], rows[at:end], rows[at:end], place[at:end]).pack(int(bucket[at]), False)
        out.append((row["shard"], row["rows"], row["counts"], row["places"]))
    return pd.DataFrame(out, columns=["bucket", "rows", "counts", "places"])


def _gather(payloads: pd.DataFrame) -> pd.DataFrame:
    """In a bucket: all places of each row."""
    n = [unplanes(c, "<u4") for c in payloads["counts"]]
    rows = np.concatenate([np.repeat(unplanes(r, "<i8"), k) for r, k in zip(payloads["rows"], n, strict=True)])
    place = np.concatenate([unplanes(p, "<u4") for p in payloads["places"]])
    order = np.argsort(rows, kind="stable")
    rows, place = rows[order], place[order]
    return pd.DataFrame([(int(rows[a]), place[a:b].tobytes()) for a, b in _runs(rows)], columns=["of", "found"])


def _word_hashes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, and how many words each list has."""
    from xxhash import xxh3_128_digest

    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.frombuffer(b"".join(map(xxh3_128_digest, chain.from_iterable(lists))), ">u8").astype(np.uint64).reshape(-1, 2), sizes


def window_keys(hashes: np.ndarray) -> np.ndarray:
    """128 bits for each window: windows of one key are taken for the same words."""
    return np.stack([rolling(hashes[:, 0], WINDOW), rolling(hashes[:, 1], WINDOW, 0xC2B2AE3D27D4EB4F)], axis=1)


def _batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (id, row, words, ...) in lists of about BATCH_WORDS words."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[2])
        if n >= BATCH_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _packed(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "rows", "counts", "places"))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for k, v in row.items() if k != "shard")
        if size > 1 << 23:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _anchors(n_shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), i.as_py(), words_of(t.as_py())) for b in batches for i, t in zip(b.column("doc_id"), b.column("text"), strict=True) if i.is_valid)
        rows = (r for r in rows if len(r[2]) >= WINDOW)

        def deal() -> Iterator[dict]:
            for nth, held in enumerate(_batches(rows)):
                hashes, sizes = _word_hashes([r[2] for r in held])
                key = rolling(hashes[:, 0], BLOCK)
                start = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(len(held)), sizes)[: len(key)]
                place = np.arange(len(key)) - start[doc]
                inside = place <= sizes[doc] - BLOCK
                doc, ids = doc[inside], np.array([r[0] for r in held], np.int64)
                yield from _deal(Entries(key[inside], ids[doc], ids[doc], place[inside]), n_shards, settle_anchors, True, nth)

        yield from _packed(deal())

    return run


def _windows(n_shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), r.as_py(), words_of(t.as_py()), np.frombuffer(s.as_py(), "<u4")) for b in batches for i, r, t, s in zip(*(b.column(c) for c in ("doc_id", "row", "text", "starts")), strict=True))

        def deal() -> Iterator[dict]:
            for nth, held in enumerate(_batches(rows)):
                hashes, sizes = _word_hashes([r[2] for r in held])
                key = window_keys(hashes)
                start, n = np.cumsum(sizes) - sizes, np.array([len(r[3]) for r in held])
                place = np.concatenate([r[3] for r in held])
                ids, row = (np.repeat(np.array([r[i] for r in held], np.int64), n) for i in (0, 1))
                yield from _deal(Entries(key[place + np.repeat(start, n)], ids, row, place), n_shards, settle_windows, False, nth)

        yield from _packed(deal())

    return run


def _joined_places(found: bytes | None) -> np.ndarray:
    return np.unique(np.frombuffer(found or b"", "<u4")).astype(np.int64)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the windows that hold a hit; those without any are finished here."""
    for b in batches:
        out: dict[str, list] = {"doc_id": b.column("doc_id").to_pylist(), "text": [], "n_words": [], "starts": [], "sha": []}
        for text, hits in zip(b.column("text"), b.column("hits"), strict=True):
            text, hits = text.as_py(), hits.as_py()
            words = words_of(text)
            starts = np.zeros(0, np.int64)
            if hits and len(words) >= WINDOW:
                starts = np.unique(_joined_places(hits)[:, None] - np.arange(BLOCK))
                starts = starts[(starts >= 0) & (starts <= len(words) - WINDOW)]
            out["text"].append(text if len(starts) else None)
            out["n_words"].append(len(words))
            out["starts"].append(starts.astype("<u4").tobytes() if len(starts) else None)
            out["sha"].append(None if len(starts) else _sha(words))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("starts", pa.binary()), ("sha", pa.string())]))


def keep_words(words: list[bytes], marked: np.ndarray) -> list[bytes]:
    """The words that no marked window covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, marked, 1)
    np.add.at(edge, np.minimum(marked + WINDOW, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    for b in batches:
        rows = []
        for i, n, text, marked in zip(*(b.column(c) for c in ("doc_id", "n_words", "text", "marked")), strict=True):
            words = words_of(text.as_py())
            kept = keep_words(words, _joined_places(marked.as_py()))
            rows.append((i.as_py(), n.as_py(), n.as_py() - len(kept), _sha(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True)), schema=schema)


def _whole(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """run on all rows of a partition, which repartitionById makes one shard or bucket."""

    def on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if held := [b for b in batches if len(b)]:
            yield run(pd.concat(held, ignore_index=True))

    return on


def _sharded(packed: DataFrame, n_shards: int, settle: Callable, dtype: str, columns: int) -> DataFrame:
    """Shard i is partition i, and so is bucket i. A shard gives a row a bucket at most, and no more rows than hits."""

    def collect(rows: pd.DataFrame) -> pd.DataFrame:
        return _collect(rows, settle, dtype, columns, n_shards)

    found = packed.repartitionById(n_shards, F.col("shard")).mapInPandas(_whole(collect), "bucket int, rows binary, counts binary, places binary")
    return found.repartitionById(n_shards, F.col("bucket")).mapInPandas(_whole(_gather), "of long, found binary")


def dedup(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, n_words, n_removed, kept_sha256 and kept_text (null where nothing
    was removed) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(width, chars // CHARS_A_WORD // WORDS_PER_SHARD)

    hits = _sharded(docs.mapInArrow(_anchors(n_shards), PACKED), n_shards, settle_anchors, "<u4", 1)
    hits = materialize(hits.withColumnRenamed("found", "hits"), "substring-hits")
    met = docs.join(hits, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "hits")
    extended = met.mapInArrow(_extend, "doc_id long, text string, n_words long, starts binary, sha string")
    extended = materialize(extended.withColumn("row", F.monotonically_increasing_id()), "substring-extended")

    candidates = extended.filter("starts is not null")
    marked = _sharded(candidates.select("doc_id", "row", "text", "starts").mapInArrow(_windows(n_shards), PACKED), n_shards, settle_windows, "<u8", 2)
    marked = materialize(marked.withColumnRenamed("found", "marked"), "substring-marked")
    cut = candidates.join(marked, F.col("row") == F.col("of"), "left").select("doc_id", "n_words", "text", "marked")
    cut = cut.mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    whole = extended.filter("starts is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return whole.unionByName(cut)
