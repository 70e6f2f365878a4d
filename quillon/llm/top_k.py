"""Exact top-k search by distributed histogram selection.

Vectors are made of whole numbers, floor(256 * component); the score of a query and a candidate is their inner product.
Every query is scored against every candidate of its length but itself, and nothing of that is stored. Instead the
k-th highest score of each query is located by histograms: tasks count the scores of their candidates in BINS
equal bins of the query's range, which Cauchy's inequality bounds; the counts are added up over all tasks, and the bin that holds the
k-th score is the range of the next, finer histogram, until a bin is a single score. Then one more pass keeps what is above
that score, and of what equals it the smallest ids. A task reports only those bins, and those ties, that fewer than k of its
own candidates precede: no others can be among the k first of all.

Queries are taken in blocks of about QUERY_BYTES, a bounded broadcast, and the candidates are dealt evenly; a task holds one block,
its histograms and a tile of scores. Scores are computed by matrix products in the narrowest type that is exact.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different length are
not compared, so a query may have fewer than k results, or none; a query's own rows are all of its id; of queries with one id the
first vector in order counts, queries without an id are ignored; candidates may repeat, and those without an id come
after those of equal score with one; components beyond 2**40 and scores beyond 2**62 count as that; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, materialize, shared_path
from .vectors import dtype_for, matrices, whole

SCALE = 256
BITS = 10
BINS = 1 << BITS
QUERY_BYTES = 1 << 22
ROWS_PER_TASK = 1 << 15
TILE_QUERIES, TILE_ROWS = 256, 4096
FURTHEST = 1 << 62


@dataclass
class Block:
    """Queries of one length, ids ascending. The k-th score of a query is in [low, low + BINS << shift); `need` is how many of
    the k are in there or below."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    shift: np.ndarray
    need: np.ndarray
    bound: float

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, k: int, longest: float) -> Block:
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        reach = [min(FURTHEST, int(x * longest * (1 + 1e-9)) + 1) for x in norms]
        shift = [((2 * r + 1).bit_length() - 1) // BITS * BITS for r in reach]  # so that every bin has BINS bins in turn
        return cls(ids, vectors, np.array([-r for r in reach], np.int64), np.array(shift, np.int64), np.full(len(ids), k, np.int64), max([0.0, *norms]) * longest * (1 + 1e-9) + 1)

    def part(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.vectors[rows], self.low[rows], self.shift[rows], self.need[rows], self.bound)

    def tiles(self, ids: np.ndarray, known: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Scores of some queries and candidates at a time; a query's score with its own rows is below its range."""
        kind = dtype_for(self.bound)
        queries, others = self.vectors.astype(kind), rows.astype(kind)
        for at in range(0, len(others), TILE_ROWS):
            theirs = slice(at, min(at + TILE_ROWS, len(others)))
            own = np.minimum(np.searchsorted(self.ids, ids[theirs]), len(self.ids) - 1)
            same = np.flatnonzero((self.ids[own] == ids[theirs]) & known[theirs])
            for first in range(0, len(queries), TILE_QUERIES):
                ours = slice(first, min(first + TILE_QUERIES, len(queries)))
                scores = queries[ours] @ others[theirs].T
                scores = (np.clip(scores, -FURTHEST, FURTHEST) if kind is object else scores).astype(np.int64)
                here = same[(own[same] >= ours.start) & (own[same] < ours.stop)]
                scores[own[here] - ours.start, here] = self.low[own[here]] - 1
                yield ours, theirs, scores


def _candidates(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids (null: the largest number), which of them are known, and the matrix of each length."""
    ids = batch.column("vec_id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    for rows, matrix in matrices(batch):
        yield numbers[rows], known[rows], matrix


def _histograms(candidates: DataFrame, blocks: dict[int, Block]) -> DataFrame:
    """size, q, need, bin, n: scores in each bin of each query, as far as they matter."""
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)  # QUERY_BYTES of vectors

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for ids, known, matrix in _candidates(batch):
                block = shared.value.get(matrix.shape[1])
                if block is None:
                    continue
                counts = found.setdefault(matrix.shape[1], np.zeros((len(block.ids), BINS), np.int64))
                for ours, _, scores in block.tiles(ids, known, matrix):
                    at = (scores - block.low[ours, None]) >> block.shift[ours, None]
                    q, c = np.nonzero((at >= 0) & (at < BINS))
                    counts[ours] += np.bincount(q * BINS + at[q, c], minlength=len(at) * BINS).reshape(len(at), BINS)
        for size, counts in found.items():
            need = shared.value[size].need
            before = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, at = np.nonzero((counts > 0) & (before < need[:, None]))
            yield pa.RecordBatch.from_pydict({"size": np.full(len(q), size, np.int64), "q": q, "need": need[q], "bin": at, "n": counts[q, at]})

    return candidates.mapInArrow(count, "size long, q long, need long, bin long, n long").groupBy("size", "q", "need", "bin").agg(F.sum("n").alias("n"))


def _locate(candidates: DataFrame, blocks: dict[int, Block]) -> None:
    """Narrow each query's range to its k-th score; to its lowest score where there are fewer than k."""
    open_ = {size: np.arange(len(b.ids)) for size, b in blocks.items()}
    while any(map(len, open_.values())):
        counts = _histograms(candidates, {size: blocks[size].part(rows) for size, rows in open_.items() if len(rows)})
        through = F.sum("n").over(Window.partitionBy("size", "q").orderBy(F.desc("bin")))  # BINS rows at most
        there = counts.withColumn("through", through).filter("through >= need").groupBy("size", "q").agg(F.max(F.struct("bin", (F.col("through") - F.col("n")).alias("before"))).alias("at"))
        found = there.select("size", "q", "at.bin", "at.before").toArrow()  # a row a query of the block
        left = {size: [] for size in blocks}
        for size, q, at, before in zip(*(found[c].to_numpy() for c in found.column_names), strict=True):
            block, row = blocks[size], open_[size][q]
            block.low[row] += at << block.shift[row]
            block.need[row] -= before
            if block.shift[row]:
                block.shift[row] -= BITS
                left[size].append(row)
        open_ = {size: np.sort(np.array(rows, np.int64)) for size, rows in left.items()}


def _first(q: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the k first of their query."""
    order = np.lexsort((ids, ~known, -score, q))
    starts = np.flatnonzero(np.diff(q[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def _selected(candidates: DataFrame, blocks: dict[int, Block], k: int) -> DataFrame:
    """query_id, vec_id, score: what reaches a query's k-th score, the k first of a task at most."""
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)  # QUERY_BYTES of vectors

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            for ids, known, matrix in _candidates(batch):
                size = matrix.shape[1]
                block = shared.value.get(size)
                if block is None:
                    continue
                parts = [kept[size]] if size in kept else []
                for ours, theirs, scores in block.tiles(ids, known, matrix):
                    q, c = np.nonzero(scores >= block.low[ours, None])
                    new = (q + ours.start, scores[q, c], ids[theirs][c], known[theirs][c])
                    best = _first(*new, k)
                    parts.append(tuple(x[best] for x in new))
                if parts:
                    rows = tuple(map(np.concatenate, zip(*parts, strict=True)))
                    best = _first(*rows, k)
                    kept[size] = tuple(x[best] for x in rows)
        for size, (q, score, ids, known) in kept.items():
            yield pa.RecordBatch.from_pydict({"query_id": shared.value[size].ids[q], "vec_id": pa.array(ids, mask=~known), "score": score})

    return candidates.mapInArrow(select, "query_id long, vec_id long, score long")


def top(candidates: DataFrame, queries: DataFrame, k: int = 5, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """candidates, queries: vec_id, embedding. query_id, rank (from 1), vec_id and score of each query's k highest scores, ties to
    the smaller vec_id."""
    spark = candidates.sparkSession
    asked = materialize(whole(queries, SCALE).filter("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    rows = whole(candidates, SCALE)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    count, longest = rows.agg(F.count("*"), F.max(length)).first()
    rows = materialize(rows.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-count // ROWS_PER_TASK))), "topk-vectors")
    size = asked.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    n_blocks, folder = max(1, -(-size // query_bytes)), shared_path(spark, "topk-found")
    for number in range(n_blocks if count else 0):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number).orderBy("vec_id").toArrow().combine_chunks()  # about query_bytes
        blocks = {m.shape[1]: Block.of(block["vec_id"].to_numpy()[r], m, k, longest) for b in block.to_batches() for r, m in matrices(b)}
        _locate(rows, blocks)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        found = _selected(rows, blocks, k).withColumn("rank", nth).filter(F.col("rank") <= k)  # k rows a task and query at most
        found.select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/block={number}")
    discard(rows, asked)
    schema = "query_id long, rank int, vec_id long, score long"
    if not count:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, block int").parquet(folder).drop("block")
