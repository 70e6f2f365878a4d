"""Codes of vectors: product quantization whose nearest entries are found by a GNAT.

Vectors are made of whole numbers, floor(1024 * component), and cut into PARTS consecutive parts. Each part has a codebook of
ENTRIES entries, at first the parts of the vectors with the smallest ids. A round assigns every part to the nearest entry (squared
Euclidean distance, ties to the lower number) and puts the componentwise floor of the mean in place of each entry that got any.

A geometric near-neighbour access tree (GNAT) is built over the entries of a codebook: split points far from each other, each with
the entries that are nearest to it, and for every split point the range of its distances to the entries under every other. A part is
compared with the split points; what lies under one is passed over if the distance to any split point tells, by the triangle
inequality, that it must be strictly further away than the nearest entry so far. Distances in the tree are square roots, so
the inequality must hold by a margin above their rounding; what decides between entries is the whole-numbered square.

A round is one pass over the vectors. Tasks add up their own parts by entry and report a row a component; codebooks are
bounded by ENTRIES vectors, and only they go to the driver and in broadcasts.

Defined results: vectors that are null or hold null or non-finite components take no part; nor do those of another length than that
of the first vector, which no codebook fits; a length that PARTS doesn't divide is cut as evenly as can be; with fewer vectors
than ENTRIES the codebooks are that much smaller; repeated ids are rows of their own, in order of their vectors, ids that
are null come last; components beyond 2**40 count as that, errors beyond a long as the largest; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .vectors import dtype_for, matrices, whole

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
SPLITS, LEAF = 16, 16
MARGIN = 1e-9
LARGEST = (1 << 63) - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b."""
    top = max((int(abs(x).max()) if x.size else 0) for x in (a, b))
    kind = dtype_for(4.0 * top * top * max(1, a.shape[1]))
    kind = np.float64 if kind is np.float32 else kind
    a, b = a.astype(kind), b.astype(kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class Node:
    """splits: numbers of entries. under[j]: what is nearest to split j, a node or the numbers of a few entries. low, high[i, j]:
    the least and the greatest distance of split i to the entries under split j."""

    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    under: list


class Gnat:
    """Nearest entries among the rows of a matrix of whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._build(np.arange(len(entries)))

    def _build(self, members: np.ndarray) -> Node | np.ndarray:
        if len(members) <= LEAF:
            return members
        # Split points: the first member, then always the one furthest from those chosen.
        chosen, nearest = [0], squared(self.entries[members], self.entries[members[:1]])[:, 0]
        while len(chosen) < SPLITS:
            nearest[chosen] = -1
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(self.entries[members], self.entries[members[chosen[-1:]]])[:, 0])
        splits, rest = members[np.sort(chosen)], np.delete(members, chosen)
        squares = squared(self.entries[splits], self.entries[rest])
        owner, away = squares.argmin(axis=0), root(squares)
        groups = [np.flatnonzero(owner == j) for j in range(len(splits))]
        low, high = (np.array([[f(away[i, g]) if len(g) else 0.0 for g in groups] for i in range(len(splits))]) for f in (np.min, np.max))
        return Node(splits, low, high, [self._build(rest[g]) for g in groups])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each point's nearest entry, and the squared distance."""
        number = np.full(len(points), len(self.entries), np.int64)
        best = np.full(len(points), np.inf, object if squared(points[:1], self.entries).dtype == object or (points.size and abs(points).max() > 1 << 20) else np.float64)
        self.compared = 0
        self._search(self.top, np.arange(len(points)), points, number, best)
        return number, best

    def _compare(self, members: np.ndarray, rows: np.ndarray, points: np.ndarray, number: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Compare rows with entries; the squared distances. Members are in order, so of equals the first is the lowest."""
        self.compared += len(members) * len(rows)
        squares = squared(points[rows], self.entries[members])
        at = squares.argmin(axis=1)
        least = squares[np.arange(len(rows)), at]
        better = (least < best[rows]) | ((least == best[rows]) & (members[at] < number[rows]))
        number[rows[better]], best[rows[better]] = members[at[better]], least[better]
        return squares

    def _search(self, node: Node | np.ndarray, rows: np.ndarray, points: np.ndarray, number: np.ndarray, best: np.ndarray) -> None:
        if not len(rows) or (isinstance(node, np.ndarray) and not len(node)):
            return
        if isinstance(node, np.ndarray):
            self._compare(node, rows, points, number, best)
            return
        squares = self._compare(node.splits, rows, points, number, best)
        away, first = root(squares), squares.argmin(axis=1)
        for other in (False, True):  # what is under the nearest split point comes first
            for j, under in enumerate(node.under):
                if isinstance(under, np.ndarray) and not len(under):
                    continue
                asked = np.flatnonzero((first != j) if other else (first == j))
                near = root(best[rows[asked]])[:, None]
                short = np.maximum(away[asked] - node.high[:, j], node.low[:, j] - away[asked])
                beyond = short > near + MARGIN * (away[asked] + node.high[:, j] + near + 1)
                self._search(under, rows[asked[~beyond.any(axis=1)]], points, number, best)


def _cuts(length: int) -> list[slice]:
    return [slice(length * i // PARTS, length * (i + 1) // PARTS) for i in range(PARTS)]


def _assigned(rows: DataFrame, books: list[np.ndarray], schema: str, use) -> DataFrame:
    """use(batches), where each batch comes with its matrix, numbers of entries and squared distances, a column a part."""
    shared, cuts = rows.sparkSession.sparkContext.broadcast([Gnat(b) for b in books]), _cuts(sum(b.shape[1] for b in books))  # ENTRIES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for _, matrix in matrices(batch):  # of one length
                    found = [tree.nearest(matrix[:, cut]) for tree, cut in zip(shared.value, cuts, strict=True)]
                    yield batch, matrix, [n for n, _ in found], [d for _, d in found]

        yield from use(each())

    return rows.mapInArrow(run, schema)


def learn(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    cuts = _cuts(sum(b.shape[1] for b in books))
    shapes = [b.shape for b in books]

    def sums(found) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros(s, np.int64) for s in shapes], [np.zeros(s[0], np.int64) for s in shapes]
        for _, matrix, numbers, _ in found:
            for part, cut in enumerate(cuts):
                np.add.at(totals[part], numbers[part], matrix[:, cut])
                counts[part] += np.bincount(numbers[part], minlength=len(counts[part]))
        for part, (total, count) in enumerate(zip(totals, counts, strict=True)):
            entry, position = np.nonzero(np.broadcast_to(count[:, None] > 0, total.shape))
            yield pa.RecordBatch.from_pydict({"part": np.full(len(entry), part, np.int64), "entry": entry, "position": position, "n": count[entry], "total": total[entry, position]})

    parts = _assigned(rows, books, "part long, entry long, position long, n long, total long", sums)
    means = parts.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.copy() for b in books]
    for r in means.collect():  # a row a component of the codebooks
        out[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return out


def encode(vectors: DataFrame) -> DataFrame:
    """vectors: vec_id, embedding, label. vec_id, code, error, label_error and codebooks_sha256 of each vector."""
    spark, kind = vectors.sparkSession, vectors.select("label").schema[0].dataType.simpleString()
    rows, order = whole(vectors, SCALE, "label"), (F.asc_nulls_last("vec_id"), "v")
    first = rows.select("vec_id", "v").orderBy(*order).first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    length = len(first["v"])
    rows = materialize(rows.filter(F.size("v") == length), "codes-vectors")
    start = np.array([r["v"] for r in rows.select("vec_id", "v").orderBy(*order).limit(ENTRIES).collect()], np.int64).reshape(-1, length)
    books = [start[:, cut] for cut in _cuts(length)]
    for _ in range(ROUNDS):
        books = learn(rows, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def shown(found) -> Iterator[pa.RecordBatch]:
        for batch, _, numbers, squares in found:
            code = ["".join(x) for x in digits[np.stack(numbers, axis=1)].tolist()]
            error = [min(LARGEST, int(x)) for x in sum(squares).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = materialize(_assigned(rows, books, f"vec_id long, label {kind}, code string, error long", shown), "codes-found")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
