"""SimHash near-dedup with vantage-point trees.

Fingerprints within three bits differ in one bit at most in one of their halves, so there are two
trees, one a half. A node splits at distance mu from its vantage point, measured in its half
(radius 1) or in all bits (radius 3), whichever separates better. By the triangle inequality two
fingerprints within the radius can lie on both sides only if the outer one is within mu + radius; such
boundary fingerprints go to the inner side too. So every close pair meets in a shard.

The upper tree is fitted to a bounded sample (SAMPLE fingerprints by hash order) and deals all
distinct fingerprints to shards. A shard of more than 2 * SHARD_ROWS rows is dealt again by a tree fitted to
itself, until no shard is larger that a tree can take apart. Each shard goes on splitting as far as it
pays and compares what is left exactly. It returns edges that join what links, a forest rather than all pairs, so a group of
a million near copies gives a million rows at most; components() joins the forests.

Defined results: null and word-less texts have fingerprint 0 and link like any other; repeated rows
share a component; rows with a null id get the smallest id of their component, null if it has none;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .base import discard, fresh, materialize, row_hash
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
SAMPLE = 32_768
SHARD_ROWS = 4096
LEAF_ROWS = 512
COMPARED = 1 << 22
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, as a signed number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < SHINGLE else list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        part = grams[at : at + (1 << 16)]
        h = np.fromiter(map(xxh64_intdigest, part, repeat(SEED)), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(grams), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint, na_action=None).astype("int64")


def _distance(x: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ vantage) & mask)


def best_split(x: np.ndarray, half: int, rng: np.random.Generator, tries: int = 6) -> tuple | None:
    """The vantage point, mask, radius and mu that leave the least to compare, or None if no split
    leaves less than nine tenths of it."""
    best, least = None, 0.9 * float(len(x)) ** 2
    for vantage in x[rng.integers(0, len(x), tries)]:
        for mask, radius in ((HALVES[half], RADIUS // 2), (ALL, RADIUS)):
            through = np.cumsum(np.bincount(_distance(x, vantage, mask), minlength=65 + radius))
            inner, outer = through[radius : radius + 65].astype(float), len(x) - through[:65].astype(float)
            cost = inner**2 + outer**2
            mu = int(np.argmin(cost))
            if cost[mu] < least:
                best, least = (vantage, mask, radius, mu), cost[mu]
    return best


def sides(x: np.ndarray, split: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Which of x go to the inner and to the outer side; boundary ones go to both."""
    vantage, mask, radius, mu = split
    d = _distance(x, vantage, mask)
    return d <= mu + radius, d > mu


def grow(sample: np.ndarray, half: int, leaf: int) -> list[tuple]:
    """A tree as a list of nodes (split, inner node, outer node); a leaf has split None."""
    nodes: list[tuple] = [(None, 0, 0)]
    todo, rng = [(0, sample)], np.random.default_rng(half)
    while todo:
        at, x = todo.pop()
        split = best_split(x, half, rng) if len(x) > leaf else None
        if split is not None:
            inner, outer = sides(x, split)
            nodes[at] = (split, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), x[inner]), (len(nodes) + 1, x[outer])]
            nodes += [(None, 0, 0)] * 2
    return nodes


def deal(x: np.ndarray, nodes: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, those of x that it gets)"""
    todo = [(0, x)]
    while todo:
        at, part = todo.pop()
        split, inner, outer = nodes[at]
        if split is None:
            yield at, part
            continue
        here, there = sides(part, split)
        todo += [(n, y) for n, y in ((inner, part[here]), (outer, part[there])) if len(y)]


def _absorb(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a dense set from each point to the one that its component was reached from. What a
    front of points reaches leaves the set at once, so no pair is looked at twice."""
    left = np.arange(len(x))
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in front[:64]:
                near |= np.bitwise_count(x[left] ^ x[i]) <= RADIUS
            found = left[near]
            yield from ((int(j), int(root)) for j in found)
            front, left = np.concatenate([front[64:], found]), left[~near]


def forest(x: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) that join all of x that links, by comparing all, COMPARED pairs at a time."""
    edges: list[tuple[int, int]] = []
    at = 0
    while at < len(x):
        n = max(1, COMPARED // (len(x) - at))
        i, j = np.nonzero(np.bitwise_count(x[at : at + n, None] ^ x[None, at:]) <= RADIUS)
        up = i < j
        edges += zip((i[up] + at).tolist(), (j[up] + at).tolist(), strict=True)
        if len(edges) > 8 * len(x) + 64:
            return list(_absorb(x))
        at += n
    return edges


def shard_links(x: np.ndarray, half: int, leaf: int = LEAF_ROWS) -> pd.DataFrame:
    """Edges between the fingerprints of a shard, by a tree grown on them."""
    pairs = [np.zeros((0, 2), np.int64)]
    for _, part in deal(x, grow(x, half, leaf)):
        if edges := forest(part):
            pairs.append(part.view(np.int64)[np.asarray(edges)])
    return pd.DataFrame(np.unique(np.concatenate(pairs), axis=0), columns=["a", "b"])


def _half(shard: int) -> int:
    return (shard if shard >= 0 else ~shard) & 1


def _inner(shard: int, leaf: int) -> int:
    """The name of a part of a shard, of the same half. Two parts of one name would only be searched together."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{shard}.{leaf}") >> 2 << 1 | _half(shard)


def _dealt(parts: Iterator[tuple[int, np.ndarray]]) -> pd.DataFrame:
    """Rows of (shard, fingerprints)."""
    held = list(parts)
    shard = np.repeat(np.array([s for s, _ in held], np.int64), [len(x) for _, x in held])
    return pd.DataFrame({"shard": shard, "fp": np.concatenate([np.zeros(0, np.uint64), *(x for _, x in held)]).view(np.int64)})


def split_again(routed: DataFrame, shard_rows: int) -> DataFrame:
    """The shards with more than shard_rows rows, dealt to smaller ones, each by a tree fitted to a sample
    of its own rows, and the others as they are. Dense shards, which no tree takes apart, stay whole; their names are negative."""
    large = routed.groupBy("shard").agg(F.count("*").alias("n")).filter((F.col("n") > shard_rows) & (F.col("shard") >= 0))
    large = materialize(large.select(F.col("shard").alias("of")), "simhash-large")
    if large.isEmpty():
        return routed

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        name, x = int(rows["shard"].iloc[0]), rows["fp"].to_numpy(np.int64).view(np.uint64)
        sample = np.sort(x)[:: -(-len(x) // SAMPLE)]
        nodes = grow(sample, _half(name), max(32, shard_rows * len(sample) // len(x)))
        return rows.assign(shard=~name) if len(nodes) == 1 else _dealt((_inner(name, at), part) for at, part in deal(x, nodes))

    again = routed.join(large, F.col("shard") == F.col("of"), "left_semi").groupBy("shard").applyInPandas(split, "shard long, fp long")
    rest = routed.join(large, F.col("shard") == F.col("of"), "left_anti")
    return split_again(materialize(rest.unionByName(again), "simhash-split"), shard_rows)


def links(prints: DataFrame, shard_rows: int = SHARD_ROWS, leaf: int = LEAF_ROWS) -> DataFrame:
    """prints: fp, distinct. Edges (a, b) whose components are those of all links."""
    spark = prints.sparkSession
    n = prints.count()
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [grow(sample, half, max(32, int(shard_rows * len(sample) / max(n, 1)))) for half in (0, 1)] if n else [[(None, 0, 0)]] * 2

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy(np.int64).view(np.uint64)
            yield _dealt((2 * at + half, part) for half, nodes in enumerate(trees) for at, part in deal(x, nodes))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        return shard_links(rows["fp"].to_numpy(np.int64).view(np.uint64), _half(int(rows["shard"].iloc[0])), leaf)

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n // (8 * shard_rows))
    routed = materialize(prints.repartition(width).mapInPandas(route, "shard long, fp long"), "simhash-routed")
    # A sample's tree leaves shards of about shard_rows; twice that is split again.
    dealt = split_again(routed, 2 * shard_rows).repartition(width, "shard")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def _components(rows: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows: doc_id, fp; join gives the edges between distinct ones. doc_id, fp, component_id (null if no
    row of the component has an id) and root (of a component)."""
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    found = materialize(components(join(prints.select("fp"))), "simhash-roots")
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    smallest = members.join(prints, "fp").groupBy("root").agg(F.min("first").alias("component"))
    named = prints.join(members.join(smallest, "root"), "fp", "left")
    # Without links a component is one fingerprint; with them, `component` knows all its ids.
    component = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component"))
    named = materialize(named.select(F.col("fp").alias("of"), component.alias("component_id"), F.coalesce("root", "fp").alias("root")), "simhash-components")
    return rows.join(named, F.col("fp") == F.col("of")).drop("of")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, fingerprint (hex) and component_id of every row."""
    rows = materialize(docs.select("doc_id", fingerprint_udf(F.col("text").cast("string")).alias("fp")), "simhash-rows")
    return _components(rows, links).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close_sets(rows: DataFrame) -> DataFrame:
    """rows: fp, n, print (near_copies.py). Candidates for near copies, a, b, n_a and n_b: sets of one fingerprint with the
    smallest of them, and these along the forests of the vantage-point trees."""
    sets = materialize(rows.select("fp", "n", "print").distinct(), "simhash-sets")
    first = materialize(sets.groupBy("print").agg(F.min(F.struct("fp", "n")).alias("first")).select("print", "first.fp", "first.n"), "simhash-firsts")
    end = lambda c: first.select(F.col("print").alias(f"print_{c}"), F.col("fp").alias(c), F.col("n").alias(f"n_{c}"))
    alike = sets.join(end("a"), F.col("print") == F.col("print_a")).select("a", F.col("fp").alias("b"), "n_a", F.col("n").alias("n_b"))
    found = links(first.select(F.col("print").alias("fp"))).distinct().withColumnsRenamed({"a": "print_a", "b": "print_b"})
    across = found.join(end("a"), "print_a").join(end("b"), "print_b").select("a", "b", "n_a", "n_b")
    close = materialize(alike.filter("a <> b").unionByName(across), "simhash-close")
    discard(sets, first)
    return close


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, with all columns, one row of each component of near copies (near_copies.py: five-word shingles,
    similarity 0.8 or more; the trees first, then the rest): the one with the smallest id, rows without an id being last. Among rows of one id the
    smallest hash of the whole row decides, so reruns agree; of rows that are equal throughout one stays."""
    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").alias("id"), row_hash(docs).alias("row"), text.alias("text"))
    rows = materialize(named.select("id", "row", "text", near_copies.sketch_udf("text").alias("s")).select("id", "row", "text", "s.*"), "copies-rows")
    close = close_sets(rows)
    roots = materialize(components(near_copies.links(rows, close)), "copies-groups")
    placed = rows.select("id", "row", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("id", "row", F.coalesce("root", "fp").alias("root"))
    # Equal rows first: they may be a third of all.
    counted = placed.groupBy("root", "id", "row").agg(F.count("*").alias("n"))
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "n")).alias("first"))
    of, of_row = fresh(docs, "of", "of_row")
    kept = materialize(first.select(F.col("first.id").alias(of), F.col("first.row").alias(of_row), F.col("first.n").alias("n")), "copies-kept")
    discard(rows, close, roots)
    here = docs.withColumn(own := fresh(docs, "row")[0], row_hash(docs))
    out = here.join(kept.drop("n"), F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(of_row)), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", own])
    return out.drop(own)
