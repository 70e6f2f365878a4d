"""Near copies: pairs of texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more.

Words are those of simhash.py (bytes, A-Z folded). A text of fewer words than a shingle is one shingle.
Texts with one set are one node. The first candidates are what the vantage-point trees of simhash.py find: sets whose
64-bit fingerprints differ in three bits or fewer. Those that are similar are joined. Texts of similarity 0.8 differ in 9.7 bits on average, beyond any
radius for which trees pass over something, so the rest is found in an exact way that skips what is joined.
Its candidates share a MinHash band (BANDS bands of ROWS minima): a
pair of similarity 0.8 misses all bands with probability (1 - 0.8**5)**20, 0.04 %. Links between candidates are
found exactly, without comparing all pairs of a band's bucket:

1. Each bucket has a hub, the member that shares most buckets with others (in a group of copies, what they were
   copied from). Every member not yet joined with the hub is compared with it; the links give components.
2. What the hubs leave open is searched by differences. D(x) is the symmetric difference of x and the
   hub h. x and y link if and only if |D(x) ^ D(y)| <= (|x| + |y|) / 9. Of two members in different components one, x,
   is apart from h, so |D(x)| > (|x| + |h|) / 9, and it follows that D(x) and D(y) share at least
   t = (|D(x)| + |D(y)| - (|x| + |y|) / 9) / 2 > 0 elements. In the order of their frequency the first
   one they share is among the first |D| - t + 1 of both: an equi-join on (hub, element) with that
   condition gives the candidates, which are compared in full. Copies with changes of their own have nothing rare in
   common and meet nobody.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import discard, materialize, release
from .components import components

SHINGLE = 5
SIMILAR = (4, 5)
BANDS, ROWS = 20, 5
SEED = 42
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = {b" ".join(words)} if len(words) < SHINGLE else set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    return np.sort(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), "<u8", len(grams)))


def name(found: np.ndarray) -> int:
    """A signed number for a set of shingles; 0 for none."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else 0


def bands(found: np.ndarray) -> list[int]:
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024, None] * FACTORS + TERMS).min(axis=0), out=least)
    digests = [xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def fingerprint(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set, as a signed number: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


SKETCH = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.pandas_udf(SKETCH)
def sketch_udf(texts: pd.Series) -> pd.DataFrame:
    release()
    sets = map(shingles, texts)
    return pd.DataFrame([(name(s), len(s), fingerprint(s), bands(s)) for s in sets], columns=["fp", "n", "print", "bands"]).astype({"fp": "int64", "n": "int32", "print": "int64"})


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


@F.pandas_udf(T.BooleanType())
def similar_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    release()
    last, found, out = None, None, []
    for a, b in zip(left, right, strict=True):
        if a != last:
            last, found = a, shingles(a)
        out.append(similar(found, shingles(b)))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(T.ArrayType(T.LongType()))
def difference_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    release()
    last, found, out = None, None, []
    for a, b in zip(left, right, strict=True):
        if a != last:
            last, found = a, shingles(a)
        out.append(np.setxor1d(found, shingles(b), assume_unique=True).view(np.int64))
    return pd.Series(out)


def _with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    side = lambda c, t: texts.select(F.col("fp").alias(c), F.col("text").alias(t))
    return pairs.join(side(b, "text_b"), b).join(side(a, "text_a"), a)


def _verified(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """Of pairs (a, b) those that are similar."""
    return materialize(_with_texts(pairs, texts, "a", "b").filter(similar_udf("text_a", "text_b")).select("a", "b"), label)


def _fit(n_a: str, n_b: str) -> Column:
    """Whether sizes allow the similarity."""
    return F.least(n_a, n_b) * SIMILAR[1] >= F.greatest(n_a, n_b) * SIMILAR[0]


def _spokes(rows: DataFrame) -> DataFrame:
    """hub, n_hub, fp, n: the members of the buckets and their hubs."""
    keys = rows.select("fp", "n", F.explode("bands").alias("key")).distinct()
    sizes = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = materialize(keys.join(sizes, "key"), "copies-members")
    ranked = members.join(members.groupBy("fp").agg(F.sum("m").alias("met")), "fp")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("met", F.xxhash64("fp").alias("h"), "fp", "n")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("n_hub"))
    spokes = materialize(members.join(hubs, "key").filter("fp <> hub").select("hub", "n_hub", "fp", "n").distinct(), "copies-spokes")
    discard(members)
    return spokes


def _placed(spokes: DataFrame, roots: DataFrame) -> DataFrame:
    """The spokes, each with the root of its member and whether the hub has another one."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    placed = spokes.join(of("fp"), "fp", "left").join(of("hub"), "hub", "left")
    placed = placed.withColumns({"root": F.coalesce("root_fp", "fp"), "apart": F.coalesce("root_fp", "fp") != F.coalesce("root_hub", "hub")})
    return placed.select("hub", "n_hub", "fp", "n", "root", "apart")


def _by_difference(spokes: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one hub that may link though their components differ."""
    placed = materialize(_placed(spokes, roots), "copies-placed")
    open_hubs = placed.groupBy("hub").agg(F.count("*").alias("n_members"), F.max("apart").alias("any")).filter("n_members > 1 and any")
    unlike = _with_texts(placed.join(open_hubs.select("hub"), "hub"), texts, "hub", "fp").withColumn("d", difference_udf("text_a", "text_b"))
    unlike = materialize(unlike.select("hub", "n_hub", "fp", "n", "root", "apart", "d"), "copies-unlike")
    elements = unlike.select("hub", "n_hub", "fp", "n", "root", "apart", F.size("d").alias("n_d"), F.explode("d").alias("e"))
    # Elements that one member alone has count as its rarest and lead to nobody.
    shared = elements.groupBy("hub", "e").agg(F.count("*").alias("n_with")).filter("n_with > 1")
    own = Window.partitionBy("hub", "fp")
    nth = F.row_number().over(own.orderBy("n_with", "e")) + F.col("n_d") - F.count("*").over(own)
    both = F.col("n") + F.col("n_hub")
    # What a member shares with any it may link to, at least: as x, which is apart, and as y.
    as_x = F.floor((F.col("n_d") - both / 9.0) / 2 - 1e-9)
    as_y = F.floor((F.col("n_d") - F.greatest(F.col("n") - F.col("n_hub"), F.lit(0)) / 9.0) / 2 - 1e-9)
    marked = elements.join(shared, ["hub", "e"]).withColumns({"nth": nth, "x": F.col("apart") & (nth <= F.col("n_d") - F.greatest(as_x, F.lit(0))), "y": nth <= F.col("n_d") - F.greatest(as_y, F.lit(0))})
    marked = materialize(marked.filter("x or y").select("hub", "e", "fp", "n", "root", "n_d", "nth", "x", "y"), "copies-elements")
    other = marked.filter("y").select(*[F.col(c).alias(f"{c}_2") for c in ("hub", "e", "fp", "n", "root", "n_d", "nth")])
    least = F.greatest(F.ceil((F.col("n_d") + F.col("n_d_2") - (F.col("n") + F.col("n_2")) / 9.0) / 2 - 1e-9), F.lit(1))
    early = (F.col("nth") <= F.col("n_d") - least + 1) & (F.col("nth_2") <= F.col("n_d_2") - least + 1)
    met = marked.filter("x").join(other, (F.col("hub") == F.col("hub_2")) & (F.col("e") == F.col("e_2")) & (F.col("root") != F.col("root_2")) & _fit("n", "n_2") & early)
    pairs = materialize(met.select(F.least("fp", "fp_2").alias("a"), F.greatest("fp", "fp_2").alias("b")).distinct(), "copies-pairs")
    discard(placed, unlike, marked)
    return pairs


def links(rows: DataFrame, close: DataFrame) -> DataFrame:
    """rows: text, fp, n, bands; close: a, b, n_a, n_b, candidates from the fingerprints. Edges (a, b) between sets, whose
    components are those of all similar pairs that share a band, and of the similar ones of close."""
    spokes = _spokes(rows)
    parts = (spokes.select("fp"), spokes.select(F.col("hub").alias("fp")), close.select(F.col("a").alias("fp")), close.select(F.col("b").alias("fp")))
    ends = reduce(DataFrame.unionByName, parts).distinct()
    texts = materialize(rows.select("fp", "text").join(ends, "fp", "left_semi").dropDuplicates(["fp"]), "copies-texts")
    edges = _verified(close.filter(_fit("n_a", "n_b")).select("a", "b"), texts, "copies-close")
    joined = materialize(components(edges), "copies-joined")
    left = _placed(spokes, joined).filter(F.col("apart") & _fit("n", "n_hub"))
    edges = edges.unionByName(_verified(left.select(F.col("hub").alias("a"), F.col("fp").alias("b")), texts, "copies-edges"))
    roots = materialize(components(edges), "copies-roots")
    edges = edges.unionByName(_verified(_by_difference(spokes, roots, texts), texts, "copies-more"))
    discard(spokes, texts, joined, roots)
    return edges
