"""Phrases, exact search and vector codes against plain versions, on odd rows, ties, copies and empty tables."""

import collections
import hashlib
import heapq
import math
import random
import re
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import codes, collocations, queries, top_k
from quillon.llm.vectors import LIMIT

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label string"


# op11


def plain_phrases(docs, min_count=10, reported=2000):
    count, total = collections.Counter(), collections.Counter()
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in (1, 2, 3):
                count.update((lang or "und", *words[i : i + n]) for i in range(len(words) - n + 1))
    found = {p: a for p, a in count.items() if a >= min_count and len(p) > 2}
    rows = collections.defaultdict(list)
    for (lang, *words), a in found.items():
        if any(p[0] == lang and len(p) - 1 > len(words) and 100 * b >= 50 * a and any(list(p[i : i + len(words)]) == words for i in range(1, len(p))) for p, b in found.items()):
            continue
        cuts = [(count[(lang, *words[:k])], count[(lang, *words[k:])], k) for k in range(1, len(words))]
        score, _, left, right = min((math.floor(Fraction(1_000_000 * a * a, x * y)), k, x, y) for x, y, k in cuts)
        rows[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, n, p.decode(), -a, x, y, total[lang], -s) for lang, found in rows.items() for n, (s, a, p, x, y) in enumerate(heapq.nsmallest(reported, found), 1)}


def phrases(df, **options):
    return {tuple(r) for r in collocations.mine(df, **options).collect()}


def test_op11_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {tuple(r) for r in queries.op11_collocations(spark, SMALL).collect()}
    assert got == plain_phrases([(r.text, r.lang) for r in docs.collect()]) and len(got) > 100


def test_phrases_of_odd_texts_alike_by_broadcast_and_by_shuffle(spark):
    rng, letters = random.Random(4), ["a", "B", "é", "É", "x-y", "日本", "\x85", "\x00"]
    texts = ["".join(rng.choice(letters) + rng.choice([" ", " ", "  ", "\t", ".", ", ", "\n", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["", None, "...", " \t ", "hot pair of words. " * 200] + ["the same text, again and again"] * 40
    rows = [(n % 7 or None, t, rng.choice(["x", "y", None, "und"])) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("at", "row", "id", "code", "word", "f", "l")})
    want = plain_phrases([r[1:] for r in rows])
    assert phrases(df) == want and len(want) > 60
    assert phrases(df, max_broadcast_bytes=0) == want
    assert phrases(df, reported=3) == plain_phrases([r[1:] for r in rows], reported=3)
    assert phrases(df.limit(0)) == set() == phrases(df.limit(1))
    assert not spark.catalog.listTables()  # the relations are gone


def test_counts_whose_products_pass_64_bits(spark):
    one = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_000_000_007)], "a long, l long, r long")
    want = 1_000_000 * 3_000_000_000**2 // (3_000_000_001 * 3_000_000_007)
    assert one.select(collocations._score("a", "l", "r")).first()[0] == want


def test_phrases_of_one_very_long_text(spark):
    df = spark.createDataFrame([(1, "over and over " * 60_000, "x")], "doc_id long, text string, lang string")
    got = phrases(df)
    assert {r[2] for r in got} == {"over and over", "and over over", "over over and"} and {r[6] for r in got} == {180_000}


def test_the_join_of_relations_takes_no_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("row"), F.col("id").cast("int").alias("at"), F.col("id"))
    relation = collocations.Relation(rows)
    with collocations.co_located(spark):
        plan = collocations._extended(relation, relation, 1000)._jdf.queryExecution().executedPlan().toString()
    relation.drop()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# op12


def usable(rows, scale):
    return [(i, [max(-LIMIT, min(LIMIT, math.floor(scale * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain_top(rows, asked, k):
    out, kept = set(), usable(rows, 256)
    for q in sorted({i for i, *_ in asked if i is not None}):
        mine = [v for i, v, _ in usable(asked, 256) if i == q]
        if mine:
            v = min(mine)
            scores = [(-max(-(1 << 62), min(1 << 62, sum(a * b for a, b in zip(v, w, strict=True)))), i is None, i or 0) for i, w, _ in kept if i != q and len(w) == len(v)]
            out |= {(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def odd_vectors(rng, n):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(n + i, [0.5] * 8, "hot") for i in range(n)]  # a third of all, and ties
    rows += [(100, [0.1, -0.1] * 4, "a"), (100, [0.2] * 8, "b"), (None, [0.5] * 8, "a"), (None, None, None), (5000, [0.5] * 7, "a"), (5050, [], None), (5100, [], "a")]
    return rows + [(5200, [None] * 8, "a"), (5250, [math.nan] * 8, "a"), (5300, [math.inf] + [0.0] * 7, None), (5350, [1e300, -1e9] * 4, "big"), (5400, [-0.0] * 8, "a")]


def test_op12_equals_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {tuple(r) for r in queries.op12_top_k(spark, SMALL).collect()}
    assert got == plain_top(rows, [r for r in rows if r[0] % 50 == 0], 5) and len(got) == 50


def test_search_of_odd_vectors_in_one_block_and_in_many(spark):
    rows = odd_vectors(random.Random(7), 60)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("v", "score", "size", "q", "bin")})
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0]
    queries_ = df.filter("vec_id is null or vec_id % 10 = 0")
    for k, block in ((5, 1 << 20), (3, 200), (200, 1 << 20)):
        got = [tuple(r) for r in top_k.top(df, queries_, k, block).collect()]
        assert set(got) == plain_top(rows, asked, k)
    assert top_k.top(df.limit(0), queries_).count() == 0 == top_k.top(df, queries_.limit(0)).count()


# op13


def plain_codes(rows):
    kept = sorted(usable(rows, 1024), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    cuts = [slice(size * i // 4, size * (i + 1) // 4) for i in range(4)]
    books = [[v[c] for _, v, _ in kept[:256]] for c in cuts]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), n) for n, y in enumerate(book))
    for _ in range(4):
        for c, book in zip(cuts, books, strict=True):
            got = collections.defaultdict(list)
            for _, v, _ in kept:
                got[nearest(v[c], book)[1]].append(v[c])
            for n, parts in got.items():
                book[n] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], collections.Counter()
    for i, v, label in kept:
        found = [nearest(v[c], b) for c, b in zip(cuts, books, strict=True)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    top = (1 << 63) - 1
    return sorted(((i is None, i or 0), code, min(top, e), min(top, by_label[label]), digest) for i, code, e, label in out)


def coded(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.encode(df).collect())


def test_op13_equals_a_plain_version(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = queries.op13_vector_codes(spark, SMALL)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(((False, r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == plain_codes([tuple(r) for r in df.collect()])


def test_codes_of_odd_vectors(spark):
    rows = odd_vectors(random.Random(8), 150)
    assert coded(spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("v", "code", "of", "part")})) == plain_codes(rows)
    few = [(n, [float(n), 0.25, -n / 7], None) for n in range(5)]  # a length that four doesn't divide
    assert coded(spark.createDataFrame(few, VECTORS)) == plain_codes(few)
    assert coded(spark.createDataFrame([(1, None, "a")], VECTORS)) == [] == coded(spark.createDataFrame([], VECTORS))


def test_tree_finds_the_lowest_of_the_nearest_and_passes_over_others():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (12, 3))
    for entries in (rng.integers(-3, 4, (256, 3)), centres[rng.integers(0, 12, 256)] + rng.integers(-20, 21, (256, 3)), np.zeros((256, 3), np.int64), rng.integers(-9, 9, (5, 3)), rng.integers(-(1 << 40), 1 << 40, (64, 3))):
        points = np.concatenate([entries, entries + rng.integers(-2, 3, entries.shape)])
        tree = codes.Gnat(entries)
        number, squares = tree.nearest(points)
        exact = ((points.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
        assert number.tolist() == [min(range(len(entries)), key=lambda n, row=row: (row[n], n)) for row in exact] and [int(x) for x in squares] == exact.min(axis=1).tolist()
        if abs(entries).max() > 1000 and len(entries) == 256:
            assert tree.compared < 0.3 * len(points) * len(entries)  # clusters far apart are passed over
