import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import components, langid, near_copies, secrets, simhash, substring_dedup, toxicity
from quillon.llm.base import materialize
from tests.llm.test_files_and_chat import frame

SMALL = "/root/testdata/sf0.001"


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(int(prints[i]) ^ int(prints[j])).count("1") <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(int(prints[i]))
    return {x: min(g) for g in groups.values() for x in g}


def clustered(rng, n):
    """Fingerprints at random, some with chains and dense balls of close ones around them."""
    out = {int(x) for x in rng.integers(0, 1 << 63, n, dtype=np.uint64)}
    for base in list(out)[: n // 10]:
        x = base
        for _ in range(6):
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            out.add(x)
    dense = next(iter(out))
    out |= {dense ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}
    return np.array(sorted(out), np.uint64)


def test_vantage_trees_lose_no_link(spark):
    x = clustered(np.random.default_rng(5), 1500)
    prints = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    edges = simhash.links(prints, shard_rows=200, leaf=40)
    assert edges.filter("a = b").isEmpty() and edges.count() < 4 * len(x)
    found = {r.node & (2**64 - 1): r.root for r in components.components(edges).collect()}
    want = brute_components(x)
    label = lambda v: found.get(v, int(np.uint64(v).view(np.int64)))
    groups = {}
    for v, root in want.items():
        groups.setdefault(root, set()).add(label(v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 8), (8, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_cases(spark):
    rows = [(5, "a b c d e f g h i j", None), (4, "A  b c d e f g h i j\n", None), (7, None, None), (8, "", None), (None, " \t", None), (9, "one two", None), (9, "one two", None), (None, "nobody else", None)]
    found = simhash.near_dedup(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.component_id) for r in found}
    assert by == {(5, 4), (4, 4), (7, 7), (8, 7), (None, 7), (9, 9), (None, None)}
    assert {r.fingerprint for r in found if r.component_id == 7} == {"0" * 16}
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 4, "A  b c d e f g h i j\n"), (False, 7, None), (False, 9, "one two"), (True, 0, "nobody else")]
    assert simhash.near_dedup(frame(spark, [])).count() == 0


def test_vantage_trees_alone_join_close_texts(spark, monkeypatch):
    """The fingerprints of the method find copies within three bits without any MinHash band."""
    rng = random.Random(5)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(3000)] for _ in range(20)]
    changed = [[*w[:-1], "other"] for w in words]
    rows = [(i, " ".join(w), None) for i, w in enumerate(words + changed)]
    prints = [near_copies.fingerprint(near_copies.shingles(t)) for _, t, _ in rows]
    near = [i for i in range(20) if ((prints[i] ^ prints[i + 20]) & (1 << 64) - 1).bit_count() <= 3]
    spokes = near_copies._spokes
    monkeypatch.setattr(near_copies, "_spokes", lambda rows: materialize(spokes(rows).limit(0), "no-spokes"))
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert len(near) >= 15 and not kept & {i + 20 for i in near} and kept >= set(range(20))


def test_keep_one_joins_all_texts_of_similarity_four_fifths(spark):
    rng, texts = random.Random(3), []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(6):  # chains: each a few words from the last
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    far = [i for i in range(len(texts)) if root[i] < i and (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[root[i]])).bit_count() > 3]
    assert len(set(root)) < len(texts) and far
    kept = simhash.keep_one(frame(spark, [(i, t, None) for i, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert near_copies.similar(near_copies.shingles("A b c d e f"), near_copies.shingles("a B  c d e f"))


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = langid.identify(docs.filter(held), docs.filter(~held)).select("lang", "langid.*").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark):
    training = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "x", None), (4, None, "de")], "doc_id long, text string, lang string")
    odd = frame(spark, [(1, None, None), (2, "12 !? ½", None), (3, "chatte", None), (4, "dogs", None), (5, "日本語", None), (5, "日本語", None)])
    got = {r.doc_id: r.langid for r in langid.identify(odd, training).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert got[3].lang_pred == "fr" and got[4].lang_pred == "en" and got[5].lang_pred in ("en", "fr")
    nothing = langid.identify(odd, training.limit(0)).collect()
    assert {r.langid.lang_pred for r in nothing} == {"und"}
    assert langid.identify(odd.limit(0), training).count() == 0


def brute_substring(rows):
    first, want = {}, []
    for i, words in rows:
        for p in range(len(words) - 12):
            k = tuple(words[p : p + 13])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    for i, words in rows:
        gone = set()
        for p in range(len(words) - 12):
            if i is not None and first[tuple(words[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = [w for n, w in enumerate(words) if n not in gone]
        want.append((i is None, i or 0, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)] for n in (13, 14, 19, 30, 60, 12)]
    rows = [(1, None), (2, ""), (3, "x " * 40), (4, "x " * 40), (4, "x " * 30), (None, " ".join(passages[3])), (None, "x " * 20)]
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [str(rng.randrange(10**6)) for _ in range(rng.randrange(20))]
        rows.append((rng.randrange(10, 60), " \n".join(words)))
    docs = frame(spark, [(i, t, None) for i, t in rows]).repartition(5)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs).collect())
    assert found == brute_substring([(i, (t or "").encode().split()) for i, t in rows])


def test_packed_planes_round_trip():
    a = np.random.default_rng(0).integers(0, 1 << 40, 100, dtype=np.int64)
    assert (substring_dedup.unplanes(substring_dedup.planes(a), "<i8") == a).all()


def test_secret_rules_and_scan(spark):
    texts = {
        1: 'x password=abc123 API_KEY: "Zz/9+.-=" token = short secret=12345',
        2: "AKIA" + "B" * 16 + " AKIAXY " + "0123456789abcdef01234567" + " é" + "f" * 23,
        3: None,
        4: "",
    }
    got = {r.doc_id: r for r in secrets.scan(frame(spark, [(i, t, None) for i, t in texts.items()] + [(None, "passwd:'x'", None)]), secrets.train(frame(spark, []))).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 0, 0)
    assert got[1].spans == "assign:2:17,assign:18:36"
    assert got[2].spans == "access:0:20,hex:28:52"
    assert got[3].base_sha256 == got[4].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_assign == 0
    assert secrets.scan(frame(spark, []), secrets.train(frame(spark, []))).count() == 0


def test_network_learns_secret_forms():
    rng = random.Random(0)
    pick = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    text = [(f"some words {pick(40, '0123456789abcdef')} more", 1) for _ in range(150)] + [(f"card {pick(16, '0123456789')} more", 0) for _ in range(150)]
    x = np.stack([secrets.encode(t, *secrets.candidates(t)[0]) for t, _ in text])
    y = np.array([c for _, c in text], float)
    order = np.random.default_rng(0).permutation(len(x))
    x, y = x[order], y[order]
    net = secrets.Network.new(np.random.default_rng(1))
    net.fit(x[:200], y[:200], np.random.default_rng(2))
    net.calibrate(x[200:], y[200:])
    p = net.probability(x[200:])
    assert ((p >= net.threshold) == (y[200:] == 1)).mean() > 0.95 and ((p >= 0) & (p <= 1)).all()


def test_runs_of_any_form_are_scored_to_their_end():
    net = secrets.Network.new(np.random.default_rng(1))
    long = "/".join(["abcdefgh"] * 30)
    texts = ["", "x" * 6, "short password=abcdef and letters é " + long + "0123456789", "日本 secrets \0 qwerty", "xy" * 41, "z" * 40, "w" * 60]
    bases = [secrets.rule_spans(t) for t in texts]
    nth, start, end, p = secrets.chances(texts, bases, net)
    want = [(i, s, e) for i, t in enumerate(texts) for s, e in secrets.candidates(t) if not any(x < e and s < y for x, y, _ in bases[i])]
    assert list(zip(nth, start, end, strict=True)) == want and (1, 0, 6) in want and len(want) == 8
    slow = [max(net.probability(np.stack([secrets.encode(texts[i], a, b) for a, b in secrets.pieces(s, e)]))) for i, s, e in want]
    assert np.allclose(p, slow, atol=1e-5)
    assert all({x for a, b in secrets.pieces(s, e) for x in range(a, b)} == set(range(s, e)) for _, s, e in want)


def english():
    grams = {}
    for w in "idiot clown worthless the and cool look letter stupid is it a".split() * 5:
        marked = toxicity.EDGE * 2 + w + toxicity.EDGE
        for i in range(len(marked) - 2):
            grams[marked[i : i + 3]] = grams.get(marked[i : i + 3], 0) + 1
    return toxicity.Language(grams)


@pytest.mark.parametrize(("seen", "meant"), [("1d10t", "idiot"), ("i d i o t", "idiot"), ("idiooooot", "idiot"), ("c.l.0.w.n", "clown"), ("$tup1d", "stupid"), ("w0rthle$$", "worthless")])
def test_viterbi_restores(seen, meant):
    assert meant in toxicity.Reader(english()).words(f"the {seen} and it")


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_reader_takes_any_text(text):
    assert isinstance(toxicity.Reader(english()).words(text), set)
    assert all(0 <= s < e <= len(text) for s, e in secrets.candidates(text))


def test_language_of_the_decoder_covers_unlabelled_texts(spark):
    docs = frame(spark, [(1, "labelled words", None), (2, "a zyxwv here", None), (3, None, None), (None, "qjq", None)])
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {"zyx", "wv" + toxicity.EDGE, "qjq", "lab"} < set(model.language.threes)


def test_spaced_words_of_two_letters_are_decoded():
    grams = {toxicity.EDGE * 2 + "a": 5, toxicity.EDGE + "as": 5, "ass": 5, "ss" + toxicity.EDGE: 5}
    assert "ass" in toxicity.Reader(toxicity.Language(grams)).words("an a s s here")
    assert "ass" not in toxicity.Reader(toxicity.Language(grams)).words("an s s s here")


def test_toxicity_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.filter(~held))
    rows = toxicity.score(docs.filter(held), model).join(labels, "doc_id").select("toxicity", "toxic").collect()
    toxic, clean = ([r.toxicity for r in rows if r.toxic == c] for c in (1, 0))
    assert sum(s >= 0.5 for s in toxic) > 0.8 * len(toxic) and sum(s >= 0.5 for s in clean) < 0.02 * len(clean)
    odd = frame(spark, [(1, None, None), (2, "", None), (2, "", None), (None, "x", None)])
    assert len({round(r.toxicity, 12) for r in toxicity.score(odd, model).collect()}) == 1
    unlabelled = toxicity.fit(docs.limit(5), labels.limit(0))
    assert [r.toxicity < 0.5 for r in toxicity.score(odd, unlabelled).collect()] == [True] * 4


def test_pieces_of_many_texts_and_their_gradients():
    rng = random.Random(8)
    alphabet = "aB3é日 \n+=.:" + "abc" * 4
    texts = ["", "x", "a" * 130, "password=abcdefgh " + "y" * 90, "token: Zz/9+.-=" + "f" * 41]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) + rng.choice(["", "token=abc123 later", "AKIA" + "B" * 16]) for _ in range(60)]
    codes, begins, a, b, low, high, label = secrets.all_labelled(texts)
    of = np.searchsorted(begins, a, side="right") - 1
    got = list(zip(of.tolist(), (a - begins[of]).tolist(), (b - begins[of]).tolist(), label.tolist(), strict=True))
    assert got == [(i, *x) for i, t in enumerate(texts) for x in secrets.labelled(t)] and set(label) == set(range(5))
    net = secrets.Network.new(np.random.default_rng(1))
    x = np.stack([secrets.encode(texts[i], s, e) for i, s, e, _ in got])
    assert np.allclose(net.range_logits(codes, low, high), net.logits(x), atol=1e-3)
    sums = net.range_gradients(codes, low, high, label)

    def loss(n):
        z, y = n.logits(x), label == secrets.FINDING
        return np.array([(np.logaddexp(0, z) - y * z)[label == c].sum() for c in range(5)])

    for i in rng.sample(range(8, sums.shape[1]), 40):
        step = np.zeros(sums.shape[1])
        step[i] = 1e-5
        slope = (loss(net.moved(-step)) - loss(net.moved(step))) / 2e-5
        assert np.allclose(slope, sums[:, i], atol=1e-2 * (1 + np.abs(slope).max()))


def test_secrets_learn_from_all_documents(spark, monkeypatch):
    """Documents beyond the bounded set of the start move the weights, and all held-out pieces count for the threshold."""
    monkeypatch.setattr(secrets, "MAX_DOCS", 300)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.filter("text is not null").withColumn("order", F.xxhash64("text"))
    last = rows.select("order").orderBy("order").limit(300).agg(F.max("order")).first()[0]
    beyond = rows.filter((F.col("order") > last) & (F.pmod("order", F.lit(3)) != 0)).collect()
    plain = [r.doc_id for r in beyond if not secrets.rule_spans(r.text)]
    assert len(plain) > 100
    net = secrets.train(docs)
    less = secrets.train(docs.filter(~F.col("doc_id").isin(plain)))
    assert not np.allclose(net.conv, less.conv, atol=1e-6)
    held = [r.text for r in rows.filter(F.pmod("order", F.lit(3)) == 0).collect()]
    *_, low, high, label = found = secrets.all_labelled(held)
    counted = secrets.held_out(rows, net)
    n_found = int((label == secrets.FINDING).sum())
    assert n_found and counted["n"].sum() == len(label) + 2 * secrets.VARIANTS * n_found
    y = counted["y"].to_numpy(bool)
    assert counted["n"][y].sum() == (1 + secrets.VARIANTS) * n_found
    p = net._scaled(counted["bin"].to_numpy() * secrets.GRID)
    share = lambda t: counted["n"][y & (p >= t)].sum() / counted["n"][y].sum()
    assert share(net.threshold) >= secrets.RECALL > share(np.nextafter(net.threshold, 2))
    assert np.bincount(label, minlength=5)[:3].sum() and len(found) == 7


def test_language_tables_take_little_of_the_driver(spark, monkeypatch):
    """What the driver's Python takes beside the model stays small while units are named, and is given back after the fit."""
    import tracemalloc

    import pyarrow as pa

    n = 200_000
    units = pa.table({"n": np.zeros(n, np.int32), "unit": [f"unit{k:06}" for k in range(n)], **{f"lang{k}": np.arange(n) for k in range(4)}})
    tracemalloc.start()
    named, logs = langid._table(units, list("abcd"), 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(named.tolist())) == n and logs.shape == (n, 4) and most < 35e6
    order = np.argsort(langid.names(pa.array([f"unit{k:06}" for k in range(n)])))
    assert (named == langid.names(pa.array([f"unit{k:06}" for k in order]))).all() and (logs[:, 1] == np.log((order + 0.5) / (order.sum() + 0.5 * n)).astype(np.float32)).all()
    released = []
    monkeypatch.setattr(langid, "release", lambda: released.append(1))
    model = langid.fit(spark.createDataFrame([(1, "one two", "en"), (2, "eins zwei", "de")], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"] and len(model.tables[0][0]) == 4 and released


def test_network_reads_texts_in_blocks_that_fit_a_cache(monkeypatch):
    """The tables of a long text are small, and neither its blocks nor the groups of pieces change what comes out."""
    import tracemalloc

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh XY01 ") for _ in range(60_000)) + " token=abcdef0123456789 ", "x" * 9_000]
    codes, _, _, _, low, high, label = secrets.all_labelled(texts)
    net = secrets.Network.new(np.random.default_rng(1))
    net.range_logits(codes, low, high)
    tracemalloc.start()
    for _ in net.range_top(codes, low, high):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6e6
    logits, sums = net.range_logits(codes, low, high), net.range_gradients(codes, low, high, label)
    for block, at_once in ((1 << 17, 1 << 20), (256, 1), (1_024, 100)):
        monkeypatch.setattr(secrets, "BLOCK", block)
        monkeypatch.setattr(secrets, "SUMMED_AT_ONCE", at_once)
        assert np.allclose(net.range_logits(codes, low, high), logits, atol=1e-9)
        assert np.allclose(net.range_gradients(codes, low, high, label), sums, atol=1e-9)
    assert not net.range_gradients(codes, low[:0], high[:0], label[:0]).any()
