"""Operators against plain versions of what they promise, and the opN_ queries themselves."""

import collections
import hashlib
import itertools
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import base, chat, components, decontam, langid, mixing, near_copies, queries, secrets, simhash, substring_dedup, token_files, toxicity
from tests.llm.test_files_and_chat import frame

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# op1


def plain_fingerprint(text):
    from xxhash import xxh64

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return "0" * 16
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return f"{sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)):016x}"


def test_op1_equals_a_plain_version(spark, docs):
    got = by_id(queries.op1_simhash(spark, SMALL))
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    assert {i: r.fingerprint for i, r in got.items()} == prints
    root = {i: i for i in prints}
    for i, j in itertools.combinations(sorted(prints), 2):
        if (int(prints[i], 16) ^ int(prints[j], 16)).bit_count() <= 3 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    assert {i: r.component_id for i, r in got.items()} == root
    odd = ["", None, "É é Ñ", "a\x85b c", "x " * 9, "one two three four"]
    assert [f"{simhash.fingerprint(t) & (1 << 64) - 1:016x}" for t in odd] == list(map(plain_fingerprint, odd))


def test_large_shards_are_split_again_without_losing_links(spark):
    from tests.llm.test_models_and_dedup import brute_components, clustered

    x = clustered(np.random.default_rng(8), 1200)
    routed = spark.createDataFrame([(h, int(v)) for h in (0, 1) for v in x.view(np.int64)], "shard long, fp long")
    parts = simhash.split_again(routed, 300)
    sizes = {r.shard: r.n for r in parts.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) > 10 and all(n <= 300 or s < 0 for s, n in sizes.items())
    edges = [(a, b) for s, in parts.select("shard").distinct().collect() for a, b in simhash.shard_links(np.array([r.fp for r in parts.filter(F.col("shard") == s).collect()], np.int64).view(np.uint64), simhash._half(s)).itertuples(index=False)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(x)
    signed = lambda v: int(np.uint64(v).view(np.int64))
    groups = collections.defaultdict(set)
    for v, root in want.items():
        groups[root].add(found.get(signed(v), signed(v)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


# Near copies


def test_keep_one_where_ids_repeat_and_names_clash(spark):
    rows = [(3, "alpha beta gamma delta epsilon zeta", "x"), (5, "ALPHA beta gamma delta epsilon zeta", "y"), (5, "quite another text than the others here", "z"), (7, None, "p"), (8, " ", "q"), (9, "tie tie tie tie tie", "b"), (9, "tie tie tie tie tie", "a")]
    schema = "doc_id long, text string, of string"
    df = spark.createDataFrame(rows, schema).withColumns({"_of": F.lit(1), "row": F.lit("r"), "of_row": F.lit(2.5), "fp": F.lit(0), "m": F.create_map(F.lit("k"), F.lit(1))})
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id, r.of) for r in kept.collect())
    assert [g[0] for g in got] == [3, 5, 7, 9] and got[1][1] == "z"
    assert got == sorted((r.doc_id, r.of) for r in simhash.keep_one(df.repartition(3)).collect())


def test_a_star_of_copies_is_joined_without_comparing_all_pairs(spark):
    rng = random.Random(4)
    base_words = [f"w{i}" for i in range(150)]
    texts = [" ".join(base_words)]
    for _ in range(150):
        words = list(base_words)
        for _ in range(rng.randrange(1, 7)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[f"n{rng.randrange(10**9)}"], [], [words[at], f"n{rng.randrange(10**9)}"]])
        texts.append(" ".join(words))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    far = len(set(root))
    assert 20 < far < 140
    df = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(root))
    rows = base.materialize(df.select("text", near_copies.sketch_udf("text").alias("s")).select("text", "s.*"), "t")
    spokes = near_copies._spokes(rows)
    texts_ = rows.select("fp", "text").dropDuplicates(["fp"])
    roots = base.materialize(components.components(near_copies._verified(spokes.select(F.col("hub").alias("a"), F.col("fp").alias("b")), texts_, "e")), "r")
    assert near_copies._by_difference(spokes, roots, texts_).count() < 6 * len(texts)


# op2


def test_scores_equal_a_plain_backoff(spark):
    rows = [(1, "the cat and the dog ran", "en"), (2, "le chat et le chien", "fr"), (3, "die katze und der hund", "de"), (4, "the the le", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = [collections.Counter() for _ in range(6)]
    for _, text, lang in rows:
        for w in text.split():
            counts[0][w, lang] += 1
            for n in range(1, 6):
                marked = f"\x02{w}\x03"
                for i in range(len(marked) - n + 1):
                    counts[n][marked[i : i + n], lang] += 1
    units = [{u for u, _ in c} for c in counts]
    total = [{lang: sum(k for (_, x), k in c.items() if x == lang) for lang in model.langs} for c in counts]
    log = lambda n, u, lang: math.log((counts[n][u, lang] + 0.5) / (total[n][lang] + 0.5 * len(units[n])))

    def word(w, lang):
        if w in units[0]:
            return log(0, w, lang)
        marked = f"\x02{w}\x03"
        for n in range(5, 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in units[n]]
            if known:
                return sum(log(n, g, lang) for g in known) / len(known)
        return 0.0

    texts = ["the cats, THE chats!", "katzen-hunde 12 x", "日本語 xyz", "le", "", "12 !?", "q" * 3000 + " the", "a the\tchien'dog"]
    got = model.predict(pa.array(texts)).to_pylist()
    for text, found in zip(texts, got, strict=True):
        words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
        if not words:
            assert found == {"lang_pred": "und", "score": 0.0}
            continue
        sums = {lang: sum(word(w, lang) for w in words) for lang in model.langs}
        best = max(model.langs, key=lambda x: (sums[x], -model.langs.index(x)))
        share = 1 / sum(math.exp(s - sums[best]) for s in sums.values())
        assert abs(found["score"] - share) < 1e-3 and (found["lang_pred"] == best or share < 0.51)


def test_op2_learns_all_units_of_its_rows_and_keeps_clashing_columns(spark):
    got = queries.op2_language_id(spark, SMALL)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == 200
    assert {r.held_out for r in got.collect()} == {True, False}
    rows = [(i, " ".join(f"{a}{b}{c}" for b in string.ascii_lowercase for c in string.ascii_lowercase), lang) for i, (a, lang) in enumerate(zip("abcdef", "xyxyxy", strict=True))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.tables[0][0]) == 6 * 26 * 26
    df = frame(spark, [(1, "abc", None)]).withColumn("langid", F.lit("mine"))
    name = base.fresh(df, "langid")[0]
    out = langid.identify(df, spark.createDataFrame(rows, "doc_id long, text string, lang string"), name).first()
    assert out["langid"] == "mine" and out[name].lang_pred == "x"


# op3


def test_tables_of_pieces_are_cut_and_filled_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "MAX_PIECES", 300)
    path, rng = queries.tokenizer_path(), random.Random(3)
    encoder, whole = token_files.PieceEncoder(path, "uint16"), Tokenizer.from_file(path)
    some = ["Hello,", "world.", "<|endoftext|>", "naïve", "x.y,", "...", ",", "Straße", "don't", "日本語", "á", "1,000."]
    for _ in range(12):
        texts = [" ".join(rng.choice([*some, "".join(rng.choice("abcdé.,") for _ in range(rng.randrange(1, 9)))]) for _ in range(rng.randrange(80))) for _ in range(5)] + ["", " \t ", "\n x \x0b"]
        ids, sizes = encoder.encode(pa.array(texts))
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == list(itertools.chain(*want))
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == []


def test_other_tokenizers_encode_whole_texts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  world The cat.", "", None, " x\t\tY <|endoftext|> z", "Straße, naïve", *[r.text for r in docs[:40]]]
    df = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    files = token_files.write(df, path)
    whole = Tokenizer.from_file(path)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    import zlib

    starts = np.cumsum([0, *map(len, want)])
    assert {tuple(r) for r in token_files.read(files).collect()} == {(i, int(starts[i]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)}
    assert not token_files.PieceEncoder(path, "uint16").by_pieces and token_files.PieceEncoder(queries.tokenizer_path(), "uint16").by_pieces
    with pytest.raises(ValueError):
        token_files.write(df, path, dtype="uint8")
    with pytest.raises(ValueError):
        token_files.write(df, path, end_id=70_000, dtype="uint16")
    assert token_files.id_type(path, 70_000) == "uint32" and token_files.id_type(path, 2) == "uint16"

    changed = Tokenizer.from_file(queries.tokenizer_path())  # the same vocabulary, but letters are kept as they are
    changed.normalizer = normalizers.NFC()
    assert not token_files.by_pieces(__import__("json").loads(changed.to_str()))
    bare = Tokenizer(models.BPE())
    bare.pre_tokenizer = pre_tokenizers.Whitespace()
    assert not token_files.by_pieces(__import__("json").loads(bare.to_str()))


# op5


def test_windows_that_share_half_a_key_stay_apart():
    key = np.array([[1, 1], [1, 2], [1, 1], [1, 2]], np.uint64)
    e = substring_dedup.Entries(key, np.array([5, 6, 7, 4]), np.arange(4), np.arange(4))
    assert substring_dedup.settle_windows(e)[0].tolist() == [False, True, True, False]
    back = substring_dedup.Entries.unpack(__import__("pandas").DataFrame([e.pack(0, True)]), "<u8", 2)
    assert (back.key == key).all() and back.ids.tolist() == [5, 6, 7, 4]
    hashes, sizes = substring_dedup._word_hashes([[b"a"] * 20, [b"b"] * 15])
    keys = substring_dedup.window_keys(hashes)
    assert sizes.tolist() == [20, 15] and keys.shape == (23, 2) and len({tuple(k) for k in keys[:8].tolist()}) == 1 and len({tuple(k) for k in keys.tolist()}) > 10


def test_op5_equals_a_plain_version(spark, docs):
    from tests.llm.test_models_and_dedup import brute_substring

    got = sorted((False, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substring_dedup(spark, SMALL).collect())
    assert got == brute_substring([(r.doc_id, (r.text or "").encode().split()) for r in docs])
    assert substring_dedup.dedup(frame(spark, [])).count() == 0


# op6


def test_network_finds_keys_that_no_rule_knows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net, rng = secrets.train(docs), random.Random(5)
    make = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    letters = string.ascii_letters + string.digits
    forms = [lambda: make(36, letters), lambda: "eyJ" + make(60, letters + "-_"), lambda: make(32, string.digits + "ABCDEF"), lambda: "sk_live_" + make(24, letters), lambda: make(40, letters + "+/")]
    planted = []
    for r in docs.orderBy("doc_id").limit(400).collect():
        words, key = (r.text or "").split(" "), forms[len(planted) % 5]()
        at = rng.randrange(len(words) + 1)
        planted.append((len(planted), " ".join([*words[:at], rng.choice(["auth", "Bearer", "uses"]), key, *words[at:]]), key))
    rows = by_id(secrets.scan(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"), net))
    spans = {i: [(int(s.split(":")[1]), int(s.split(":")[2])) for s in r.spans.split(",") if s] for i, r in rows.items()}
    found = sum(any(a < t.index(k) + len(k) and b > t.index(k) for a, b in spans[i]) for i, t, k in planted)
    assert found >= 0.85 * len(planted)
    plain = secrets.scan(docs, net).agg(F.sum("n_cnn")).first()[0]
    assert plain <= 0.005 * docs.count()


def test_labels_of_pieces_equal_a_plain_version():
    rng = random.Random(2)
    for _ in range(60):
        text = " ".join(rng.choice(["word", "longerword", "CAPITALS", "x1y2z3q9", "token=" + "ab" * rng.randrange(2, 60), "0123456789abcdef" * rng.randrange(1, 6), "AKIA" + "B" * 20]) for _ in range(rng.randrange(30)))
        spans = secrets.rule_spans(text)
        near = lambda a, b: any(s < b and a < e for s, e, _ in spans)
        want = []
        for start, end in secrets.candidates(text):
            for a, b in secrets.pieces(start, end):
                if near(a, b):
                    want.append((a, b, secrets.FINDING))
                elif not near(start, end):
                    beside = near(a - secrets.LEFT, b + secrets.RIGHT)
                    want.append((a, b, secrets.BESIDE if beside else secrets.DIGITS if any(map(str.isdigit, text[a:b])) else secrets.PLAIN if text[a + 1 : b].islower() else secrets.CAPITALS))
        assert secrets.labelled(text) == want
    assert len(secrets.labelled(" ".join(["token=" + "ab" * 20] * 20_000))) > 20_000  # in linear time


def test_op6_base_spans_equal_a_plain_version(spark, docs):
    got = by_id(queries.op6_secrets(spark, SMALL))
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for r in docs:
        found = sorted((m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, g, least) in enumerate(kinds) for m in p.finditer(r.text or "") if len(m[g]) >= least)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(s for _, _, s in found).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k, *_ in kinds] == [sum(s.startswith(k) for _, _, s in found) for k, *_ in kinds]
        assert {s for _, _, s in found} <= set(got[r.doc_id].spans.split(","))


# op9


def test_viterbi_finds_the_best_of_all_paths():
    from tests.llm.test_models_and_dedup import english

    language = english()
    for stretch in ("1d10t", "i d 1 o", "$t@@p", "coooool", "w.0.r", "ñ1é", "日1本"):
        best = -math.inf
        for path in itertools.product(*toxicity.lattice(stretch)):
            a = b = toxicity.EDGE
            score = sum(cost for _, cost in path)
            for c in "".join(letters for letters, _ in path) + toxicity.EDGE:
                c = c if c in toxicity.ALPHABET else toxicity.OTHER
                score += language.log(a, b, c)
                a, b = b, c
            if score > best:
                best, text = score, "".join(letters for letters, _ in path)
        assert toxicity.decode(stretch, language) == text.replace(toxicity.EDGE, " ").strip()


def test_op9_columns_empty_tables_and_clashes(spark):
    got = queries.op9_toxicity(spark, SMALL)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 200
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, []), labels)
    assert toxicity.score(frame(spark, []), model).count() == 0
    df = frame(spark, [(1, "x", None)]).withColumn("toxicity", F.lit("mine"))
    assert toxicity.score(df, model, base.fresh(df, "toxicity")[0]).first()["toxicity"] == "mine"


# op4, op10 and the others


def test_large_and_small_items_in_long_and_short_documents(spark):
    rng = random.Random(6)
    make = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([1, 3, 5, 6, 9, 14, 30, 77, 200])]
    docs = []
    for i in range(120):
        words = make(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "changed"
            words[rng.randrange(len(words) + 1) : 0] = part
        docs.append((i, " ".join(words), None))
    shingles = lambda t: {" ".join(w[i : i + 5]) for w in [[x for x in re.split(r"[\W_]+", t.lower()) if x]] for i in range(max(1, len(w) - 4)) if w}
    want = {(d, i, len(s & shingles(t))) for d, t, _ in docs for i, x in items for s in [shingles(x)] if len(s & shingles(t)) >= 0.8 * len(s) - 1e-9}
    df = frame(spark, docs).withColumns({"of": F.lit(1), "of_text": F.lit(2), "item_id": F.lit(3), "packed": F.lit("x")})
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontam.report(df, table).collect()}
    assert got == want and len(want) > 20
    clean = decontam.clean(df, table)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, *_ in docs} - {d for d, *_ in want}


def test_few_hashes_meet_the_sketches_and_none_that_matters_is_lost(spark):
    df, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    _, sketch = decontam.index(items)
    every = df.select("doc_id", F.explode(decontam.shingle_hashes(F.col("text"))).alias("h"))
    met = decontam.searched(df.select("doc_id", "text"), sketch)
    assert met.count() < 0.05 * every.count()
    true = every.join(sketch, "h").groupBy("doc_id", "item_id", "need").count().filter("count >= need")
    kept = met.join(sketch, ["part", "h"]).groupBy("doc_id", "item_id", "need").count().filter("count >= need")
    rows = lambda x: {(r.doc_id, r.item_id) for r in x.collect()}
    assert {(r.doc_id, r.item_id) for r in decontam.report(df, items).collect()} <= rows(kept) <= rows(true)


def test_op10_meets_its_contract(spark, docs):
    got = queries.op10_mixing(spark, SMALL).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    total = collections.Counter()
    for i, s in source.items():
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # share what is left by weight; whoever exceeds three times its size stops there
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in full}
        open_ -= full
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 * target[s] + 1e-6
        assert r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s) for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op10_mixing(spark, SMALL).collect()))


def test_mixing_keeps_columns_of_any_name(spark):
    df = frame(spark, [(i, "a b c", "s") for i in range(20)]).withColumns({c: F.lit(c) for c in ("of", "whole", "rounds", "ties", "number", "words", "place", "copy", "tie")})
    out = mixing.apply(df)
    assert out.columns == df.columns and {r.copy for r in out.collect()} == {"copy"}


def test_chat_of_clashing_and_empty_rows(spark):
    rows = [(1, 1, "user", None), (1, 2, "assistant", ""), (None, 1, None, "x"), (2, None, "assistant", "y " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"m": F.lit(1), "up": F.lit("x"), "score": F.lit(None), "message_id": F.lit(9)})
    got = {r.conv_id: r for r in chat.digest(chat.render(chat.paths(chat.chain(df)))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].loss_chars) == (2, 0, 1, 100_000)


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000)) + " token=" + "ab12" * 5000 + " 1d10t " + "z" * 200_000
    df = frame(spark, [(1, long, "a"), (2, long + " end", "b")])
    found = simhash.near_dedup(df).collect()
    assert {r.component_id for r in found} == {1} and found[0].fingerprint == plain_fingerprint(long)
    assert [r.doc_id for r in simhash.keep_one(df).collect()] == [1]
    assert {r.n_assign for r in secrets.scan(df, secrets.train(df)).collect()} == {1}
    removed = by_id(substring_dedup.dedup(df))
    assert removed[1].n_removed < 300_000 and removed[2].n_removed >= 300_000
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert len({r.toxicity for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}) == 1


def test_names_that_are_free():
    class Has:
        columns = ["Of", "_of", "x"]

    assert base.fresh(Has, "of", "y", "y") == ["__of", "y", "_y"]
