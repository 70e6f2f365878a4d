import zlib

import corpus_pipeline
from quillon.llm.base import materialize


def test_stages_keep_the_columns_and_their_decisions(spark):
    sf, docs, seen = "/root/testdata/sf0.001", None, []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        seen.append((name, docs.count()))
        if name != "token_output":
            assert docs.columns == columns
    assert seen[0][1] >= seen[1][1] >= seen[2][1] > 0 and seen[3][1] == seen[4][1] > 0
    rows = docs.orderBy("start").collect()
    assert [r.start for r in rows][0] == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_token_output_equals_a_plain_encoding(spark):
    import numpy as np
    from tokenizers import Tokenizer

    from quillon.llm.queries import tokenizer_path

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    whole = Tokenizer.from_file(tokenizer_path())
    for r in corpus_pipeline.token_output(spark, docs, sf).collect():
        ids = whole.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))


def test_documents_without_any_label_go_on(spark):
    rows = [(1, "some words", None), (2, "12 !?", None), (3, None, None), (4, "日本語", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, corpus_pipeline.language(spark, docs, "").collect())) == [rows[0], rows[3]]


def test_run_equals_plain_stages(spark):
    """All stages on a whole table against plain versions: which documents stay, how often the mix takes them, their tokens."""
    import collections
    import itertools
    import re

    import numpy as np
    from tokenizers import Tokenizer

    from quillon.llm.queries import tokenizer_path

    sf, word = "/root/testdata/sf0.001", re.compile(r"[^\x20\x09-\x0D]+")
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if re.search(r"[^\W\d_]", r.text or "")}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {i: grams([x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in word.findall(r.text)]) for i, r in rows.items()}
    root = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    plain = lambda t: grams([x for x in re.split(r"[\W_]+", t.lower()) if x])
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in rows if root[i] == i and not any(len(x & s) >= 0.8 * len(x) - 1e-9 for s in [plain(rows[i].text)] for x in items if x)}

    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} <= clean
    size = {i: len(word.findall(rows[i].text)) for i in clean}
    total, taken = collections.Counter(), collections.Counter()
    for i in clean:
        total[rows[i].source] += size[i]
    for r in found:
        taken[rows[r.doc_id].source] += size[r.doc_id]
    names = sorted(total)
    weight, target, open_ = {s: (1, 2, 3)[n % 3] for n, s in enumerate(names)}, {}, set(names)
    while open_:
        left, weights = sum(total.values()) - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / weights > 3 * total[s]}
        target |= {s: 3 * total[s] for s in full} or {s: left * weight[s] / weights for s in open_}
        open_ = open_ - full if full else set()
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in clean if rows[i].source == s) for s in names)
    assert max(collections.Counter(r.doc_id for r in found).values()) <= 3
    whole, at = Tokenizer.from_file(tokenizer_path()), 0
    for r in sorted(found, key=lambda r: r.start):
        ids = whole.encode(rows[r.doc_id].text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_on_odd_rows_and_no_rows(spark):
    rows = [(1, "one two three four five six", None, None), (1, "one two three four five six", None, None), (None, "one two three four five six", "en", "s"), (2, None, "en", "s"), (3, "", None, "s"), (None, None, None, None), (4, "word " * 60_000, "en", None)]
    schema = "doc_id long, text string, lang string, source string"
    clashes = ("langid", "of", "of_text", "row", "of_row", "whole", "rounds", "number", "copy", "n_chars")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema).selectExpr("*", *[f"'x' as {c}" for c in clashes])
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), "odd")
            assert docs.columns == [*schema.replace(" long", "").replace(" string", "").split(", "), *clashes]
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= {1, 4} and bool(ids) == bool(some)
        assert corpus_pipeline.token_output(spark, docs, "").count() == docs.count()
