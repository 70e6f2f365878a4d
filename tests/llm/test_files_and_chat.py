import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import base, chat, decontam, exact_dedup, mixing, token_files
from quillon.llm.queries import tokenizer_path

ROWS = [
    (0, "It's the END.  of\x0bline\x0cand\x1cmore  <|endoftext|> x", "a"),
    (1, "", "a"),
    (2, None, "b"),
    (3, "Straße ÀÉ é İstanbul Σας #2 " * 400, None),
    (3, "same id", "b"),
    (3, "same id", "b"),
    (None, "no id 4\x854 'll don't", "b"),
    (9, "word " * 5000, "c"),
]


def frame(spark, rows=ROWS, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema).withColumns({"digest": F.lit("clash"), "shard": F.lit(1), "size": F.lit("x"), "h": F.lit(None)})


def test_token_files_equal_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    manifest = token_files.write(frame(spark), tokenizer_path(), length=64)
    found = token_files.read(manifest).collect()
    assert len(found) == len(ROWS)
    want = sorted((r[0] is not None, r[0] or 0, len(i := whole.encode(r[1] or "", add_special_tokens=False).ids + [2]), zlib.crc32(np.asarray(i, "<u4").tobytes())) for r in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == [None, 0, 1, 2, 3, 3, 3, 9]


def test_sequences_are_views_with_masks(spark):
    manifest = token_files.write(frame(spark).coalesce(1), tokenizer_path(), length=64)
    total = 0
    for row in manifest.collect():
        n = -(-row.n_tokens // 64)
        for i in range(n):
            ids, mask = token_files.sequence(row.ids_file, i)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            total += int(mask.sum())
    assert total == sum(r.n_tokens for r in manifest.collect())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert token_files.read(token_files.write(none, tokenizer_path())).count() == 0
    assert exact_dedup.dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.apply(none).count() == 0
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontam.report(none, items).count() == 0
    assert decontam.report(frame(spark), items.limit(0)).count() == 0
    assert chat.digest(chat.render(chat.paths(chat.chain(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))).count() == 0


def test_exact_dedup_cases(spark):
    found = exact_dedup.dedup(frame(spark, [*ROWS, (None, "same id", "b"), (None, "alone", None), (None, "alone", None)])).collect()
    assert sum(r.kept for r in found) == 7  # distinct texts
    same = [r for r in found if r.doc_id == 3 and r.group_size == 3]
    assert len(same) == 2 and sum(r.kept for r in same) == 1 and {r.keep_id for r in same} == {3}
    empty = [r for r in found if r.doc_id in (1, 2)]
    assert {r.keep_id for r in empty} == {2} and {r.group_size for r in empty} == {2}


def test_cuckoo_index_grows_and_deletes():
    import hashlib

    index, keys = exact_dedup.CuckooIndex(2), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.resizes > 5 and index.size == 3000
    assert all(index.delete(k) for k in keys[::2])
    assert [index.find(k) for k in keys] == [None if i % 2 == 0 else i for i in range(3000)]
    assert not index.delete(keys[0]) and len(list(index)) == 1500


def test_cuckoo_index_with_forced_collisions():
    rng = random.Random(4)
    start = lambda n: n.to_bytes(8, "little")
    # Equal beginnings, so equal fingerprints and places: more than any table holds; and equal fingerprints in few places.
    keys = [start(7) + b"\x05\x00" + i.to_bytes(6, "little") for i in range(30)] + [start(i % 3) + (i % 5).to_bytes(2, "little") + b"x" * 5 + bytes([i]) for i in range(100)]
    keys += [rng.randbytes(16) for _ in range(500)]
    index, plain = exact_dedup.CuckooIndex(2), {}
    for step in range(6000):
        k = rng.choice(keys)
        if k in plain and rng.random() < 0.4:
            assert index.delete(k) and plain.pop(k) is not None
        elif k in plain:
            index.update(k, step)
            plain[k] = step
        else:
            assert index.find(k) is None and not index.delete(k)
            index.insert(k, step)
            plain[k] = step
    assert dict(index) == plain and index.size == len(plain) and [index.find(k) for k in keys] == [plain.get(k) for k in keys]
    assert index.filter.buckets < 4096

    fresh = exact_dedup.CuckooIndex(1024)
    for k in keys[130:]:
        fresh.insert(k, 1)
    fresh.verified = 0
    assert all(fresh.find(rng.randbytes(16)) is None for _ in range(2000)) and fresh.verified < 20  # most misses never reach a bucket


def test_conversation_of_many_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn <{i}> é " + "word " * (i % 9)) for i in range(8000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)).withColumnRenamed("turn", "step")
    out = chat.render(df)
    began = time.time()
    r, = chat.digest(out).collect()
    took = time.time() - began
    loss = "".join(t for _, i, role, t in rows if role == "assistant")
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (8000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in rows).encode()).hexdigest() and took < 30


def test_mixing_takes_near_targets(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i in range(300) for s in ("x", "y", None)] + [(10**6, "w " * 3, "tiny"), (10**6 + 1, None, "void")]
    docs = frame(spark, rows)
    by = {}
    for r in mixing.mix(docs).collect():
        x = by.setdefault((r.source, r.source_size, r.target), 0)
        by[r.source, r.source_size, r.target] = x + r.taken
        assert r.taken <= 3 * r.size
    for (_, size, target), taken in by.items():
        assert abs(taken - target) <= 7 and target <= 3 * size
    kept = mixing.apply(docs).columns
    assert kept == docs.columns


def test_decontamination_brute_force(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [
        (1, "x " * 5000 + item.upper().replace(" ", ", ") + " y" * 5000, None),
        (2, item.replace("kappa", "other"), None),  # 5 of 8 shingles
        (3, item.replace("mu", "other"), None),  # 7 of 8
        (4, None, None), (5, "", None), (6, "short text", None), (6, "short text", None), (None, item, None),
    ]
    items = spark.createDataFrame([(1, item), (2, "Short text"), (3, None), (4, "..."), (1, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.report(frame(spark, docs), items).collect()}
    assert found == {(1, 1, 8, 8), (3, 1, 7, 8), (6, 2, 1, 1), (None, 1, 8, 8)}
    left = [r.doc_id for r in decontam.clean(frame(spark, docs), items).collect()]
    assert sorted(left) == [2, 4, 5]


def test_chat_branches_and_round_trip(spark):
    text = "a&lt;b &amp; <turn>### x</turn>\n#\n"
    tree = [(1, 1, None, "us\ner", text, 0.0), (1, 2, 1, "assistant", text, 1.0), (1, 3, 1, "assistant", "low", 0.5), (1, 4, 3, "user", None, 0.1), (1, 5, 9, "user", "orphan", 0.0), (2, 1, 2, "a", "cycle", 0.0), (2, 2, 1, "a", "cycle", 0.0)]
    messages = spark.createDataFrame(tree, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    shown = chat.render(chat.paths(messages, best=2))
    got = {r.path: r for r in shown.select("path", chat.parse(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("us\ner", text), ("assistant", text)] and got[1].loss == text
    assert [tuple(t) for t in got[2].turns] == [("us\ner", text), ("assistant", "low"), ("user", "")] and got[2].loss == "low"


def test_long_chain(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", str(i)) for i in range(300)]
    d = chat.digest(chat.render(chat.paths(chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).first()
    assert d.n_turns == 300 and d.loss_chars == sum(len(str(i)) for i in range(1, 300, 2))


@pytest.mark.parametrize("ids", ["null", "hot"])
def test_mixing_fills_targets_from_rows_of_one_place(spark, ids):
    rows = [(None if ids == "null" or i % 3 == 0 else i, None if i == 7 else f"w{i % 50} " * (5 + i % 5), f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken = {}
    for r in mixing.mix(docs).collect():
        was = taken.setdefault(r.source, [r.target, 0])
        was[1] += r.taken
    assert len(taken) == 3 and all(0 <= target - got < 10 for target, got in taken.values())
    again = {r.source: r.n for r in mixing.apply(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert all(0 <= target - again[s] < 10 for s, (target, _) in taken.items()) and mixing.apply(docs).columns == docs.columns


def test_workers_give_memory_back_between_groups(monkeypatch):
    """A worker that keeps what Arrow's pool once held has it on top of all later stages."""
    import numpy as np
    import pyarrow as pa

    from quillon.llm import base, langid, token_files

    given = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(1)})())
    base.release()
    assert given == [1]
    for module in (langid, token_files):
        assert module.release is base.release
    first, sizes = np.array([5, 0, 9, 2**31 + 7]), np.array([3, 0, 2, 2])
    spans = token_files._spans(first, sizes)
    assert spans.tolist() == [5, 6, 7, 9, 10, 2**31 + 7, 2**31 + 8] and spans.dtype == np.int64
    spans = token_files._spans(first[:3], sizes[:3])
    assert spans.tolist() == [5, 6, 7, 9, 10] and spans.dtype == np.int32 and not len(token_files._spans(first[:0], sizes[:0]))


def test_encoder_takes_bounded_slices(monkeypatch):
    monkeypatch.setattr(token_files, "GATHERED_AT_ONCE", 50, raising=False)
    monkeypatch.setattr(token_files, "AT_ONCE", 20, raising=False)
    spans, given, gathered = token_files._spans, [], []
    monkeypatch.setattr(token_files, "_spans", lambda first, sizes: gathered.append(len(first)) or spans(first, sizes))
    encoder = token_files.PieceEncoder(tokenizer_path(), "uint16")
    ids = encoder._ids
    encoder._ids = lambda pieces: given.append(len(pieces)) or ids(pieces)
    texts = [" ".join(f"{i}x{j}" for j in range(i % 7)) for i in range(300)] + ["", "one, two. three", "x" * 500]
    for _ in range(2):
        gathered.clear()
        found, sizes = encoder.encode(pa.array(texts))
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert found.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
        assert 1 < len(gathered) and max(gathered) <= 50
    assert max(given) <= 20


def test_release_gives_back_what_the_allocator_keeps():
    kept = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    blocks = [np.ones(5_000) for _ in range(5_000)]  # 200 MB in blocks that the allocator keeps
    last = np.ones(5_000)
    full = kept()
    blocks.clear()
    base.release()
    assert full - kept() > 150e6 and len(last)
