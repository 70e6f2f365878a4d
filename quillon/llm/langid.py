"""Language identification by word-first backoff.

A text is read as runs of letters (\\p{L}), lower case. A word known from training scores the log of its
frequency in each language. An unseen word, its ends marked, scores by its character 5-grams;
where none of them is known by 4-grams, and so on to single letters, at the mean log frequency of the
known ones. The scores of a text add up; the best language wins, its score being its share when the
sums are turned into probabilities.

Fitting: counts are Spark aggregations over a sample of the labelled rows, in order of a hash of id and text, whose
bounds MAX_ROWS and MAX_BYTES (of text; one row at least) are the model's only ones. All words and grams of these rows
are kept, in tables of 64-bit names and log frequencies, 8 bytes and 4 a language each.

Scoring: a batch is cut at white space; each distinct piece of a few megabytes of text is
scored once, and the scores are added up by text.

Defined results: `und` with score 0 for a text that is null, has no letter, or when nothing was
learned; ties between languages go to the first by name; rows alike in id, text and language are learned from once; very long
texts and words are read whole, in time that grows with their length; empty tables give no rows; identify() puts its
result in the column it is told, in place of one that is already called so; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import by_bytes, materialize, release

MAX_ROWS = 20_000
MAX_BYTES = 1 << 27
LONGEST = 5
GROUP_BYTES = 1 << 22
#: Units that are named together.
NAMED_AT_ONCE = 1 << 16
UNKNOWN = "und"
BEGIN, END = "\x02", "\x03"
STEP = np.uint64(0x9E3779B97F4A7C15)


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and how many each has."""
    joined = "".join(words.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def names(words: pa.Array) -> np.ndarray:
    """A 64-bit name of each word, none of which is empty."""
    points, sizes = _points(words)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()) + 1, STEP))
    return _mixed(np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * powers[place], starts))


def grams(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all n-grams of the words, and the number of the word that each is from."""
    points, sizes = _points(words)
    h = np.zeros(max(0, len(points) - n + 1), np.uint64)
    for j in range(n):
        h = h * STEP + points[j : j + len(h)] + np.uint64(1)
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
    inside = np.arange(len(h)) + n <= np.cumsum(sizes)[of]
    return _mixed(h[inside]), of[inside]


@dataclass
class Model:
    """tables[0] by word, tables[n] by n-gram: names in order, and a row of log frequencies each."""

    langs: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]

    def _find(self, n: int, wanted: np.ndarray) -> np.ndarray:
        """Rows in a table; -1 where there is none."""
        known = self.tables[n][0]
        at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
        return np.where(known[at] == wanted, at, -1) if len(known) else np.full(len(wanted), -1)

    def words(self, words: pa.Array) -> np.ndarray:
        """A row of scores a word, a column a language."""
        rows = self._find(0, names(words))
        out = np.zeros((len(words), len(self.langs)))
        out[rows >= 0] = self.tables[0][1][rows[rows >= 0]]
        left = np.flatnonzero(rows < 0)
        marked = pc.binary_join_element_wise(BEGIN, words.take(pa.array(left)), END, "")
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            named, of = grams(marked, n)
            rows = self._find(n, named)
            of, rows = of[rows >= 0], rows[rows >= 0]
            found = np.bincount(of, minlength=len(left))
            hit = found > 0
            for k in range(len(self.langs)):
                sums = np.bincount(of, self.tables[n][1][rows, k], minlength=len(left))
                out[left[hit], k] = sums[hit] / found[hit]
            left, marked = left[~hit], marked.filter(pa.array(~hit))
        return out

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The summed scores of each piece's words, and how many words it has."""
        lists = pc.split_pattern_regex(pieces, r"[^\p{L}]+")
        words = lists.flatten()
        of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        filled = pc.not_equal(pc.binary_length(words), 0)
        words, of = words.filter(filled), of[filled.to_numpy(zero_copy_only=False)]
        coded = words.dictionary_encode()
        which, scores = coded.indices.to_numpy(zero_copy_only=False), self.words(coded.dictionary)
        sums = [np.bincount(of, scores[which, k], minlength=len(pieces)) for k in range(len(self.langs))]
        return np.stack(sums, axis=1), np.bincount(of, minlength=len(pieces))

    def predict(self, texts: pa.Array) -> pa.Array:
        """lang_pred and score of each text."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        scores, counts = self.pieces(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        total = np.stack([np.bincount(of, scores[which, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        best, n_words = total.argmax(axis=1), np.bincount(of, counts[which], minlength=len(texts))
        score = np.where(n_words > 0, 1 / share.sum(axis=1), 0.0)
        lang = pa.array(self.langs).take(pa.array(best))
        return _result(pc.if_else(pa.array(n_words > 0), lang, UNKNOWN), pa.array(score))


def _result(lang: pa.Array, score: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([lang, score], names=["lang_pred", "score"])


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _units(word: Column) -> Column:
    """A word as unit 0 and its n-grams as units n."""
    marked = F.concat(F.lit(BEGIN), word, F.lit(END))
    whole = F.array(F.struct(F.lit(0).alias("n"), word.alias("unit")))

    def grams_of(n: int) -> Column:
        found = F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))  # one pass a word, however long
        return F.transform(found, lambda g: F.struct(F.lit(n).alias("n"), g.alias("unit")))

    return F.concat(whole, *map(grams_of, range(1, LONGEST + 1)))


def _table(counts: pa.Table, langs: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log frequencies, add-half smoothed, in the order of the units' names."""
    rows = counts.filter(pc.equal(counts["n"], n))
    units = rows["unit"].combine_chunks() if len(rows) else pa.array([], pa.string())
    parts = [units.slice(at, NAMED_AT_ONCE) for at in range(0, len(units), NAMED_AT_ONCE)]
    named = np.concatenate([np.zeros(0, np.uint64), *(grams(part, n)[0] if n else names(part) for part in parts)])
    order = np.argsort(named)
    logs = np.zeros((len(order), len(langs)), np.float32)
    for k in range(len(langs) if len(order) else 0):
        number = rows[f"lang{k}"].to_numpy().astype(np.float64)
        logs[:, k] = np.log((number + 0.5) / (number.sum() + 0.5 * len(number)))[order]
    return named[order], logs


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """labelled: doc_id, text, lang (null: unlabelled)."""
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "text"))
    # The limit is on the ids and sizes; only the texts of those within it are read in full.
    first = rows.select("order", F.octet_length("text").cast("long").alias("size")).orderBy("order").limit(max_rows)
    before = F.sum("size").over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1))  # over max_rows rows
    within = first.select("order", (F.coalesce(before, F.lit(0)) + F.col("size")).alias("through"), F.isnull(before).alias("first"))
    last = within.filter((F.col("through") <= max_bytes) | F.col("first")).agg(F.max("order")).first()[0]
    if last is None:
        return Model([], [])
    rows = rows.filter(F.col("order") <= last).dropDuplicates(["order", "lang"])
    words = materialize(rows.select("lang", F.explode(_letters(F.col("text"))).alias("unit")).groupBy("lang", "unit").agg(F.count("*").alias("n")), "langid-words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())  # labels, not rows
    if not langs:
        return Model([], [])
    # One column a language, under plain names.
    by_word = words.groupBy("unit").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"lang{k}") for k, lang in enumerate(langs)])
    sums = [F.sum(f"lang{k}").alias(f"lang{k}") for k in range(len(langs))]
    units = by_word.select(F.explode(_units(F.col("unit"))).alias("u"), *[f"lang{k}" for k in range(len(langs))])
    counts = units.groupBy("u.n", "u.unit").agg(*sums).toArrow()  # of max_bytes of text
    model = Model(langs, [_table(counts, langs, n) for n in range(LONGEST + 1)])
    del counts
    release()  # the driver lives on, beside what the later stages take
    return model


def predictor(model: Model, docs: DataFrame):
    """A Column function text -> (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of MAX_BYTES of text

    def predict(texts: pa.Array) -> pa.Array:
        use = shared.value
        if not use.langs:
            return _result(pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64()))
        parts = []
        for group in by_bytes(texts, GROUP_BYTES):
            parts.append(use.predict(group))
            release()
        return pa.concat_arrays(parts) if parts else _result(pa.array([], pa.string()), pa.array([], pa.float64()))

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, "lang_pred string, score double").asNondeterministic()  # so that a filter on the result doesn't compute it again


def identify(docs: DataFrame, training: DataFrame, column: str = "langid") -> DataFrame:
    """docs with all its columns and a struct of lang_pred and score, named by `column`."""
    predict = predictor(fit(training), docs)
    return docs.withColumn(column, predict(F.col("text").cast("string")))
