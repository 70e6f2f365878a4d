"""Toxicity scores of texts restored from obfuscation by a noisy channel.

Disguised stretches are found by their form: look-alike digits and signs in words, letters set apart, and
letters repeated three times or more. Each becomes a lattice: a sign may stand for one of several
letters, a separator may be a gap or nothing, a run of a letter may be one or two of it. Viterbi
decoding takes the path with the best sum of channel cost and character-trigram log probability. The
restored words join the text's own. Features are the distinct words and their beginnings of PREFIXES
letters; a logistic regression on the features that tell the classes apart gives the score.

The trigrams are counted over all documents, labelled or not, and all are kept: they are over the letters that
signs can stand for and their accented kin (ALPHABET), all other letters counting as one, so there are
59**3 at most. The classifier is fitted on a sample of labelled rows, whose bound MAX_ROWS (by hash of id) is its
only one: every feature whose evidence reaches MIN_EVIDENCE is used.

Defined results: null and empty texts get the score of a text without features; equal texts get equal
scores; without labels of both classes every score is 0; ids labelled twice count once, as toxic if any
label says so, and of documents with one id the text that is first in order is learned from; very long texts and words are
read whole, in time that grows with their length; an empty table gives no rows; score() puts its result in the column it is told, in place of one
that is already called so, and keeps the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

MAX_ROWS = 20_000
MIN_EVIDENCE = 12.0
PREFIXES = (4, 5, 6)
LEAST = PREFIXES[0]
CACHE_WORDS = 200_000
EDGE, OTHER = "\x02", "\x01"
ALPHABET = frozenset("abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ" + EDGE)

# The letters that signs stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "(": "c",
}
SUBSTITUTION, DROPPED_GAP, KEPT_GAP, SHORTENED = -0.5, -0.2, -1.0, -0.3

LETTER = r"[^\W\d_]"
LETTERS = re.compile(rf"{LETTER}+")
# From the start of a run only and without going back, so that a text of one long run takes linear time.
MIXED = re.compile(rf"(?<![\w@$!|+(])(?:[0-9@$!|+(]*+{LETTER}++[0-9@$!|+(]++|[0-9@$!|+(]++{LETTER}{{2}})(?:{LETTER}|[0-9@$!|+(])*+")
APART = re.compile(r"(?<![^\s])[\w@$!|](?:[ ._*-][\w@$!|]){2,}(?![^\s.,;:!?])")
REPEATED = re.compile(rf"{LETTER}*({LETTER})\1\1{LETTER}*")
THRICE = re.compile(rf"({LETTER})\1\1")
SIGN = re.compile(r"[0-9@$!|+(]")


@dataclass
class Language:
    """Trigrams of characters of ALPHABET and OTHER with backoff to pairs and single characters."""

    threes: dict[str, int]
    twos: Counter = field(default_factory=Counter)
    ones: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        for gram, n in self.threes.items():
            self.twos[gram[:2]] += n
            self.ones[gram[2]] += n
        self.after = Counter()
        for gram, n in self.threes.items():
            self.after[gram[1:]] += n
        self.total = sum(self.ones.values())

    def log(self, a: str, b: str, c: str) -> float:
        three, two = self.threes.get(a + b + c, 0), self.twos.get(a + b, 0)
        pair, one = self.after.get(b + c, 0), self.ones.get(b, 0)
        p = 0.7 * (three / two if two else 0) + 0.25 * (pair / one if one else 0) + 0.05 * (self.ones.get(c, 0) + 1) / (self.total + 100)
        return math.log(p)


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """Per place the possible letters with their channel costs; a run of a letter is one place."""
    places, i = [], 0
    while i < len(stretch):
        c, n = stretch[i], 1
        while i + n < len(stretch) and stretch[i + n] == c:
            n += 1
        if c.isalpha():
            places.append([(c * n, 0.0)] if n == 1 else [(c, SHORTENED), (c + c, 0.0 if n == 2 else SHORTENED)])
        elif c in LOOKALIKES:
            places.append([(x * k, SUBSTITUTION) for x in LOOKALIKES[c] for k in range(1, min(n, 2) + 1)])
        else:
            places.append([("", DROPPED_GAP), (EDGE, KEPT_GAP)])
        i += n
    return places


def decode(stretch: str, language: Language) -> str:
    """The best path through the lattice, gaps as spaces."""
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for place in [*lattice(stretch), [(EDGE, 0.0)]]:
        after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in states.items():
            for letters, cost in place:
                x, y, s = a, b, score + cost
                for c in letters:
                    c = c if c in ALPHABET else OTHER
                    s += language.log(x, y, c)
                    x, y = y, c
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (letters, back))
        states = after
    _, back = max(states.values(), key=lambda v: v[0])
    out = []
    while back is not None:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out)).replace(EDGE, " ").strip()


class Reader:
    """Distinct restored words of a text; decoded stretches are kept in a bounded cache."""

    def __init__(self, language: Language):
        self.language, self.cache = language, {}

    def _restore(self, stretch: str) -> list[str]:
        if stretch not in self.cache:
            if len(self.cache) > CACHE_WORDS // 4:
                self.cache.clear()
            self.cache[stretch] = LETTERS.findall(decode(stretch, self.language))
        return self.cache[stretch]

    def restored(self, low: str, found: set[str] | None = None) -> list[str]:
        """Words restored from the disguised stretches of a text in lower case. found: its words as they stand, if known."""
        stretches = set(m for m in APART.findall(low) if len(set(m[::2])) > 1)
        if SIGN.search(low):
            stretches.update(m.rstrip("0123456789@$!|+(") if not m[-1].isalpha() and not SIGN.search(m.rstrip("0123456789@$!|+(")) else m for m in MIXED.findall(low))
        repeated = THRICE.search(low)
        if not stretches and not repeated:
            return []
        found = set(LETTERS.findall(low)) if found is None else found
        if repeated:  # words are distinct here, so a repeated letter is looked for once a word
            stretches.update(w for w in found if len(w) > 3 and REPEATED.fullmatch(w))
        return [w for s in stretches if s not in found or REPEATED.fullmatch(s) for w in self._restore(s)]

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        found = set(LETTERS.findall(low))
        found.update(self.restored(low, found))
        return found


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    language: Language
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.reader = Reader(self.language)
        self.starts = {f.removeprefix("=")[:LEAST] for f in self.weights}

    def __reduce__(self):
        return Model, (self.language, self.weights, self.bias)

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        for w in self.reader.words(text):
            if w[:LEAST] in self.starts:  # else none of its features counts
                found.update(f for f in features(w) if f in self.weights)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + sum(self.weights[f] for f in sorted(found))))))


def learn_language(texts: DataFrame) -> Language:
    """texts: text. Trigram counts of all texts, a Spark aggregation."""
    word = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    counts = texts.select(word.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    folded = F.regexp_replace("w", f"[^{''.join(sorted(ALPHABET - {EDGE}))}]", OTHER)
    marked = F.concat(F.lit(EDGE * 2), folded, F.lit(EDGE))
    grams = F.regexp_extract_all(marked, F.lit(r"(?s)(?=(.{3}))."), F.lit(1))  # one pass a word, however long
    found = counts.select("n", F.explode(grams).alias("g")).groupBy("g").agg(F.sum("n").alias("n"))
    return Language({r["g"]: r["n"] for r in found.collect()})  # 59**3 rows at most


def _logistic(rows: list[np.ndarray], y: np.ndarray, n: int, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by gradient steps with momentum scaled a feature."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    w, b = np.zeros(n), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    scale = np.sqrt(np.bincount(which, minlength=n) + 1.0)
    for _ in range(rounds):
        z = b + np.bincount(at, w[which], minlength=len(rows))
        d = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        w -= rate * (np.bincount(which, d[at], minlength=n) / scale / 4 + ridge * w)
        b -= 0.5 * d.mean()
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (0, 1, null)."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = materialize(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "toxicity-labels")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id")  # max_rows rows
    rows = materialize(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).repartition("doc_id"), "toxicity-sample")
    language = learn_language(docs.select(F.col("text").cast("string").alias("text")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(language)
        for b in batches:
            tally: dict[str, list[int]] = {}
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                for f in {f for w in reader.words(text) for f in features(w)}:
                    tally.setdefault(f, [0, 0])[int(toxic > 0)] += 1
            yield pd.DataFrame([(f, n[0], n[1]) for f, n in tally.items()], columns=["f", "clean", "toxic"])

    n = {r["toxic"] > 0: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(language, {}, -50.0)
    # Evidence: how much likelier the toxic rows make the feature, summed over its toxic rows.
    tallies = rows.mapInPandas(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    evidence = F.col("toxic") * F.log(((F.col("toxic") + 0.1) / n[True]) / ((F.col("clean") + 0.5) / n[False]))
    chosen = tallies.filter(evidence >= MIN_EVIDENCE)
    names = sorted(r["f"] for r in chosen.select("f").collect())  # of MAX_ROWS texts
    number = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(language)
        for b in batches:
            found = [sorted({number[f] for w in reader.words(t) for f in features(w) if f in number}) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "found": found})

    seen = rows.mapInPandas(present, "doc_id long, toxic int, found array<int>").toPandas().sort_values("doc_id")
    weights, bias = _logistic([np.asarray(x, np.int64) for x in seen["found"]], (seen["toxic"] > 0).to_numpy(np.float64), len(names))
    return Model(language, dict(zip(names, weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """docs, with all columns, and their score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_ROWS and the alphabet

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        model = shared.value
        return texts.map(model.score, na_action=None).astype("float64")

    return docs.withColumn(column, run(F.col("text").cast("string")))
