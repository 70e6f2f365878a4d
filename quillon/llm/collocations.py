"""Phrase collocation mining by the relational algorithm SETM.

A text, A-Z in lower case, is cut at punctuation and line ends into pieces, and pieces into words. The relation of occurrences has a row
a word: its text's row, its place, and the number of the word in its language; there is a gap in the places between pieces,
so that neighbours in place are neighbours in a piece. It is persisted sorted and bucketed by row. The relation of one length
is merge-joined with that of single words by row and adjacent place, which takes no shuffle, and gives the occurrences of the next length;
these are counted by group, and semi-joined with the groups that are frequent before they are persisted, sorted
likewise, and extended in turn. A phrase is known by the number of its first words and that of its last, combined in one
long; frequent phrases are numbered anew, so the longs stay small. Words are told by their text, never by a hash.

Tables of frequent words and phrases are broadcast if they have MAX_BROADCAST_BYTES at most, counted; larger ones are joined by
shuffle, and what remains is dealt by row again.

A phrase of two or three words with a >= MIN_COUNT occurrences is a candidate. Cut in two, with l and r occurrences of the parts, it scores
floor(1000000 a a / (l r)), in decimals of 38 digits; the cut that scores lowest counts, of equal ones the first. Candidates inside a
longer one that has at least half of their occurrences are dropped.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count each; ties of score and a are
in order of the phrase's bytes; very long texts and pieces are read whole; a text's words are in one task; extra columns are
ignored; an empty table gives no rows. Counts beyond 10**15 are an error. The rows of docs must be the same, in the same
order, whenever they are read, as those of files are.
"""

from __future__ import annotations

import contextlib
import string
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import delete, materialize, shared_path, small

MIN_COUNT = 10
COVERED = 50
REPORTED = 2000
UNKNOWN = "und"
#: What ends a piece, and the rule for words and these.
ENDS = list(".,;:!?\n\x0b\x0c\r")
TOKEN = r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]"
MAX_BROADCAST_BYTES = 64 << 20


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """lang, at and word of each word, and the columns to keep; ends of pieces take a place, too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    return docs.select(*keep, lang, F.posexplode(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))).alias("at", "word")).filter(~F.col("word").isin(ENDS))


def _numbered(groups: DataFrame, *by: str) -> DataFrame:
    """groups with a number `id` each, about as high as there are groups."""
    n = _buckets(groups.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(groups.repartition(n, *by).withColumn("id", place * n + F.spark_partition_id()), "collocation-groups")


@contextlib.contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Tables bucketed by row may meet by row and place without a shuffle, though Spark asks by default that buckets be of all join keys; and
    are taken to be sorted as they were written, which holds for buckets of one file."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Relation:
    """Occurrences (row, at: place of the last word, id) as a table bucketed by row and sorted by row and place."""

    def __init__(self, occurrences: DataFrame):
        self.spark, self.name = occurrences.sparkSession, f"occurrences_{uuid.uuid4().hex}"
        self.path = shared_path(self.spark, "collocation-occurrences")
        occurrences.write.bucketBy(_buckets(self.spark), "row").sortBy("row", "at").option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table {self.name}")
        delete(self.spark, self.path)


def _extended(shorter: Relation, words: Relation, base: int) -> DataFrame:
    """row, at and code of the occurrences that are one word longer."""
    left = shorter.rows().select("row", (F.col("at") + 1).alias("next"), "id")
    right = words.rows().select(F.col("row").alias("__row"), "at", F.col("id").alias("word"))
    met = (F.col("row") == F.col("__row")) & (F.col("next") == F.col("at"))
    return left.hint("merge").join(right.hint("merge"), met).select("row", "at", (F.col("id") * base + F.col("word")).alias("code"))


def _frequent(occurrences: DataFrame, min_count: int) -> DataFrame:
    """code, f and id of the groups that occur often."""
    return _numbered(occurrences.groupBy("code").agg(F.count("*").alias("f")).filter(F.col("f") >= min_count), "code")


def _score(a: str, left: str, right: str) -> Column:
    digits = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {digits(a)} * {digits(a)}) div ({digits(left)} * {digits(right)})")


def _candidates(words: DataFrame, twos: DataFrame, threes: DataFrame, base: int) -> DataFrame:
    """lang, phrase, a, l, r and score of all candidates that no longer one covers."""
    first, last = (words.select(F.col("id").alias(f"w{n}"), F.col("word").alias(f"word{n}"), F.col("f").alias(f"f{n}"), *(["lang"] if n == 1 else [])) for n in (1, 2))
    pairs = twos.select("id", "code", "f", F.expr(f"code div {base}").alias("w1"), F.expr(f"code % {base}").alias("w2")).join(first, "w1").join(last, "w2")
    pairs = materialize(pairs.select("id", "code", "f", "lang", "w2", "word1", "word2", "f1", "f2"), "collocation-pairs")

    ends = pairs.select("code", F.col("id").alias("end"), F.col("f").alias("f23"), F.col("word2").alias("word3"), F.col("f2").alias("f3"))
    begin = pairs.select(F.col("id").alias("begin"), F.col("f").alias("f12"), "lang", "w2", "word1", "word2", "f1")
    triples = threes.select(F.expr(f"code div {base}").alias("begin"), F.expr(f"code % {base}").alias("w3"), F.col("f").alias("a")).join(begin, "begin")
    triples = triples.withColumn("code", F.col("w2") * base + F.col("w3")).join(ends, "code")
    early, late = _score("a", "f1", "f23"), _score("a", "f12", "f3")
    cut = F.when(early <= late, F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), early.alias("score"))).otherwise(F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), late.alias("score")))
    triples = materialize(triples.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "begin", "end", cut.alias("cut")), "collocation-triples")

    covers = triples.select(F.explode(F.array("begin", "end")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer"))
    alone = pairs.join(covers, "id", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("f")))
    alone = alone.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f", "f1", "f2").alias("score"))
    return alone.unionByName(triples.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, reported: int = REPORTED, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs: text, lang. lang, rank (from 1), phrase, a, l, r, n (words of the language) and score of each language's first phrases."""
    spark = docs.sparkSession
    counted = materialize(tokens(docs).groupBy("lang", "word").agg(F.count("*").alias("f")), "collocation-words")
    words = _numbered(counted.filter(F.col("f") >= min_count), "lang", "word")
    base = words.agg(F.max("id")).first()[0]
    if base is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    base += 1

    rows = docs.select("lang", "text", F.monotonically_increasing_id().alias("row"))
    if small(words, max_broadcast_bytes):
        dealt = rows.repartition(_buckets(spark), "row").sortWithinPartitions("row")
        placed = tokens(dealt, "row").join(F.broadcast(words), ["lang", "word"])
    else:
        placed = tokens(rows, "row").join(words, ["lang", "word"]).repartition(_buckets(spark), "row")
    ones = Relation(placed.select("row", "at", "id"))

    with co_located(spark):
        pairs = _extended(ones, ones, base)
        twos = _frequent(pairs, min_count)
        kept = twos.select("code", "id")
        pairs = pairs.join(F.broadcast(kept), "code") if small_pairs(twos, max_broadcast_bytes) else pairs.join(kept, "code").repartition(_buckets(spark), "row")
        relation = Relation(pairs.select("row", "at", "id"))
        threes = _frequent(_extended(relation, ones, base), min_count)
    for r in (ones, relation):
        r.drop()

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = _candidates(words, twos, threes, base).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= reported)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def small_pairs(groups: DataFrame, max_bytes: int) -> bool:
    """True if code and id of all groups, 32 bytes each, have max_bytes at most."""
    return groups.count() * 32 <= max_bytes
