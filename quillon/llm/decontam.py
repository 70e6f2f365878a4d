"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame
operations only.

A text is the set of its shingles of five words (lower case, runs of letters and digits; a shorter
text is one shingle). A document is contaminated by an item if it holds at least 0.8 of the item's
shingles.

Items are partitioned by size, a partition for each power of two. An item of q shingles may lack
m = floor(0.2 q) of them in a contaminated document; its sketch is its 2 m + 1 smallest hashes (bottom-k
MinHash), of which such a document holds m + 1 at least. So the share of the sketch that a document
holds estimates the containment, and no contaminated document falls short of the bound, however long it is.
A document searches only the partitions whose items it is large enough to contain. Its hashes are first looked up in a bitmap of the
hashes of all sketches, about BITS_PER_HASH bits a hash and MAX_BITS at most, which hardly any other passes; what is left in bitmaps of the
partitions. Only what remains meets the sketches, by partition and hash. Candidate pairs are verified by their shingles, as strings.

Defined results: null and word-less texts (items too) match nothing; rows with equal id are judged by
their own texts; texts of one item id form one item; extra columns are ignored, and kept by clean(); empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import fresh, materialize, small

SHINGLE = 5
CONTAINMENT = 0.8
#: An index of so many bytes, counted, is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_BYTES = 64 << 20
BITS_PER_HASH = 64
#: Of all bitmaps together; with fewer bits a hash more hashes pass, which only costs work.
MAX_BITS = 1 << 28


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once a row however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))))


def shingle_hashes(text: Column) -> Column:
    return _once(words(text), lambda w: F.array_distinct(F.transform(_starts(w), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))))


def shingles(text: Column) -> Column:
    return _once(words(text), lambda w: F.array_distinct(F.transform(_starts(w), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))))


def least_size(n_item: Column) -> Column:
    """The shingles that a document has at least if it contains an item of n_item."""
    return F.ceil(n_item * F.lit(CONTAINMENT) - F.lit(1e-9))


def index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items (item_id, n_item, set: shingles) and their sketches (part, item_id, n_item, need, h)."""
    parts = items.select("item_id", F.explode(shingles(F.col("text").cast("string"))).alias("shingle"))
    sets = parts.groupBy("item_id").agg(F.collect_set("shingle").alias("set")).withColumn("n_item", F.size("set").cast("long"))
    sets = materialize(sets.withColumn("part", F.floor(F.log2("n_item")).cast("int")), "decontam-items")
    hashes = sets.select("part", "item_id", "n_item", F.explode("set").alias("shingle"))
    hashes = hashes.select("part", "item_id", "n_item", F.xxhash64(F.split("shingle", " ")).alias("h")).distinct()
    lack = F.floor(F.col("n_item") * F.lit(round(1 - CONTAINMENT, 9)) + F.lit(1e-9))
    by_item = Window.partitionBy("part", "item_id")
    ranked = hashes.withColumns({"nth": F.row_number().over(by_item.orderBy("h")), "of": F.count("*").over(by_item)})
    sketch = ranked.filter(F.col("nth") <= 2 * lack + 1).withColumn("need", F.least("of", 2 * lack + 1) - lack)
    return sets, materialize(sketch.select("part", "item_id", "n_item", "need", "h"), "decontam-sketches")


def _bitmaps(sketch: DataFrame, parts: list[int]) -> tuple[DataFrame, int]:
    """A row with `maps`, an array of bitmaps: one of the hashes of all sketches, and one of those of each partition. And the bits
    of a bitmap, a power of two."""
    bits = max(64, min(1 << max(0, BITS_PER_HASH * sketch.count() - 1).bit_length(), 1 << (MAX_BITS // (len(parts) + 1)).bit_length() - 1))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    numbers = F.array(F.lit(0), F.array_position(F.array(*map(F.lit, parts)), F.col("part")).cast("int"))
    some = sketch.select(F.explode(numbers).alias("number"), F.shiftright(place, 6).alias("word"), bit.alias("bits"))
    none = sketch.sparkSession.range((len(parts) + 1) * (bits // 64)).select(F.floor(F.col("id") / (bits // 64)).cast("int").alias("number"), (F.col("id") % (bits // 64)).alias("word"), F.lit(0).cast("long").alias("bits"))
    padded = some.unionByName(none).groupBy("number", "word").agg(F.bit_or("bits").alias("bits"))
    one = padded.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("map"))
    return materialize(one.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "map"))), lambda x: x["map"]).alias("maps")), "decontam-bitmaps"), bits


def _in(bitmap: Column, h: Column, bits: int) -> Column:
    place = h.bitwiseAND(F.lit(bits - 1))
    word = F.get(bitmap, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def searched(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """doc_id, text_key, n_doc, part and h: the hashes of each document that may be in the sketches of a partition that is open to it."""
    found = sketch.groupBy("part").agg(least_size(F.min("n_item")).cast("long").alias("least")).orderBy("part").collect()  # a row a power of two
    if not found:
        return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lit(0).alias("n_doc"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("h")).limit(0)
    maps, bits = _bitmaps(sketch, [r["part"] for r in found])
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), shingle_hashes(F.col("text")).alias("hs"))
    # Neither filters that Spark infers for explode() nor for null sizes may reach hs, which would be worked out again for them.
    every = hashed.select("doc_id", "text_key", F.coalesce(F.size("hs"), F.lit(0)).alias("n_doc"), F.explode_outer("hs").alias("h")).filter("h is not null")
    some = every.filter(_in(F.get(maps.scalar(), F.lit(0)), F.col("h"), bits))
    open_ = F.array(*[F.struct(F.lit(n + 1).alias("number"), F.lit(r["part"]).alias("part"), F.lit(r["least"]).alias("least")) for n, r in enumerate(found)])
    some = some.withColumn("p", F.explode(open_)).filter(F.col("n_doc") >= F.col("p.least"))
    return some.filter(_in(F.get(maps.scalar(), F.col("p.number")), F.col("h"), bits)).select("doc_id", "text_key", "n_doc", "p.part", "h")


def _joined(rows: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    return rows.join(F.broadcast(right) if small(right, MAX_BROADCAST_BYTES) else right, on)


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs: doc_id, text. items: item_id, text. One row for each document and item that it
    contains: doc_id, text_key (a hash of the document's text), item_id, n_item and n_shared."""
    sets, sketch = index(items)
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hits = searched(keyed, sketch)
    met = _joined(hits, sketch, ["part", "h"]).filter(F.col("n_doc") >= least_size(F.col("n_item")))
    met = met.groupBy("doc_id", "text_key", "item_id", "need").agg(F.count("*").alias("n")).filter(F.col("n") >= F.col("need"))
    pairs = materialize(met.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_text"), F.col("item_id").alias("of_item")), "decontam-candidates")

    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_text"))
    found = _joined(keyed.join(pairs, same), _packed(sets), F.col("of_item").eqNullSafe(F.col("item_id")))
    shared = F.size(F.array_intersect(shingles(F.col("text")), F.split("packed", "\n"))).cast("long")
    found = found.select("doc_id", F.col("of_text").alias("text_key"), "item_id", "n_item", shared.alias("n_shared"))
    return found.filter(F.col("n_shared") >= F.col("n_item") * CONTAINMENT - 1e-9).distinct()


def _packed(sets: DataFrame) -> DataFrame:
    """The items' sets as text, whose bytes can be counted; no shingle holds a line feed."""
    return materialize(sets.select("item_id", "n_item", F.array_join("set", "\n").alias("packed")), "decontam-sets")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of each find, repeated rows once."""
    found = contained(docs, items).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that contain no item."""
    of, of_text = fresh(docs, "of", "of_text")
    found = materialize(contained(docs, items).select(F.col("doc_id").alias(of), F.col("text_key").alias(of_text)).distinct(), "decontam-found")
    same = docs["doc_id"].eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"].cast("string")) == F.col(of_text))
    return docs.join(found, same, "left_anti")
