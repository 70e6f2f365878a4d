"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a place in [0, 2**24), the first 24 bits of md5(doc_id). A source takes the
documents below a threshold. The threshold comes from two histograms: tokens by source and upper
12 bits give the bucket in which the budget runs out, and a second histogram refines that bucket
alone. Nothing is sorted but at most 4096 buckets of one source.

What the boundary bucket leaves of a budget (less than its documents are long) goes to a nested
threshold over the documents that lie beyond the first one and still fit, ROUNDS times in all.

If rows share the place where the last round ends and some still fit, their ties are refined alike: by
a hash of the text, and rows of one such hash by a hash of their number. So at most one row's words are missing
from a target, however many rows share a place.

Defined results: null texts have size 0; null ids share one place; equal ids share a place and are
taken or left together unless a target's boundary lies in that place; a source without words has target 0; an empty table gives an empty result;
columns other than doc_id, text and source are ignored by the plan and kept by apply().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import fresh, materialize, n_words

BITS = 12
PLACES = 1 << (2 * BITS)
ROUNDS = 3
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)


def place(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 2 * BITS // 4), 16, 10).cast("long")


def ties(text: Column, number: Column) -> list[Column]:
    """The places of a row among those that share its place: by text, and by row number."""
    return [F.pmod(F.xxhash64(text.cast("string")), F.lit(PLACES)), F.pmod(F.xxhash64(number), F.lit(PLACES))]


def measure(docs: DataFrame, number: Column | None = None) -> DataFrame:
    """doc_id, source, size and places of every document. number tells rows apart; without it they are counted."""
    number = F.monotonically_increasing_id() if number is None else number
    by_text, by_number = ties(F.col("text"), number)
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place"), by_text.alias("tie"), by_number.alias("tie2")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source: its weight, size and target. Targets share all words by weight; none
    exceeds MAX_COPIES times its source, and the excess is shared again by weight. In order of
    size over weight the sources at their limit come first, so two running sums give the level.
    The rows here are sources, not documents."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = (F.row_number().over(ordered) - 1) % len(WEIGHTS)
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (cycle + 1).cast("int")).cast("long"))
    by_room = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    room = F.col("source_size") * MAX_COPIES
    level = per_source.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(room).over(before), F.lit(0)))
    level = level.withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = level.withColumn("level", F.col("left").cast("double") / F.col("weights_left").cast("double"))
    # The first source that its share doesn't fill sets the level for all after it.
    level = level.withColumn("nth", F.row_number().over(by_room))
    level = level.withColumn("first_open", F.struct("nth", "level")).withColumn("first_open", F.min(F.when(F.col("level") * F.col("weight") <= room, F.col("first_open"))).over(everything))
    level = level.withColumn("level", F.col("first_open.level"))
    target = F.least(room.cast("double"), F.col("level") * F.col("weight"))
    return level.select("source", "source_size", "weight", F.coalesce(target, room.cast("double")).alias("target"))


def _threshold(eligible: DataFrame, label: str) -> DataFrame:
    """eligible: source, size, place and need. One row a source: the largest threshold below which
    the sizes sum to need at most, and that sum."""
    upper, lower = F.shiftright("place", BITS), F.col("place").bitwiseAND((1 << BITS) - 1)
    coarse = eligible.groupBy("source", "need", upper.alias("bucket")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket")
    coarse = coarse.withColumn("through", F.sum("words").over(running))
    over = F.col("through") > F.col("need")
    coarse = materialize(
        coarse.groupBy("source", "need").agg(F.min(F.when(over, F.col("bucket"))).alias("boundary"), F.coalesce(F.max(F.when(~over, F.col("through"))), F.lit(0)).alias("below")),
        f"{label}-coarse",
    )
    inside = coarse.filter("boundary is not null").withColumnRenamed("source", "of").drop("need")
    fine = eligible.join(inside, F.col("source").eqNullSafe(F.col("of")) & (upper == F.col("boundary")))
    fine = fine.groupBy("source", "need", "boundary", "below", lower.alias("bucket")).agg(F.sum("size").alias("words"))
    fine = fine.withColumn("through", F.sum("words").over(running) + F.col("below"))
    over = F.col("through") > F.col("need")
    fine = fine.groupBy("source", "boundary", "below").agg(F.min(F.when(over, F.col("bucket"))).alias("bucket"), F.coalesce(F.max(F.when(~over, F.col("through"))), F.min("below")).alias("got"))
    fine = fine.select(F.col("source").alias("of"), (F.shiftleft("boundary", BITS) + F.col("bucket")).alias("threshold"), "got")
    out = coarse.join(fine, F.col("source").eqNullSafe(F.col("of")), "left")
    return materialize(out.select("source", F.coalesce("threshold", F.lit(PLACES)).alias("threshold"), F.coalesce("got", "below").alias("got")), label)


def plan(docs: DataFrame, number: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The measured documents, and one row a source: source_size, target, whole (full copies of
    all its documents) and rounds, an array of (start, threshold, fits): a document gets one copy more if in
    a round its place lies from start up to threshold and its size is at most fits; so does a row at the place
    ties.at that is below ties.tie and fits ties.need, or is at ties.tie, below ties.tie2 and fits ties.need2."""
    sizes = materialize(measure(docs, number), "mix-sizes")
    per_source = targets(sizes).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per_source = per_source.withColumn("need", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    per_source = materialize(per_source.withColumn("start", F.lit(0).cast("long")).withColumn("rounds", F.array().cast("array<struct<start:bigint,threshold:bigint,fits:bigint>>")), "mix-sources")
    for n in range(ROUNDS):
        side = per_source.select(F.col("source").alias("of"), "need", "start")
        fits = F.col("source").eqNullSafe(F.col("of")) & (F.col("place") >= F.col("start")) & (F.col("size") <= F.col("need"))
        eligible = sizes.join(side, fits).select("source", "size", "place", "need")
        found = _threshold(eligible, f"mix-round{n}").select(F.col("source").alias("of"), "threshold", "got")
        joined = per_source.join(found, F.col("source").eqNullSafe(F.col("of")), "left")
        threshold = F.coalesce("threshold", F.lit(PLACES))
        per_source = materialize(
            joined.select(
                "source", "source_size", "weight", "target", "whole",
                (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"),
                threshold.alias("start"),
                F.concat("rounds", F.array(F.struct("start", threshold.cast("long").alias("threshold"), F.col("need").alias("fits")))).alias("rounds"),
            ),
            f"mix-sources{n}",
        )
    # Ties at the place that the last round refused; the rounds took nothing from there.
    side = per_source.select(F.col("source").alias("of"), "need", "start")
    at_end = F.col("source").eqNullSafe(F.col("of")) & (F.col("place") == F.col("start")) & (F.col("size") <= F.col("need"))
    eligible = sizes.join(side, at_end).select("source", "size", F.col("tie").alias("place"), "need")
    found = _threshold(eligible, "mix-ties").select(F.col("source").alias("of"), F.col("threshold").alias("tie"), "got")
    joined = per_source.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    per_source = materialize(joined.withColumn("tie", F.coalesce("tie", F.lit(-1)).cast("long")).withColumn("need2", F.col("need") - F.coalesce("got", F.lit(0))).drop("got"), "mix-sources-ties")
    side = per_source.select(F.col("source").alias("of"), F.col("need2").alias("need"), "start", F.col("tie").alias("end"))
    eligible = sizes.join(side, at_end & (F.col("tie") == F.col("end"))).select("source", "size", F.col("tie2").alias("place"), "need")
    found = _threshold(eligible, "mix-ties2").select(F.col("source").alias("of"), F.col("threshold").alias("tie2"))
    joined = per_source.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return sizes, materialize(joined.withColumn("ties", F.struct(F.col("start").alias("at"), "tie", "need", F.coalesce("tie2", F.lit(0)).alias("tie2"), "need2")), "mix-plan")


def copies(size: Column, at: Column, tie: Column, tie2: Column, whole: Column, rounds: Column, end: Column) -> Column:
    """How often the mix takes a document."""
    chosen = F.exists(rounds, lambda r: (at >= r["start"]) & (at < r["threshold"]) & (size <= r["fits"]))
    below = (tie < end["tie"]) & (size <= end["need"])
    chosen = chosen | ((at == end["at"]) & (below | ((tie == end["tie"]) & (tie2 < end["tie2"]) & (size <= end["need2"]))))
    return whole + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (size times copies), a row a document."""
    sizes, per_source = plan(docs)
    side = per_source.select(F.col("source").alias("of"), "source_size", "target", "whole", "rounds", "ties")
    joined = sizes.join(side, F.col("source").eqNullSafe(F.col("of")))
    n = copies(F.col("size"), F.col("place"), F.col("tie"), F.col("tie2"), F.col("whole"), F.col("rounds"), F.col("ties"))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * n).alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """docs with all its columns, each row as often as the mix takes it. Rows without words count
    nothing towards a target and are kept once."""
    of, whole, rounds, end, number, size, at, copy = fresh(docs, "of", "whole", "rounds", "ties", "number", "words", "place", "copy")
    # A row's number must be the same in the plan and here.
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "mix-numbered")
    _, per_source = plan(numbered, F.col(number))
    side = per_source.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("rounds").alias(rounds), F.col("ties").alias(end))
    joined = numbered.withColumns({size: n_words(F.col("text")), at: place(F.col("doc_id"))})
    joined = joined.join(side, F.col("source").cast("string").eqNullSafe(F.col(of)))
    n = F.when(F.col(size) == 0, 1).otherwise(copies(F.col(size), F.col(at), *ties(F.col("text"), F.col(number)), F.col(whole), F.col(rounds), F.col(end)))
    # An array of n elements, exploded, gives n rows and none for 0.
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*docs.columns)
