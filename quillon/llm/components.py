"""Connected components of an edge table by alternating stars, in DataFrame operations.

Each round links every node's larger neighbours to its smallest neighbour, then every node's smaller
neighbours likewise. Rounds go on until the edges stay as they are, each node then pointing at the
smallest of its component. Edges are written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint, any order, repeats allowed). One row for each node that has an edge and
    isn't the smallest of its component: node, root. Rounds are about the log of the longest path."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "star-edges")
    state = _state(edges)
    before = None
    while state[0] and state != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star-small")
        discard(last, large)
        before, state = state, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
