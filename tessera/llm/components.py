"""Connected components of a distributed edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """edges(a long, b long) -> (node, root): root is the smallest node that can be reached. Nodes without an edge are not listed.

    Each round is two aggregations by node and two joins; rows never exceed the edges, and the rounds are logarithmic in
    the longest path. Minima are aggregated before the shuffle, and a hub's rows sit in plain sort-merge joins, which
    adaptive execution splits. Each round is a written table, so a lost executor repeats one round at most.
    rows: about how many edges there are, if that is known. Empty edges give an empty result; self-loops and repeated edges are ignored.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs(u, v): each u's least neighbour m is linked with u's larger (large) or smaller neighbours."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        linked = pairs.join(least, "u")
        if large:
            return linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    seen = state(current)
    while seen[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True).filter("a <> b").distinct()
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).filter("a <> b").distinct()
        after = scratch.table(small, "round", seen[0])
        now = state(after)
        scratch.drop(current)
        current = after
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
