"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the greater ones, small: the lesser ones and itself) to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    return out.filter("a != b").distinct()


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) of comparable ids to (id, component): the least id each id is linked with.

    Each round shuffles the edges twice and is written to the shared folder; the rounds grow as the logarithm of the
    size. Self-links and repeated edges are fine; ids without an edge do not appear.
    """
    cur = scratch.put(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = None
    while True:
        nxt = scratch.put(_star(_star(cur, True), False), "stars")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(cur)
        cur = nxt
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).union(cur.select(F.col("b"), F.col("b"))).distinct()
