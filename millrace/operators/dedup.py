"""Exact and near duplicates by content hash and fingerprint."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import hamming

FAR, BLOCKS = 3, 5


def exact(docs: DataFrame, key: str, chash: str) -> DataFrame:
    """WIN-03, JOIN-01: rows with `first_key`, the least key of the same hash. Only keys and hashes shuffle."""
    first = docs.groupBy(F.col(chash).alias("_h")).agg(F.min(key).alias("first_key"))
    return docs.join(first, docs[chash] == first["_h"]).drop("_h")


def _keys(sim: Column, far: int, blocks: int) -> Column:
    """One key a choice of blocks - far of the blocks: hashes within `far` bits agree on at least one."""
    edges = [round(i * 63 / blocks) for i in range(blocks + 1)]
    keys = []
    for no, chosen in enumerate(combinations(range(blocks), blocks - far)):
        key, width = F.lit(no).cast("long"), 0
        for k in chosen:
            size = edges[k + 1] - edges[k]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(sim, edges[k]).bitwiseAND(F.lit((1 << size) - 1)))
            width += size
        keys.append(key)
    return F.array(*keys)


def near_pairs(docs: DataFrame, key: str, sim: str, far: int = FAR, blocks: int = BLOCKS) -> DataFrame:
    """JOIN-02: (a, b, distance) of different fingerprints within `far` bits; equal ones are one row (a = its least key).

    63 bits in `blocks` blocks, one table a choice of blocks - far of them, so keys of 25 bits by default: none is lost,
    and unlike fingerprints meet once in 2^25 a table.
    """
    reps = docs.groupBy(F.col(sim).alias("s")).agg(F.min(key).alias("k"))
    rows = reps.select("k", "s", F.explode(_keys(F.col("s"), far, blocks)).alias("band"))
    x, y = rows.alias("x"), rows.alias("y")
    d = hamming(F.col("x.s"), F.col("y.s"))
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.s") < F.col("y.s")) & (d <= far))
    return near.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.s").alias("sa"), F.col("y.s").alias("sb"), d.alias("distance")).distinct()


def verdicts(docs: DataFrame, key: str, chash: str, sim: str, far: int = FAR) -> DataFrame:
    """PAR-14: per row state `unchanged` (its hash came before) or `new`, with duplicate_of, the hash that came first
    among those before it within `far` bits. Arrival is the order of `key`; no row depends on another's verdict."""
    firsts = docs.groupBy(F.col(chash).alias("h"), F.col(sim).alias("s")).agg(F.min(key).alias("k"))
    bysim = firsts.groupBy("s").agg(F.min(F.struct("k", "h")).alias("least"))
    pairs = near_pairs(firsts, "k", "s", far)
    both = pairs.select(F.col("sa").alias("s"), F.col("sb").alias("o")).union(pairs.select("sb", "sa")).distinct()
    both = both.union(bysim.select("s", F.col("s").alias("o")))
    near = both.join(bysim.select(F.col("s").alias("o"), "least"), "o").groupBy("s").agg(F.min("least").alias("near"))
    # the first of a hash by a partial aggregate: a hash that a third of all rows share is sorted nowhere
    first = docs.groupBy(F.col(chash).alias("_h")).agg(F.min(key).alias("_first"))
    x = docs.join(first, docs[chash] == first["_h"])
    again = F.col(key) != F.col("_first")
    return x.join(near, x[sim] == near["s"], "left").select(
        key,
        F.when(again, "unchanged").otherwise("new").alias("state"),
        F.when(~again & (F.col("near.k") < F.col(key)), F.col("near.h")).alias("duplicate_of"),
    )
