"""Per-key results without imbalance: exact offset chunking.

Rows are ranged over (key, member), so a hot key spans as many partitions as it needs, and written sorted; a streaming
pass numbers the rows of each key within its partition. Keys are counted per partition; as the order is global, only a
partition's first key can have begun before it, so the prefix sums reduce to at most one offset per partition. Number
plus offset is a row's exact place in its key, and place // chunk its chunk. Chunks hold equally many rows however the
keys are distributed; each leaves a state (different members, first and last member, least row), and the ordered states
of a key merge: a member that ends one state and begins the next counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import Scratch

#: Rows of a key that one chunk holds.
CHUNK = 50_000


def _number(batches):
    """Sorted (k, m, o) batches of one partition, with the row's number in its key and whether its member is new."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        k, m = b.column("k"), b.column("m")
        new_k, new_m = np.ones(n, bool), np.ones(n, bool)
        if n > 1:
            new_k[1:] = pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new_m[1:] = pc.not_equal(m.slice(1), m.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        goes_on = last is not None and last[0] == k[0].as_py()
        new_k[0], new_m[0] = not goes_on, not goes_on or last[1] != m[0].as_py()
        starts = np.flatnonzero(new_k)
        at = np.arange(n)
        base = np.full(n, -count if goes_on else 0)
        if len(starts):
            begun = np.searchsorted(starts, at, side="right")
            base = np.where(begun > 0, starts[np.maximum(begun - 1, 0)], base)
        r = at - base
        last, count = (k[n - 1].as_py(), m[n - 1].as_py()), int(r[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, "int64")), k, m, b.column("o"), pa.array(r.astype("int64")), pa.array((new_k | new_m).astype("int64"))], names=["part", "k", "m", "o", "r", "fresh"])


def distinct_and_first(rows: DataFrame, key: Column, member: Column, order: Column, chunk: int = CHUNK) -> DataFrame:
    """Per key: n (different members) and first (the member with the least order value, then the least member).

    Rows with a null key or member are left out; a null or NaN order value comes after all others; ties go to the least
    member. Repeated rows and empty input are fine. The columns of `rows` may have any names.
    """
    scratch = Scratch(rows.sparkSession, "chunks")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    o = order.cast("double")
    flat = rows.select(key.alias("k"), member.alias("m"), F.when(~F.isnan(o), o).alias("o")).filter("k is not null and m is not null")
    # a member given again and again is one row from here on, brought together by partial aggregates
    flat = flat.groupBy("k", "m").agg(F.min("o").alias("o"))
    ordered = flat.repartitionByRange(parts, "k", "m").sortWithinPartitions("k", "m")
    ranged = scratch.put(ordered.mapInArrow(_number, "part long, k string, m string, o double, r long, fresh long"), "sorted")
    held = ranged.groupBy("part", "k").agg(F.count("*").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only a partition's first key has an offset: at most `parts` rows, whatever the size of the data
    offsets = held.withColumn("before", earlier).filter("before > 0").select(F.col("part").alias("p"), F.col("k").alias("pk"), "before")
    placed = ranged.join(F.broadcast(offsets), (F.col("part") == F.col("p")) & (F.col("k") == F.col("pk")), "left")
    place = F.col("r") + F.coalesce("before", F.lit(0))
    states = placed.groupBy("k", F.floor(place / chunk).alias("chunk"), "part").agg(
        F.sum("fresh").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.min(F.struct(F.col("o").isNull().alias("late"), "o", "m")).alias("best")
    )
    seen = F.lag("hi").over(Window.partitionBy("k").orderBy("chunk", "part"))
    # within a partition a member that goes on into the next chunk is not fresh there, so only other partitions overlap
    other = F.lag("part").over(Window.partitionBy("k").orderBy("chunk", "part")) != F.col("part")
    twice = F.when(other & (seen == F.col("lo")), 1).otherwise(0)
    return states.withColumn("twice", twice).groupBy("k").agg((F.sum("n") - F.sum("twice")).alias("n"), F.min("best").alias("best")).select("k", "n", F.col("best.m").alias("first"))
