"""Exact check of candidate pairs: are the texts of two records alike?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch
from .texts import jaccard, runs_of, tokens

#: Token run length and least similarity of "alike".
RUN, LEAST = 3, 0.65
#: Up to this many wanted records are sent to all tasks to filter the texts; more are joined by a shuffle.
SENT = 200_000


def _sets(batches):
    import pyarrow as pa

    for b in batches:
        out = runs_of([tokens(t) for t in b.column("text").to_pylist()], RUN)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.view("int64") for x in out], pa.list_(pa.int64()))], names=["id", "runs"])


def _ratio(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        va, vb = b.column("ra"), b.column("rb")
        sim = [jaccard(np.asarray(x.values).view("uint64"), np.asarray(y.values).view("uint64")) if x.is_valid and y.is_valid else 0.0 for x, y in zip(va, vb)]
        keep = pa.array([s >= LEAST for s in sim])
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(keep)


def verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (a, b) of `pairs` whose texts (id, text; equal ids have equal texts) are alike.

    Only the texts of wanted ids are tokenized. The wanted ids are counted: few are sent to the scan of the texts, many
    are joined. Then the sets, not the texts, meet their pairs.
    """
    pairs = scratch.put(pairs.select("a", "b").distinct(), "pairs")
    wanted = scratch.put(pairs.select(F.col("a").alias("want")).union(pairs.select("b")).distinct(), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.join(side, texts["id"] == side["want"], "left_semi").select("id", "text")
    sets = scratch.put(found.mapInArrow(_sets, f"id {kind}, runs array<long>").dropDuplicates(["id"]), "sets")
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    return x.select("a", "b", "ra", "rb").mapInArrow(_ratio, f"a {kind}, b {kind}")
