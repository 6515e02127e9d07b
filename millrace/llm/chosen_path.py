"""Similarity join of token-run sets by chosen paths.

A set x walks a random tree: at a node it goes on to the child of each of its tokens t for which hash(node, t) <
1 / (least * |x|). Two sets of Braun-Blanquet similarity `least` or more (which Jaccard implies) expect at least one
common child at every node they share, so they meet again with a fixed probability a run, while unlike sets part. Every
set starts with two levels at once; buckets that are still large split further, small ones are compared outright. Runs
repeat until the chance that a pair at the threshold is missed in all of them is below 1 - recall. A pair survives a deep
level less often, so sets that stood in a bucket that was split walk further runs among themselves, as many as the
deepest level that was walked asks for: half of 1 - recall is for pairs never in such a bucket, half for the others.

Copies (equal sets) are one row throughout. A row carries its set's size and a 128-bit one-bit minwise sketch, so most
unlike pairs of a bucket fall before the exact check. Buckets that no path splits (more near-copies than SMALL) are
compared in blocks spread over tasks, without a cap.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch
from .alike import LEAST, RUN, SENT
from .texts import jaccard, mix, runs_of, signature, tokens

#: Levels walked at once, largest bucket compared outright, greatest depth, wanted recall at the threshold.
FIRST, SMALL, DEEPEST, RECALL = 2, 128, 8, 0.9999
SIGMAS = 4.5
#: Odd multipliers of 32 bits: products of that width go through wide registers.
_SALTS = (mix(np.arange(1, 129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_NODE = np.uint64(0x9FB21C651E98DF25)
_ODD, _ODD2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def repeats(recall: float = RECALL, levels: int = FIRST) -> int:
    """Runs needed: a pair survives a level with 1 - exp(-survival of the rest), being Poisson(1) at the threshold."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def runs_to(level: int) -> int:
    """Runs for pairs whose buckets are split down to `level`."""
    return repeats(1 - (1 - RECALL) / 2, level)


def sketch_bits(least: float) -> int:
    """Bits of 128 that two sketches must share: SIGMAS standard deviations below the mean at the threshold, which a pair at
    the threshold misses with a chance of 3 in a million, far below 1 - RECALL."""
    p = (1 + least) / 2
    return math.floor(128 * p - SIGMAS * math.sqrt(128 * p * (1 - p)))


def _high(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def children(nodes: np.ndarray, tokens_: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Keys of all children of the nodes that the set chooses."""
    if not len(nodes) or not len(tokens_):
        return np.empty(0, np.uint64)
    h = _high(nodes)[:, None] ^ _high(tokens_)[None, :]  # both are well mixed already
    h *= _ODD
    h ^= h >> np.uint32(16)
    h *= _ODD2
    p = 1.0 / (least * len(tokens_))
    limit = np.uint32(min(2**32 - 1, p * 2.0**32))
    at = np.flatnonzero(h.ravel() <= limit)
    r = at // len(tokens_)
    c = at - r * len(tokens_)
    return mix(nodes[r] * _NODE ^ tokens_[c])


def sketch(tokens_: np.ndarray) -> tuple[int, int]:
    """128 bits: one bit of the minimum under each of 128 multiplicative hashes (the tokens are hashes themselves)."""
    if not len(tokens_):
        return 0, 0
    low = (tokens_.astype(np.uint32)[:, None] * _SALTS[None, :]).min(axis=0)
    v = np.packbits((mix(low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return int(v[0]), int(v[1])


@lru_cache(maxsize=16)
def roots(first: int = 0, last: int | None = None) -> np.ndarray:
    """Roots of the runs after `first` up to `last`, by default those that all sets walk."""
    return mix(np.arange(first + 1, (runs_to(FIRST) if last is None else last) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def start(set_: np.ndarray, least: float, first: int = 0, last: int | None = None) -> np.ndarray:
    """Nodes of a set at level FIRST in these runs."""
    keys = roots(first, last)
    for _ in range(FIRST):
        keys = children(keys, set_, least)
    return np.unique(keys).view("int64")


#: What `walk` gives of a set.
WALKED = "sid long, n int, s1 long, s2 long, keys array<long>"
_NAMES = ["sid", "n", "s1", "s2", "keys"]


def walk(sets: list[np.ndarray], least: float) -> list:
    """Arrow columns as WALKED: name, size, sketch and nodes at level FIRST of each set."""
    import pyarrow as pa

    cols: list[list] = [[], [], [], [], []]
    for s in sets:
        a, z = sketch(s)
        for c, v in zip(cols, (signature(s), len(s), a, z, start(s, least))):
            c.append(v)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return [pa.array(c, k) for c, k in zip(cols, kinds)]


def _walk(batches):
    import pyarrow as pa

    for b in batches:
        b = b.filter(b.column("text").is_valid())
        sets = runs_of([tokens(t) for t in b.column("text").to_pylist()], RUN)
        yield pa.RecordBatch.from_arrays([b.column("id"), *walk(sets, LEAST)], names=["id", *_NAMES])


def _token_sets(batches):
    """Texts to the sets of their token runs, with their names."""
    import pyarrow as pa

    for b in batches:
        sets = runs_of([tokens(t) for t in b.column("text").to_pylist() if t is not None], RUN)
        yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.view("int64") for s in sets], pa.list_(pa.int64()))], names=["sid", "runs"])


def _alike(least: float):
    """Pairs with both sets to those that are similar enough."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = [jaccard(np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64)) >= least for x, y in zip(b.column("ra"), b.column("rb"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _extend(least: float):
    """Rows (set, nodes) to the children of the nodes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets, nodes = b.column("runs"), b.column("nodes")
            keys = [np.unique(children(np.asarray(k.values).view(np.uint64), np.asarray(s.values).view(np.uint64), least)).view("int64") for s, k in zip(sets, nodes)]
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("n"), b.column("s1"), b.column("s2"), pa.array(keys, pa.list_(pa.int64()))], names=_NAMES)

    return run


def _again(least: float, first: int, last: int):
    """Sets to their nodes in further runs."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = [start(np.asarray(s.values).view(np.uint64), least, first, last) for s in b.column("runs")]
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("n"), b.column("s1"), b.column("s2"), pa.array(keys, pa.list_(pa.int64()))], names=_NAMES)

    return run


def _near(a: str, b: str, least: float):
    """Sizes and sketches of two rows leave the threshold possible."""
    same = F.lit(128) - F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) - F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    return (F.col(f"{a}.sid") < F.col(f"{b}.sid")) & (F.least(f"{a}.n", f"{b}.n") >= least * F.greatest(f"{a}.n", f"{b}.n") - 1e-9) & (same >= sketch_bits(least))


def _compare(small: DataFrame, least: float) -> DataFrame:
    """Pairs of every small bucket that sizes and sketches leave; a bucket has at most SMALL rows."""
    b = small.groupBy("key").agg(F.collect_list(F.struct("sid", "n", "s1", "s2")).alias("m"))
    x = b.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y"))
    return x.filter(_near("x", "y", least)).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))


def _blocks(large: DataFrame, least: float) -> DataFrame:
    """Pairs of the buckets no path splits: each row meets the blocks of its bucket, block pairs being spread over tasks."""
    x = large.withColumn("blocks", F.ceil(F.col("size") / SMALL).cast("int")).drop("size").withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    left = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    right = x.alias("y")
    j = left.join(right, (F.col("x.key") == F.col("y.key")) & (F.col("x.other") == F.col("y.blk")))
    return j.filter(_near("x", "y", least)).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))


def pairs_of(sets: DataFrame, read, scratch: Scratch, least: float) -> DataFrame:
    """sets(WALKED), written down, one row a set that is not empty, to the pairs (a, b) of sids to check exactly.

    read: a table of sids to (sid, runs), one row each; asked once, for the sets in large buckets.
    """
    # only names and keys are shuffled; sizes and sketches come back to the few rows that share a bucket
    rows, facts = sets.select("sid", F.explode("keys").alias("key")), sets.select("sid", "n", "s1", "s2")
    found, level, sets_, split = [], FIRST, None, None
    deepest, done = FIRST, runs_to(FIRST)
    while True:
        # buckets are counted by partial sums and met by a join, which splits a hot one; only buckets of two or more
        # stay, a small share of all rows
        # (a key has one size, so the hashed side of the join is even, and nothing has to be sorted)
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").hint("shuffle_hash")
        sized = scratch.put(rows.join(sizes, "key").join(facts, "sid"), f"buckets{level}")
        found.append(_compare(sized.filter(f"size <= {SMALL}"), least))
        large = sized.filter(f"size > {SMALL}")
        deepest, none = max(deepest, level), large.isEmpty()
        if none or level >= DEEPEST:
            if not none:
                found.append(_blocks(large, least))
            if split is None or runs_to(deepest) <= done:
                break
            rows = split.mapInArrow(_again(least, done, runs_to(deepest)), WALKED)
            level, done = FIRST, runs_to(deepest)
        else:
            open_ = large.groupBy("sid").agg(F.first("n").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.collect_list("key").alias("nodes"))
            if sets_ is None:  # deeper levels and further runs need a part of them
                sets_ = scratch.put(read(large.select("sid").distinct()), "sets")
                split = scratch.put(open_.drop("nodes").join(sets_, "sid"), "split")
            rows = open_.join(sets_, "sid").select("sid", "n", "s1", "s2", "nodes", "runs").mapInArrow(_extend(least), WALKED)
            level += 1
        # written down, as both the counts and the rows are made of it
        rows = scratch.put(rows.select("sid", "keys"), "walk").select("sid", F.explode("keys").alias("key"))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.union(f)
    return pairs.distinct()


def verified(pairs: DataFrame, read, scratch: Scratch, least: float) -> DataFrame:
    """The pairs (a, b) of sids whose sets are similar enough; `read` as for `pairs_of`."""
    pairs = scratch.put(pairs, "pairs")
    sets = scratch.put(read(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()), "sets")
    z = pairs.join(sets.select(F.col("sid").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("sid").alias("b"), F.col("runs").alias("rb")), "b")
    return z.select("a", "b", "ra", "rb").mapInArrow(_alike(least), "a long, b long")


def reader(holders: DataFrame, records: DataFrame, build, sets_of, scratch: Scratch):
    """A function from a table of sids to (sid, runs). holders(sid, holder): a record that has the set; build: records with
    `id` to what sets_of (Arrow batches to sid, runs) takes. Records that are no holder are left out by their id, before
    anything of them is parsed; few holders are sent to the scan."""

    def read(sids: DataFrame) -> DataFrame:
        held = scratch.put(sids.join(holders, "sid"), "held")
        side = held.select(F.col("holder").alias("want")).distinct()
        side = F.broadcast(side) if held.count() <= SENT else side
        found = build(records.join(side, records["id"] == side["want"], "left_semi")).drop("id")
        return found.mapInArrow(sets_of, "sid long, runs array<long>").dropDuplicates(["sid"]).join(held.select("sid"), "sid", "left_semi")

    return read


def one_each(walked: DataFrame) -> DataFrame:
    """One row of each set of a table with sid and row, a number that is written down; only those two are shuffled where the
    names are few, and never are the nodes aggregated."""
    first = walked.groupBy("sid").agg(F.min("row").alias("row")).select("row")
    return walked.join(first, "row", "left_semi").drop("row")


def similar(records: DataFrame, scratch: Scratch, build=None) -> tuple[DataFrame, DataFrame]:
    """Records with `id`, of which build makes (id, text) (they have both by default), to (members(id, sid), pairs(a, b) of
    different sets that are alike); null texts and texts without a run of tokens are in no set."""
    build = build or (lambda r: r.select("id", "text"))
    kind = records.schema["id"].dataType.simpleString()
    walked = scratch.put(build(records).mapInArrow(_walk, f"id {kind}, {WALKED}").withColumn("row", F.monotonically_increasing_id()), "walked").filter("n > 0")
    sets = scratch.put(one_each(walked).withColumnRenamed("id", "holder"), "classes")
    read = reader(sets.select("sid", "holder"), records, build, _token_sets, scratch)
    return walked.select("id", "sid"), verified(pairs_of(sets, read, scratch, LEAST), read, scratch, LEAST)
