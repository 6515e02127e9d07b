"""Parent-child links to full hierarchies by recursive fragment contraction.

Each partition contracts its own parent chains to *exits* (the first ancestor outside the partition). The exits form a
much smaller quotient forest whose edges carry lengths and node counts; it is solved by the same procedure until it fits
one bounded task, and the answers expand the fragments. Circles show either inside a fragment or in the quotient. Where
full paths are asked for, a row also carries its label, the nodes of its chain down from where the fragment was entered;
a node's path is its exit's path and then its own label, so paths come out of the same expansion.

Every level places its rows so that a task holds about `base_rows` of them, however large the table is.

The first level ranges over a locality column (arrival time), so leaves and local chains vanish at once. Later levels
place a node by a coin: heads stay by their own key, tails move to their parent's place, so about a quarter of all links
become local whatever the order of the data. Children of a parent with more than `base_rows` of them stay by their own
key, so one hot parent fills no task.

Defined cases: null node rows are dropped; a node given several times counts once and keeps its least non-null parent; a
parent that is no node counts as none; empty input gives no rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch

#: Rows that one task may hold; a quotient of at most this many rows is solved in one task.
BASE_ROWS = 250_000

#: Of a row: len and w are the length of its parent edge and its own node count; r0 and d0 its root and depth, should it have no parent.
_ROW = ["id", "parent", "len", "w", "bad", "r0", "d0"]
_FRAG = "frag long, id string, parent string, len long, w long, bad int, r0 string, d0 long, exit string, qlen long, qr0 string, qd0 long"
_OUT = "id string, root string, depth long, total long, bad int"
_NOTHING: dict = {"id": [], "root": [], "depth": [], "total": [], "bad": []}
#: With paths: a row's own label, and that of its whole chain in the fragment.
_LAB, _QLAB, _PATH = ", lab array<string>", ", qlab array<string>", ", path array<string>"


def _chains(ids: list, parents: list, lens: list, bads: list):
    """Local solution: for each row the index of its local parent (-1: none), local root, distance to it and state.

    State 0: the chain leaves or ends; 1: it leads into a circle (or a dead row); 2: the row lies on a circle.
    """
    n = len(ids)
    pos = {k: i for i, k in enumerate(ids)}
    up = [pos.get(p, -1) if p is not None else -1 for p in parents]
    root, dist, state = [-1] * n, [0] * n, [int(b) for b in bads]
    done = [False] * n
    for s in range(n):
        path, i, seen = [], s, set()
        while i >= 0 and not done[i] and i not in seen:
            seen.add(i)
            path.append(i)
            i = up[i]
        if i >= 0 and not done[i]:  # closed a circle at i
            k = path.index(i)
            for x in path[k:]:
                state[x], done[x] = 2, True
            path = path[:k]
        for x in reversed(path):
            p = up[x]
            if p < 0:
                root[x], dist[x] = x, 0
            else:
                root[x], dist[x] = root[p], dist[p] + lens[x]
                if state[p]:
                    state[x] = max(state[x], 1)
            done[x] = True
    return up, root, dist, state


def _names(df: DataFrame, parts: int) -> list[int]:
    """A number for each of `parts` partitions that Spark's own hash sends to just that partition."""
    named: dict[int, int] = {}
    lo, step = 0, max(64, 4 * parts)
    while len(named) < parts:
        for x, p in df.sparkSession.range(lo, lo + step).select("id", F.pmod(F.hash("id"), F.lit(parts))).collect():
            named.setdefault(p, x)
        lo += step
    return [named[p] for p in range(parts)]


def _contract(names: list[int]):
    """One partition to its fragments, which bear the partition's name."""

    def run(batches):
        from pyspark import TaskContext

        parts = [b for b in batches if len(b)]
        if parts:  # memory is one partition, which `_solve` bounds by rows
            yield _fragment(pd.concat(parts, ignore_index=True), names[TaskContext.get().partitionId()])

    return run


def _fragment(d: pd.DataFrame, frag: int) -> pd.DataFrame:
    ids, parents = d["id"].tolist(), [p if isinstance(p, str) else None for p in d["parent"]]
    lens = d["len"].tolist()
    up, root, dist, state = _chains(ids, parents, lens, d["bad"].tolist())
    r0, d0 = d["r0"].tolist(), d["d0"].tolist()
    exits, qlen, qr0, qd0 = [], [], [], []
    for i, r in enumerate(root):
        lost = state[i] or r < 0
        exits.append(None if lost else parents[r])
        qlen.append(0 if lost else dist[i] + lens[r])
        qr0.append(None if lost else r0[r])
        qd0.append(-1 if lost else dist[i] + d0[r])
    d["frag"], d["exit"], d["qlen"], d["qr0"], d["qd0"], d["bad"] = frag, exits, qlen, qr0, qd0, state
    if "lab" not in d:
        return d[["frag", *_ROW, "exit", "qlen", "qr0", "qd0"]]
    d["qlab"] = _labels(up, root, state, d["lab"].tolist())
    return d[["frag", *_ROW, "lab", "exit", "qlen", "qr0", "qd0", "qlab"]]


def _labels(up: list, root: list, state: list, labs: list) -> list:
    """Per row the labels of its chain from the local root down to it; empty where there is no root."""
    out: list = [None] * len(up)
    for s in range(len(up)):
        path, i = [], s
        while out[i] is None and not state[i] and root[i] >= 0:
            path.append(i)
            if up[i] < 0:
                break
            i = up[i]
        for x in reversed(path):
            above = out[up[x]] if up[x] >= 0 else []
            out[x] = [*(above or []), *labs[x]]
    return [x or [] for x in out]


def _expand(nodes: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """One fragment with what the quotient says of its exits and entries, to final rows."""
    if not len(nodes):
        return pd.DataFrame(_NOTHING)
    ids, lens = nodes["id"].tolist(), nodes["len"].tolist()
    parents = [p if isinstance(p, str) else None for p in nodes["parent"]]
    up, root, dist, state = _chains(ids, parents, lens, [1 if b else 0 for b in nodes["bad"]])
    state = [max(s, b) for s, b in zip(state, nodes["bad"].tolist())]
    info = {k: (r, d, t, b) for k, r, d, t, b in zip(told["id"], told["root"], told["depth"], told["total"], told["bad"])}
    total = nodes["w"].tolist()
    for i, k in enumerate(ids):
        if k in info:
            total[i] += info[k][2]
    for i in _leaves_first(up, root):
        if up[i] >= 0:
            total[up[i]] += total[i]
    r0, d0 = nodes["r0"].tolist(), nodes["d0"].tolist()
    bad, roots, depth = state[:], [], []
    for i, k in enumerate(ids):
        if k in info and info[k][3] == 2:  # an entry on a circle of the quotient: so is its chain to the exit
            j = i
            while j >= 0 and bad[j] != 2:
                bad[j] = 2
                j = up[j]
    for i in range(len(ids)):
        e = parents[root[i]] if root[i] >= 0 else None
        if bad[i] or root[i] < 0:
            roots.append(None)
            depth.append(-1)
            bad[i] = bad[i] or 1
        elif e is None or e not in info:
            roots.append(r0[root[i]])
            depth.append(dist[i] + d0[root[i]])
        elif info[e][3]:
            roots.append(None)
            depth.append(-1)
            bad[i] = 1
        else:
            roots.append(info[e][0])
            depth.append(dist[i] + lens[root[i]] + info[e][1])
    out = pd.DataFrame({"id": ids, "root": roots, "depth": depth, "total": total, "bad": bad})
    if "lab" in nodes:
        above = dict(zip(told["id"], told["path"])) if len(told) else {}
        chains = _labels(up, root, [0 if r is not None else 1 for r in roots], nodes["lab"].tolist())
        paths = []
        for i, c in enumerate(chains):
            e = parents[root[i]] if roots[i] is not None else None
            head = above.get(e) if e is not None else None
            paths.append(None if roots[i] is None else [*(head if head is not None else []), *c])
        out["path"] = paths
    return out


def _leaves_first(up: list, root: list) -> list:
    """Rows of trees, children before parents."""
    n = len(up)
    kids = [0] * n
    for i, p in enumerate(up):
        if p >= 0 and root[i] >= 0:
            kids[p] += 1
    stack = [i for i in range(n) if root[i] >= 0 and not kids[i]]
    out = []
    while stack:
        i = stack.pop()
        out.append(i)
        p = up[i]
        if p >= 0 and root[p] >= 0:
            kids[p] -= 1
            if not kids[p]:
                stack.append(p)
    return out


def _solve(df: DataFrame, rows: int, level: int, scratch: Scratch, base_rows: int) -> DataFrame:
    """df(id, parent, len, w, bad, r0, d0[, lab][, at]) with unique ids to `_OUT`; parents may be missing."""
    labelled = "lab" in df.columns
    row, kind, out = (_ROW + ["lab"], _FRAG.replace(", exit", _LAB + ", exit") + _QLAB, _OUT + _PATH) if labelled else (_ROW, _FRAG, _OUT)
    if level and rows <= base_rows:
        return df.select(*row).coalesce(1).mapInPandas(_in_one_task, out)
    parts = max(2, math.ceil(rows / base_rows))
    if level:
        hot = df.groupBy("parent").count().filter(F.col("count") > base_rows).select(F.col("parent").alias("hot"))
        df = df.join(hot, df["parent"] == hot["hot"], "left")
        heads = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == 0
        home = F.when(heads | F.col("parent").isNull() | F.col("hot").isNotNull(), F.col("id")).otherwise(F.col("parent"))
        placed = df.withColumn("home", home).repartition(parts, "home")
    else:
        parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        placed = df.repartitionByRange(parts, "at", "id")
    frags = scratch.put(placed.select(*row).mapInPandas(_contract(_names(df, parts)), kind), f"frags{level}")
    # an exit that is no node drops out here; all nodes that leave by an exit hang below it
    leaving = frags.filter("exit is not null").groupBy(F.col("exit").alias("id")).agg(F.sum("w").alias("cw"))
    named = ["id", F.col("exit").alias("parent"), F.col("qlen").alias("len"), F.col("cw").alias("w"), "bad", F.col("qr0").alias("r0"), F.col("qd0").alias("d0"), "frag"]
    quotient = scratch.put(frags.join(leaving, "id").select(*named, *([F.col("qlab").alias("lab")] * labelled)), f"quotient{level}")
    left = quotient.count()
    solved = _solve(quotient, left, level + 1, scratch, base_rows)
    if left > base_rows:
        solved = scratch.put(solved, f"solved{level}")
    asked = frags.filter("exit is not null").select("frag", F.col("exit").alias("id")).union(quotient.select("frag", "id")).distinct()
    told = asked.join(solved, "id").withColumnRenamed("frag", "told_frag")
    # a fragment's name sends it to a partition of its own, so a task holds about base_rows
    return frags.repartition(parts, "frag").groupBy("frag").cogroup(told.repartition(parts, "told_frag").groupBy("told_frag")).applyInPandas(_expand, out)


def _in_one_task(batches):
    parts = [b for b in batches if len(b)]
    if parts:
        d = pd.concat(parts, ignore_index=True)
        yield _expand(d, pd.DataFrame(_NOTHING))


def resolve(links: DataFrame, node: str, parent: str, at: str | None = None, base_rows: int = BASE_ROWS, paths: bool = False) -> DataFrame:
    """Per node: root, depth, n_below and on_cycle (0/1); see the module for the method and the defined cases.

    links: any columns besides `node` and `parent` are ignored, whatever their names. at: a column in whose order
    children follow their parents closely, used for locality only. Nodes that reach no root have root '', depth -1 and
    n_below -1. paths: add `path`, an array from the root to the node itself, null where no root is reached; it is as
    long as the depth, so ask for it only where trees are shallow enough to be written down. Shuffles: one for
    uniqueness, one by range, one to expand; the quotient's are smaller.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    nodes = (
        links.filter(F.col(node).isNotNull())
        .groupBy(F.col(node).alias("id"))
        .agg(F.min(F.col(parent)).alias("parent"), F.min(F.col(at or node)).alias("at"))
    )
    # written down, so that the rows are counted and ranged without going through the links again
    nodes = scratch.put(nodes, "nodes")
    start = {"len": F.lit(1).cast("long"), "w": F.lit(1).cast("long"), "bad": F.lit(0), "r0": F.col("id"), "d0": F.lit(0).cast("long")}
    out = _solve(nodes.withColumns(start | ({"lab": F.array("id")} if paths else {})), nodes.count(), 0, scratch, base_rows)
    return out.select(
        F.col("id").alias("node"),
        F.when(F.col("bad") == 0, F.col("root")).otherwise("").alias("root"),
        F.when(F.col("bad") == 0, F.col("depth")).otherwise(-1).cast("int").alias("depth"),
        F.when(F.col("bad") == 0, F.col("total") - 1).otherwise(-1).cast("long").alias("n_below"),
        F.when(F.col("bad") == 2, 1).otherwise(0).alias("on_cycle"),
        *([F.when(F.col("bad") == 0, F.col("path")).alias("path")] * paths),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, steps) for every node below another, from `resolve` with paths: one narrow pass, no join."""
    up = F.slice("path", 1, F.size("path") - 1)
    x = resolved.filter("depth > 0").select("node", "depth", F.posexplode(up).alias("place", "ancestor"))
    return x.select("ancestor", "node", (F.col("depth") - F.col("place")).alias("steps"))
