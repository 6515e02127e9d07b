"""Hierarchies, orphans and chunks against brute force, with the defined edge cases."""

import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.operators import hierarchy, orphans, skew


def brute(links):
    up = {}
    for n, p in links:
        if n is not None:
            up[n] = min((x for x in (up.get(n), p) if x is not None), default=None)
    up = {n: (p if p in up else None) for n, p in up.items()}
    out, below = {}, dict.fromkeys(up, 0)
    for n in up:
        path, cur = [n], up[n]
        while cur is not None and cur not in path:
            path.append(cur)
            cur = up[cur]
        if cur is None:
            out[n] = (path[-1], len(path) - 1)
            for a in path[1:]:
                below[a] += 1
        else:
            out[n] = ("", -1, int(cur == n))
    return {(n, *v[:2], below[n] if v[1] >= 0 else -1, v[2] if len(v) > 2 else 0) for n, v in out.items()}


def forest(n, seed, loops=True):
    rnd = random.Random(seed)
    links = [(f"n{i:04}", f"n{rnd.randrange(max(0, i - 8), i):04}" if i and rnd.random() < 0.93 else None) for i in range(n)]
    if loops:
        links += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("self", "self"), ("e", "nowhere"), ("x", "")]
        links[5] = (links[5][0], links[40][0])  # a long circle through many partitions
    return links + [links[3], (None, "n0001")]


def resolved(spark, links, **kw):
    df = spark.createDataFrame(links, "node string, parent string").withColumn("id", F.lit("clash")).withColumn("frag", F.lit(1))
    return {tuple(r) for r in hierarchy.resolve(df, "node", "parent", **kw).select("node", "root", "depth", "n_below", "on_cycle").collect()}


def test_hierarchy_one_task(spark):
    links = forest(300, 1)
    assert resolved(spark, links) == brute(links)


def test_hierarchy_recursion(spark):
    links = forest(240, 2)
    assert resolved(spark, links, base_rows=40) == brute(links)


def test_hierarchy_hot_parent_and_chain(spark):
    links = [("hub", None), *((f"k{i}", "hub") for i in range(150)), *((f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(120)), *((f"l{i}", f"k{i}") for i in range(150))]
    assert resolved(spark, links, base_rows=50) == brute(links)


def test_hierarchy_empty(spark):
    assert resolved(spark, []) == {(None, None, None, None, None)} - {(None, None, None, None, None)}


def brute_paths(links):
    """Node to its path, root first; None without a root."""
    up = {}
    for n, p in links:
        if n is not None:
            up[n] = min((x for x in (up.get(n), p) if x is not None), default=None)
    up = {n: (p if p in up else None) for n, p in up.items()}
    out = {}
    for n in up:
        path, cur = [n], up[n]
        while cur is not None and cur not in path:
            path.append(cur)
            cur = up[cur]
        out[n] = None if cur is not None else path[::-1]
    return out


def test_paths_and_descendants(spark):
    for links, rows in ((forest(240, 3), 40), (forest(120, 4), 1000), ([("a", None), ("b", "a"), ("c", "b"), ("o", "o")], 10)):
        df = spark.createDataFrame(links, "node string, parent string")
        got = hierarchy.resolve(df, "node", "parent", base_rows=rows, paths=True)
        want = brute_paths(links)
        assert {r["node"]: r["path"] for r in got.collect()} == want
        below = {(a, n, len(p) - 1 - i) for n, p in want.items() if p for i, a in enumerate(p[:-1])}
        assert {tuple(r) for r in hierarchy.descendants(got).collect()} == below
    none = spark.createDataFrame([], "node string, parent string")
    assert hierarchy.descendants(hierarchy.resolve(none, "node", "parent", paths=True)).count() == 0


def test_hierarchy_bounds_every_level(spark, monkeypatch):
    """At level 0 as well no fragment holds much more than base_rows."""
    made = []
    put = hierarchy.Scratch.put
    monkeypatch.setattr(hierarchy.Scratch, "put", lambda self, df, name: (made.append((name, out := put(self, df, name))), out)[1])
    links = forest(900, 5)
    assert resolved(spark, links, base_rows=60) == brute(links)
    sizes = [r[0] for name, t in made if name == "frags0" for r in t.groupBy("frag").count().select("count").collect()]
    assert len(sizes) >= 900 // 60 and max(sizes) <= 120


def chunks(spark, rows, chunk):
    df = spark.createDataFrame(rows, "k string, m string, o double, part string")
    return {tuple(r) for r in skew.distinct_and_first(df, F.col("k"), F.col("m"), F.col("o"), chunk).collect()}


def brute_chunks(rows):
    out = {}
    for k, m, o, _ in rows:
        if k is not None and m is not None:
            out.setdefault(k, []).append((o is None or o != o, o if o is not None and o == o else 0.0, m))
    return {(k, len({x[2] for x in v}), min(v)[2]) for k, v in out.items()}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 50]))
def test_chunks(spark, seed, chunk):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *(f"m{i}" for i in range(25))]), rnd.choice([None, float("nan"), 1.0, 2.0, rnd.random()]), "x") for _ in range(160)]
    assert chunks(spark, rows, chunk) == brute_chunks(rows)


def test_chunks_empty(spark):
    assert chunks(spark, [], 5) == set()


REFS = "src string, period string, row_key string, kind string, key string, own_at double"


def ledger(spark, steps, keep=True, folder=None):
    x = orphans.OrphanLedger(spark, keep, folder)
    for refs, parents, gone in steps:
        x.advance(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, "kind string, key string, at double"), spark.createDataFrame(gone, "kind string, key string, at double"))
        x.snapshot()
    return x


def why(x):
    return {(r["row_key"], r["why"]) for r in x.report().collect()}


def test_orphans_wait_resolve_and_stay_late(spark):
    r = lambda n, k, t: ("s", "p", n, "t", k, t)
    one = ([r("1", "a", 5.0), r("2", "b", 5.0), r("3", "c", None), r("4", None, 1.0), r("1", "a", 5.0)], [("t", "a", 1.0)], [])
    two = ([r("5", "d", 9.0)], [("t", "b", 7.0), ("t", "c", 8.0), ("t", None, 1.0)], [("t", "d", None), ("t", None, 2.0)])
    x = ledger(spark, [one, two])
    assert why(x) == {("2", "late"), ("5", "deleted")}
    assert {(q["step"], q["why"], q["n"]) for q in x.history().collect()} == {(1, "missing", 2), (2, "late", 1), (2, "deleted", 1)}


def test_orphans_reopen_and_recreate(spark):
    ref = ([("s", "p", "1", "t", "a", 5.0)], [("t", "a", 1.0)], [])
    gone, back = ([], [], [("t", "a", 10.0)]), ([], [("t", "a", 20.0)], [])
    assert why(ledger(spark, [ref], False)) == set()
    assert why(ledger(spark, [ref, gone], False)) == {("1", "deleted")}
    assert why(ledger(spark, [ref, gone, back], False)) == set()
    assert why(ledger(spark, [ref, back, gone], False)) == set()  # times decide, not the order of increments
    assert why(ledger(spark, [ref, gone], True)) == set()


def test_orphans_go_on_in_another_session(spark, tmp_path):
    """The state is opened again by its folder, and equals the one built at once; runs are merged on the way."""
    rnd = random.Random(8)
    steps = []
    for n in range(9):
        refs = [("s", "p", f"{n}-{i}", "t", f"k{rnd.randrange(40)}", rnd.choice([None, float(rnd.randrange(90))])) for i in range(12)]
        steps.append((refs, [("t", f"k{rnd.randrange(40)}", float(rnd.randrange(90))) for _ in range(4)], [("t", f"k{rnd.randrange(40)}", float(rnd.randrange(90)))]))
    folder = str(tmp_path / "state")
    ledger(spark, steps[:5], False, folder)
    later = ledger(spark.newSession(), steps[5:], False, folder)
    assert max(r["level"] for r in later.index.runs) > 0 and len(later.index.runs) < 9
    arrived, gone = {}, {}
    for _, ps, gs in steps:
        for _, k, t in ps:
            arrived.setdefault(k, []).append(t)
        for _, k, t in gs:
            gone.setdefault(k, []).append(t)
    want = set()
    for refs, _, _ in steps:
        for _, _, row, _, k, t in refs:
            there = k in arrived and (k not in gone or max(gone[k]) <= max(arrived[k]))
            if not there:
                want.add((row, "deleted" if k in gone else "missing"))
            elif t is not None and min(arrived[k]) > t:
                want.add((row, "late"))
    assert why(later) == want


def test_orphans_empty(spark):
    assert why(ledger(spark, [([], [], []), ([], [], [])])) == set()
