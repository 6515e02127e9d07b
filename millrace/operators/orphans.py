"""References to records that do not exist, kept as incremental keyed state.

The state is three tables of append-only runs (`runs`), each opened again by its folder:

* the parent index: per kind and key the earliest and the latest arrival and the latest deletion,
* the open references: those whose target is missing, deleted or came later than they did, as changes; the last counts,
* the log of all references, kept only where deletions can reopen what was resolved.

An increment brings new references, parents and deletions. Parents and deletions are added to the index as one run. New
references probe the index for their own keys. Open references whose key the increment touches are judged again, so a
parent that arrives resolves them; a deletion judges the logged references of its key again and reopens them. Only what
changed is added to the open table: no state is rewritten but by the levelled merging of runs. Times decide, not the
order of increments, so increments may overlap or come late.

References never gather in one group by key: they only join index rows that are unique by key, so a hot key costs one
probe a row (AQE splits the join).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import Scratch
from .runs import Runs

INDEX = "kind string, key string, first_at double, last_at double, gone_at double"
REF = ["src", "period", "row_key", "kind", "key", "own_at"]
REFS = "src string, period string, row_key string, kind string, key string, own_at double"


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "key").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("gone_at").alias("gone_at"))


def _last_change(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*REF).agg(F.max_by("why", "step").alias("why"), F.max("step").alias("step"))


class OrphanLedger:
    """refs: REF. parents: kind, key, at. deletions: kind, key, at. folder: of the state, by default one for this object.

    Rows with a null key are no references and left out. A reference without a time is never late. Repeated rows count
    once in `report`. A deletion or arrival without a time counts as the earliest. keep_present: a deletion never hides
    a parent that the parents' table has; without it, a deletion hides a parent unless it arrived anew at that time or
    later. A key that waits twice, or rows of an empty increment, are fine.
    """

    def __init__(self, spark, keep_present: bool = True, folder: str | None = None):
        self.spark, self.keep = spark, keep_present
        self.scratch = Scratch(spark, "orphans")
        folder = folder or self.scratch.path("state")
        self.index = Runs(spark, f"{folder}/index", INDEX, ["kind", "key"], _by_key)
        self.open = Runs(spark, f"{folder}/open", f"{REFS}, why string, step int", ["kind", "key"], _last_change)
        self.log = Runs(spark, f"{folder}/log", REFS, ["kind", "key"], DataFrame.distinct)
        self.steps = max((r["step"] for r in self.open.raw().agg(F.max("step").alias("step")).collect() if r["step"]), default=0)
        self.snapshots: list[DataFrame] = []

    def _judge(self, refs: DataFrame) -> DataFrame:
        """refs with their present state in `why`; null: resolved."""
        keys = self.scratch.put(refs.select("kind", "key").distinct(), "asked")
        known = _by_key(self.index.asked(keys)).withColumnsRenamed({"kind": "ikind", "key": "ikey"})
        x = refs.join(known, (F.col("kind") == F.col("ikind")) & (F.col("key") == F.col("ikey")), "left")
        there = F.col("last_at").isNotNull()
        if not self.keep:
            there = there & (F.col("gone_at").isNull() | (F.col("gone_at") <= F.col("last_at")))
        why = F.when(there, F.when(F.col("first_at") > F.col("own_at"), "late")).when(F.col("gone_at").isNotNull(), "deleted").otherwise("missing")
        return x.select(*refs.columns, why.alias("now"))

    def advance(self, refs: DataFrame, parents: DataFrame, deletions: DataFrame) -> None:
        """Take in one increment."""
        s, never = self.scratch, F.lit(float("-inf"))
        t, none = F.coalesce("at", never), F.lit(None).cast("double")
        came = parents.filter("key is not null").select("kind", "key", F.col("at").alias("first_at"), t.alias("last_at"), none.alias("gone_at"))
        gone = deletions.filter("key is not null").select("kind", "key", none.alias("first_at"), none.alias("last_at"), t.alias("gone_at"))
        delta = self.index.append(_by_key(came.unionByName(gone)))
        touched = delta.select("kind", "key")
        self.steps += 1
        fresh = refs.filter("key is not null").select(*REF).distinct()
        fresh = s.put(fresh, "fresh") if self.keep else self.log.append(fresh)
        changed = [self._judge(fresh).filter("now is not null").select(*REF, "now")]
        if self.open.runs:
            waiting = _last_change(self.open.asked(s.put(touched, "touched"))).filter("why is not null")
            again = self._judge(waiting.select(*REF, "why"))
            changed.append(again.filter("not (now <=> why)").select(*REF, "now"))
        if not self.keep:
            hit = s.put(delta.filter("gone_at is not null").select("kind", "key"), "hit")
            changed.append(self._judge(self.log.asked(hit).distinct()).filter("now is not null").select(*REF, "now"))
        rows = reduce(DataFrame.unionByName, changed).distinct().withColumnsRenamed({"now": "why"}).withColumn("step", F.lit(self.steps))
        self.open.append(rows)
        for t in (self.index, self.open, self.log):
            t.compact()

    def report(self) -> DataFrame:
        """Every open reference: src, period, row_key, key, why."""
        return self.open.read().filter("why is not null").select("src", "period", "row_key", "key", "why").distinct()

    def counts(self) -> DataFrame:
        """Open references now, by src, period and why."""
        return self.open.read().filter("why is not null").groupBy("src", "period", "why").agg(F.count("*").alias("n"))

    def snapshot(self) -> None:
        """Write the present counts down."""
        self.snapshots.append(self.scratch.put(self.counts().withColumn("step", F.lit(self.steps)), "snapshot"))

    def history(self) -> DataFrame:
        """The counts of all snapshots, with their step."""
        return reduce(DataFrame.unionByName, self.snapshots)


def time_slices(lo: float | None, hi: float | None, n: int) -> list[tuple[float | None, float | None]]:
    """n half-open slices of [lo, hi]; the outer ones are open-ended."""
    if lo is None or hi is None or hi <= lo or n < 2:
        return [(None, None)]
    step = (hi - lo) / n
    cuts = [lo + step * i for i in range(1, n)]
    return list(zip([None, *cuts], [*cuts, None]))


def in_slice(t: Column, part: tuple[float | None, float | None]) -> Column:
    """Rows of a slice, as comparisons that reach the scan; rows without a time are in the first."""
    lo, hi = part
    if lo is None:
        return F.lit(True) if hi is None else t.isNull() | (t < hi)
    return t >= lo if hi is None else (t >= lo) & (t < hi)
