"""The task ledger: states, claims, leases, retries, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CLAIMABLE, IN_FLIGHT, TERMINAL = ("pending", "retry"), ("leased", "running"), ("done", "dead", "policy_denied")
MAX_ATTEMPTS = 3


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """JOIN-09: the last version of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def enqueue(stored: DataFrame, new: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """JOIN-08, STM-06: new tasks whose key is not stored, one a key."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def state_counts(tasks: DataFrame) -> DataFrame:
    """AGG-01, AGG-02."""
    return tasks.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("state").isin(*CLAIMABLE)).alias("claimable"), F.count_if(F.col("state").isin(*IN_FLIGHT)).alias("in_flight"))


def ledger_counts(tasks: DataFrame) -> DataFrame:
    """AGG-03: the five ledger states, zero where none."""
    s = F.col("state")
    return tasks.agg(F.count_if(s == "done").alias("new"), F.lit(0).cast("long").alias("unchanged"), F.lit(0).cast("long").alias("updated"), F.count_if(s == "policy_denied").alias("policy_denied"), F.count_if(s == "dead").alias("failed"))


def expired(now: float) -> Column:
    """FLT-02: in flight with a lease that has run out."""
    return F.col("state").isin(*IN_FLIGHT) & (F.coalesce(F.nanvl(F.col("lease_expires"), F.lit(0.0)), F.lit(0.0)) < now)


def max_attempts() -> Column:
    """Attempts the budget allows; 3 where it does not say or parse."""
    return F.coalesce(F.try_variant_get(F.try_parse_json("budget_json"), "$.max_attempts", "long"), F.lit(MAX_ATTEMPTS).cast("long"))


def recover(tasks: DataFrame, now: float) -> DataFrame:
    """STM-05: expired leases go back to retry, or to dead once their attempts are used up."""
    dead = F.col("attempts") + 1 >= max_attempts()
    out = expired(now)
    return tasks.withColumns({"state": F.when(out, F.when(dead, "dead").otherwise("retry")).otherwise(F.col("state")), "attempts": F.col("attempts") + F.when(out, 1).otherwise(0)})


def claim(tasks: DataFrame, n: int, now: float | None = None) -> DataFrame:
    """TOP-01: the first n claimable tasks by updated_at, then task_id; with `now`, expired leases are recovered first."""
    t = tasks if now is None else recover(tasks, now)
    return t.filter(F.col("state").isin(*CLAIMABLE)).orderBy("updated_at", "task_id").limit(n)


def expired_count(tasks: DataFrame, now: float) -> DataFrame:
    """AGG-20."""
    return tasks.agg(F.count_if(expired(now)).alias("expired"))


def capacity(tasks: DataFrame, most: int) -> DataFrame:
    """AGG-18, STM-07: depth of the queue, whether it takes another task, and why not."""
    x = tasks.agg(F.count_if(F.col("state").isin(*CLAIMABLE)).alias("depth"))
    return x.select("depth", (F.col("depth") < most).alias("accepts"), F.when(F.col("depth") < most, "").otherwise("full").alias("reason"))


def requeue(tasks: DataFrame, most: int = 5) -> DataFrame:
    """STM-04: what a requeue of each task does: refused with a reason, or pending with one attempt more."""
    why = F.when(F.col("state").isin(*IN_FLIGHT), "in_flight").when(F.col("attempts") >= most, "attempts")
    return tasks.select("task_id", why.isNull().alias("ok"), F.coalesce(why, F.lit("")).alias("reason"), F.when(why.isNull(), "pending").otherwise(F.col("state")).alias("state"), (F.col("attempts") + F.when(why.isNull(), 1).otherwise(0)).alias("attempts"))


def exhausted(limits: dict[str, float]) -> Column:
    """FLT-03: the first budget used up, in the order attempts, transitions, seconds, bytes, throttles; null if none."""
    names = {"attempts": "attempts", "transitions": "transitions", "seconds": "seconds_done", "bytes": "bytes_done", "throttles": "throttles"}
    out = None
    for name, col in names.items():
        if name in limits:
            hit = F.col(col) >= limits[name]
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def after_failure(signal: Column) -> tuple[Column, Column, Column]:
    """Failure accounting: (attempts, throttles, state) after a failure of this kind."""
    throttled, denied = signal == "throttled", signal == "policy_denied"
    attempts = F.col("attempts") + F.when(throttled | denied, 0).otherwise(1)
    throttles = F.col("throttles") + F.when(throttled, 1).otherwise(0)
    state = F.when(denied, "policy_denied").when(~throttled & (attempts >= max_attempts()), "dead").otherwise("retry")
    return attempts, throttles, state


def overview(tasks: DataFrame, evidence: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """TOP-02, JOIN-07: newest tasks with the number of their evidence rows. The page of tasks is cut first."""
    page = tasks.orderBy(F.col("updated_at").desc(), "task_id").offset(offset).limit(max(1, min(5000, limit)))
    n = evidence.groupBy("task_id").agg(F.count("*").alias("n_evidence"))
    return page.join(n, "task_id", "left").select("task_id", "state", "updated_at", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def lineage(tasks: DataFrame, evidence: DataFrame, artifacts: DataFrame, pages: DataFrame) -> DataFrame:
    """JOIN-03, JOIN-05: per task the counts of its evidence, artifacts, pages and children. Each side is counted by
    key before it is joined, so a task with very many rows costs one row."""
    out = tasks.select("task_id", "idempotency_key", "state")
    sides = {
        "n_evidence": evidence.groupBy("task_id").agg(F.count("*").alias("n_evidence")),
        "n_artifacts": artifacts.groupBy(F.col("parent_task").alias("task_id")).agg(F.count("*").alias("n_artifacts")),
        "n_children": tasks.groupBy(F.col("parent_id").alias("task_id")).agg(F.count("*").alias("n_children")),
    }
    for name, s in sides.items():
        out = out.join(s, "task_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    p = pages.groupBy(F.col("url_hash").alias("idempotency_key")).agg(F.count("*").alias("n_pages"))
    return out.join(p, "idempotency_key", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))


def last_decision(evidence: DataFrame) -> DataFrame:
    """WIN-05, WIN-06: per task the last signal and the last decision that is not empty."""
    d = F.when(F.coalesce(F.col("decision"), F.lit("")) != "", F.struct("id", "decision", "reason"))
    return evidence.groupBy("task_id").agg(F.max_by("signal", "id").alias("signal"), F.max(d).alias("d")).select("task_id", "signal", F.col("d.decision").alias("decision"), F.col("d.reason").alias("reason"))


def ledger_summary(counts: DataFrame) -> DataFrame:
    """AGG-04: the five counts with total and changed."""
    five = ["new", "unchanged", "updated", "policy_denied", "failed"]
    total = sum((F.col(c) for c in five[1:]), F.col(five[0]))
    return counts.select(*five, total.alias("total"), (F.col("new") + F.col("updated")).alias("changed"))


def ledger_events(events: DataFrame, state: str | None = None, limit: int = 100, kept: int | None = None) -> DataFrame:
    """AGG-05: the last `limit` events(at, state, url) of a state (None: any), newest first; `kept`: only among the oldest so
    many (None: all)."""
    x = events if kept is None else events.orderBy("at", "url").limit(kept)
    if state is not None:
        x = x.filter(F.col("state") == state)
    return x.orderBy(F.col("at").desc(), "url").limit(limit)


def dead_letters_of(letters: DataFrame, tasks: DataFrame, n: int = 5) -> DataFrame:
    """JOIN-06, WIN-07: the newest n letters(at, label, error) whose label holds a task's id. Ids are cut out of the labels
    as runs of letters and digits, so the join is by key."""
    words = F.array_distinct(F.regexp_extract_all("label", F.lit("[A-Za-z0-9]+"), F.lit(0)))
    x = letters.select("at", "label", "error", F.explode(words).alias("task_id")).join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    w = Window.partitionBy("task_id").orderBy(F.col("at").desc(), "label", "error")
    return x.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def forget(tasks: DataFrame, evidence: DataFrame, errors: DataFrame, ids: DataFrame) -> DataFrame:
    """AGG-19, SUP-31: what forgetting the tasks `ids` would delete: tasks, evidence, errors, and those skipped in flight."""
    t = tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi")
    gone = t.filter(~F.col("state").isin(*IN_FLIGHT)).select("task_id")
    a = t.agg(F.count_if(~F.col("state").isin(*IN_FLIGHT)).alias("tasks"), F.count_if(F.col("state").isin(*IN_FLIGHT)).alias("skipped"))
    b = evidence.join(gone, "task_id", "left_semi").agg(F.count("*").alias("evidence"))
    c = errors.join(gone, "task_id", "left_semi").agg(F.count("*").alias("errors"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """SUP-31: rows of a table by task_id without those of the ids."""
    return rows.join(ids.select("task_id").distinct(), "task_id", "left_anti")


def evidence_of_parse(parsed: Column, most: int = 300) -> Column:
    """SUP-01: struct(signal, decision, reason) of a parse result with ok and error."""
    return F.when(parsed["ok"], F.struct(F.lit("ok").alias("signal"), F.lit("capture").alias("decision"), F.lit("").alias("reason"))).otherwise(F.struct(F.lit("parser_failed").alias("signal"), F.lit("keep_raw").alias("decision"), F.substring(F.coalesce(parsed["error"], F.lit("")), 1, most).alias("reason")))


EVIDENCE = "struct<signal: string, decision: string, reason: string, stage: string, facts: map<string,string>, at: double>"


def evidence_json(evidence: Column) -> Column:
    """SUP-02: evidence as JSON text; `F.from_json` with EVIDENCE brings it back."""
    return F.to_json(evidence)


def add_evidence(rows: DataFrame, items: str) -> DataFrame:
    """SUP-03: rows(task_id, items) with an array of evidence structs to one row an item, in order; null arrays give none."""
    return rows.select("task_id", F.posexplode(items).alias("place", "e")).select("task_id", "place", "e.*")


def export(kind: str, rows: DataFrame) -> DataFrame:
    """SRC-16: rows as JSON text with their kind, ready for a text sink."""
    return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), *rows.columns)).alias("line"))


def explained(tasks: DataFrame, last: DataFrame) -> DataFrame:
    """STR-19: one line a task for people: id, state, what was last decided and why, attempts."""
    x = tasks.join(last.select(F.col("task_id").alias("_t"), "decision", "reason"), F.col("task_id") == F.col("_t"), "left")
    why = F.when(F.coalesce("decision", F.lit("")) != "", F.concat(F.lit(": "), "decision", F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" ("), "reason", F.lit(")"))).otherwise(""))).otherwise("")
    return x.select("task_id", F.concat("task_id", F.lit(" "), "state", why, F.lit(", attempts "), F.coalesce("attempts", F.lit(0)).cast("string")).alias("line"))


#: Budgets by name.
BUDGETS = {"default": {"max_attempts": 3, "max_transitions": 8}, "small": {"max_attempts": 2, "max_transitions": 4}, "media": {"max_attempts": 5, "max_transitions": 12}}


def constructed(targets: DataFrame, kind: str, target: str, budget: str = "default") -> DataFrame:
    """SUP-05: new pending tasks of a kind for targets; `derive` needs no network. Null targets give none."""
    b = F.to_json(F.create_map(*[F.lit(x) for kv in BUDGETS[budget].items() for x in kv]))
    key = F.substring(F.sha2(F.concat(F.lit(kind + "|"), F.col(target)), 256), 1, 32)
    resources = F.lit("{}" if kind == "derive" else '{"network":1}')
    return targets.filter(F.col(target).isNotNull()).select(F.lit(kind).alias("kind"), F.col(target).alias("target"), key.alias("idempotency_key"), resources.alias("resources_json"), b.alias("budget_json"), F.lit("pending").alias("state"), F.lit(0).cast("long").alias("attempts"))


TASK = "struct<task_id: string, kind: string, target: string, state: string, attempts: bigint, policy: map<string,string>, budget: map<string,string>, evidence: array<struct<signal: string, at: double>>>"


def serialized(tasks: DataFrame) -> DataFrame:
    """SUP-04: (task_id, row), the task with its policy and budget as one JSON text; broken JSON in them becomes null."""
    as_map = lambda c: F.from_json(c, "map<string,string>")
    none = F.array().cast("array<struct<signal: string, at: double>>")
    return tasks.select("task_id", F.to_json(F.struct("task_id", "kind", "target", "state", "attempts", as_map("policy_json").alias("policy"), as_map("budget_json").alias("budget"), none.alias("evidence"))).alias("row"))


def deserialized(rows: DataFrame, row: str) -> DataFrame:
    """SUP-04: the task of each JSON text."""
    return rows.select(F.from_json(row, TASK).alias("t")).select("t.*")


def with_state(tasks: DataFrame, state: Column, signal: Column, at: Column) -> DataFrame:
    """SUP-04: tasks in a new state, with one more entry in their evidence."""
    return tasks.withColumns({"state": state, "evidence": F.array_append("evidence", F.struct(signal.alias("signal"), at.alias("at")))})


def bumped(counts: DataFrame, state: str, n: int = 1) -> DataFrame:
    """SUP-18: a one-row ledger with one of its counts raised."""
    return counts.withColumn(state, F.col(state) + n)


def problems(wanted: Column, capacities: dict[str, int], tiers: tuple[str, ...] = (), tier: Column | None = None) -> Column:
    """FLT-09: what is wrong with a request (map of resource to number): unknown, no capacity, over capacity, bad tier."""
    have = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv]) if capacities else F.create_map().cast("map<string,int>")

    def one(e: Column) -> Column:
        c = have[e["key"]]
        why = F.when(c.isNull(), "unknown").when(c <= 0, "no_capacity").when(e["value"] > c, "over_capacity")
        return F.when(why.isNotNull(), F.concat(e["key"], F.lit(":"), why))

    out = F.array_compact(F.transform(F.array_sort(F.map_entries(wanted)), one))
    return out if tier is None else F.concat(out, F.when(tier.isin(*tiers), F.array().cast("array<string>")).otherwise(F.array(F.lit("tier:bad"))))


def plan_memory(plan: DataFrame, budget: float) -> DataFrame:
    """FLT-15, SUP-06: plan(name, size, peak_mb): memory in all, whether the budget holds it, and how many rows are wrong
    (a size below 1 or a null)."""
    bad = F.coalesce(F.col("size"), F.lit(0)) < 1
    return plan.agg(F.coalesce(F.sum(F.when(~bad, F.col("size") * F.col("peak_mb"))), F.lit(0.0)).cast("double").alias("mb"), F.count_if(bad).alias("wrong")).withColumn("fits", (F.col("mb") <= budget) & (F.col("wrong") == 0))


def resting(limits: DataFrame, now: float, most: int | None = None) -> DataFrame:
    """SUP-14: limits(domain, throttles, until, used_at) with `resting`; beyond `most` domains the oldest eighth of those
    that do not rest is dropped."""
    x = limits.withColumn("resting", F.coalesce(F.col("until") > now, F.lit(False)))
    if most is None or (n := x.count()) <= most:
        return x
    old = x.filter("not resting").orderBy("used_at", "domain").limit(max(1, n // 8)).select("domain")
    return x.join(old, "domain", "left_anti")
