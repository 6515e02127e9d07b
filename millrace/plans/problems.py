"""The core problems' queries over the capture tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import host, month, ref
from ..operators import hierarchy, orphans, skew
from ..runtime import table


def frontier_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frontier").select(F.concat(F.lit("f"), "url_hash").alias("node"), F.concat(F.lit("f"), ref("parent_hash")).alias("parent"), F.col("created_at").alias("at"))


def task_links(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks").select(F.concat(F.lit("t"), "task_id").alias("node"), F.concat(F.lit("t"), ref("parent_id")).alias("parent"), F.col("created_at").alias("at"))
    arts = table(spark, d, "raw_artifacts").filter(ref("parent_task").isNotNull())
    return tasks.unionByName(arts.select(F.concat(F.lit("t"), "sha256").alias("node"), F.concat(F.lit("t"), ref("parent_task")).alias("parent"), F.col("fetched_at").alias("at")))


def _both_trees(spark: SparkSession, d: str) -> DataFrame:
    """Both trees' links in one table: a letter before each key keeps them apart and names the tree."""
    return frontier_links(spark, d).unionByName(task_links(spark, d))


def _tree() -> Column:
    return F.when(F.col("node").startswith("f"), "frontier").otherwise("task").alias("tree")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.resolve(_both_trees(spark, d), "node", "parent", "at")
    return out.select(_tree(), F.expr("substring(node, 2)").alias("node"), F.expr("substring(root, 2)").alias("root"), "depth", "n_below", "on_cycle")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every node of both trees, as text, root first; null where no root is reached."""
    out = hierarchy.resolve(_both_trees(spark, d), "node", "parent", "at", paths=True)
    return out.select(_tree(), F.expr("substring(node, 2)").alias("node"), F.array_join(F.transform("path", lambda x: F.substring(x, 2, 1 << 20)), "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node of both trees with every node below it and the steps between them."""
    out = hierarchy.descendants(hierarchy.resolve(_both_trees(spark, d), "node", "parent", "at", paths=True))
    return out.select(_tree(), F.expr("substring(ancestor, 2)").alias("ancestor"), F.expr("substring(node, 2)").alias("node"), "steps")


def _references(spark: SparkSession, d: str) -> DataFrame:
    def refs(t: str, row: str, kind: str, col: str, at: str) -> DataFrame:
        return table(spark, d, t).select(F.lit(t).alias("src"), month(at).alias("period"), F.col(row).cast("string").alias("row_key"), F.lit(kind).alias("kind"), ref(col).alias("key"), F.col(at).alias("own_at"))

    return refs("raw_artifacts", "sha256", "task", "parent_task", "fetched_at").unionByName(refs("task_evidence", "id", "task", "task_id", "at")).unionByName(refs("pages", "url_hash", "artifact", "source_sha256", "fetched_at"))


def orphan_ledger(spark: SparkSession, d: str, steps: int = 4, keep: bool = True, snapshots: bool = False) -> orphans.OrphanLedger:
    """The ledger after taking in all tables in `steps` increments by time."""
    refs = _references(spark, d)
    parents = table(spark, d, "tasks").select(F.lit("task").alias("kind"), ref("task_id").alias("key"), F.col("created_at").alias("at")).unionByName(
        table(spark, d, "raw_artifacts").select(F.lit("artifact").alias("kind"), ref("sha256").alias("key"), F.col("fetched_at").alias("at"))
    )
    gone = table(spark, d, "deleted_tasks").select(F.lit("task").alias("kind"), ref("task_id").alias("key"), F.col("deleted_at").alias("at"))
    lo, hi = parents.agg(F.min("at"), F.max("at")).first()
    ledger = orphans.OrphanLedger(spark, keep)
    for part in orphans.time_slices(lo, hi, steps):
        ledger.advance(refs.filter(orphans.in_slice(F.col("own_at"), part)), parents.filter(orphans.in_slice(F.col("at"), part)), gone.filter(orphans.in_slice(F.col("at"), part)))
        if snapshots:
            ledger.snapshot()
    return ledger


_FOUND = {"src": "src_table", "key": "ref_key"}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_ledger(spark, d).report().withColumnsRenamed(_FOUND).select("src_table", "period", "row_key", "ref_key", "why")


def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Open references in the end, by table, month and cause."""
    return orphan_ledger(spark, d).counts().withColumnsRenamed(_FOUND)


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """The same counts after each of four increments by time."""
    return orphan_ledger(spark, d, snapshots=True).history().withColumnsRenamed(_FOUND)


def p4_reopened(spark: SparkSession, d: str) -> DataFrame:
    """Open references where a deletion hides a task until it is created anew: deletions reopen what was resolved."""
    return orphan_ledger(spark, d, keep=False).report().withColumnsRenamed(_FOUND).select("src_table", "period", "row_key", "ref_key", "why")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = skew.distinct_and_first(table(spark, d, "frontier"), host("domain"), F.col("url_hash"), F.col("created_at"))
    return out.select(F.col("k").alias("domain"), F.col("n").alias("n_urls"), F.col("first").alias("first_hash"))


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p4_found": p4_found, "p4_by_month": p4_by_month, "p4_history": p4_history, "p4_reopened": p4_reopened, "p6_found": p6_found}

_REF = "CASE WHEN lower(trim({0})) NOT IN ('', '-') THEN lower(trim({0})) END"
_LINKS = f"""
nodes AS (
  SELECT 'frontier' AS tree, url_hash AS node, min({_REF.format('parent_hash')}) AS up FROM frontier GROUP BY url_hash
  UNION ALL
  SELECT 'task', node, min(up) FROM (
    SELECT task_id AS node, {_REF.format('parent_id')} AS up FROM tasks
    UNION ALL SELECT sha256, {_REF.format('parent_task')} FROM raw_artifacts WHERE {_REF.format('parent_task')} IS NOT NULL) GROUP BY node),
links AS (SELECT n.tree, n.node, p.node AS up FROM nodes n LEFT JOIN nodes p ON p.tree = n.tree AND p.node = n.up)"""
_EVENTS = f"""
refs AS (
  SELECT 'raw_artifacts' AS src_table, sha256 AS row_key, 'task' AS kind, {_REF.format('parent_task')} AS ref_key, fetched_at AS own FROM raw_artifacts
  UNION ALL SELECT 'task_evidence', CAST(id AS VARCHAR), 'task', {_REF.format('task_id')}, "at" FROM task_evidence
  UNION ALL SELECT 'pages', url_hash, 'artifact', {_REF.format('source_sha256')}, fetched_at FROM pages),
targets AS (
  SELECT 'task' AS kind, {_REF.format('task_id')} AS key, created_at AS t FROM tasks
  UNION ALL SELECT 'artifact', {_REF.format('sha256')}, fetched_at FROM raw_artifacts),
gone AS (SELECT 'task' AS kind, {_REF.format('task_id')} AS key, deleted_at AS t FROM deleted_tasks)"""


def _judged(there: str, cut: str = "", when: str = "NULL") -> str:
    """The references judged by all events, or by those before a time `cut`."""
    before = f" AND coalesce({{0}}, -1e308) < {cut}" if cut else ""
    return f"""(SELECT DISTINCT r.src_table, coalesce(strftime(make_timestamp(CAST(floor(r.own) AS BIGINT) * 1000000), '%Y-%m'), '') AS period, r.row_key, r.ref_key, r.own, {when} AS step,
    CASE WHEN {there} THEN CASE WHEN t.first_at > r.own THEN 'late' END WHEN g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS why
  FROM refs r LEFT JOIN (SELECT kind, key, min(t) AS first_at, max(coalesce(t, -1e308)) AS last_at FROM targets WHERE true{before.format('t')} GROUP BY 1, 2) t ON t.kind = r.kind AND t.key = r.ref_key
  LEFT JOIN (SELECT kind, key, max(coalesce(t, -1e308)) AS gone_at FROM gone WHERE true{before.format('t')} GROUP BY 1, 2) g ON g.kind = r.kind AND g.key = r.ref_key
  WHERE r.ref_key IS NOT NULL{before.format('r.own')})"""


_THERE = "t.key IS NOT NULL"
_SPAN = "(SELECT min(t) FROM targets)", "(SELECT max(t) FROM targets)"
_CUTS = [f"({_SPAN[0]} + ({_SPAN[1]} - {_SPAN[0]}) / 4 * {k})" for k in (1, 2, 3)] + ["1e308"]

SQL = {
    "p2_found": f"""WITH RECURSIVE {_LINKS},
walk AS (
  SELECT tree, node, node AS root, 0 AS depth, [node] AS path FROM links WHERE up IS NULL
  UNION ALL SELECT l.tree, l.node, w.root, w.depth + 1, list_append(w.path, l.node) FROM walk w JOIN links l ON l.tree = w.tree AND l.up = w.node),
below AS (SELECT tree, a AS node, count(*) - 1 AS n FROM (SELECT tree, unnest(path) AS a FROM walk) GROUP BY 1, 2),
lost AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.tree = l.tree AND w.node = l.node)),
ring AS (
  SELECT tree, node AS start, up AS cur FROM lost
  UNION SELECT r.tree, r.start, l.up FROM ring r JOIN lost l ON l.tree = r.tree AND l.node = r.cur)
SELECT w.tree, w.node, w.root, w.depth, b.n AS n_below, 0 AS on_cycle FROM walk w JOIN below b ON b.tree = w.tree AND b.node = w.node
UNION ALL
SELECT tree, node, '', -1, -1, CAST(EXISTS (SELECT 1 FROM ring r WHERE r.tree = lost.tree AND r.start = lost.node AND r.cur = lost.node) AS INTEGER) FROM lost""",
    "p2_paths": f"""WITH RECURSIVE {_LINKS},
walk AS (
  SELECT tree, node, node AS path FROM links WHERE up IS NULL
  UNION ALL SELECT l.tree, l.node, w.path || '/' || l.node FROM walk w JOIN links l ON l.tree = w.tree AND l.up = w.node)
SELECT l.tree, l.node, w.path FROM links l LEFT JOIN walk w ON w.tree = l.tree AND w.node = l.node""",
    "p2_descendants": f"""WITH RECURSIVE {_LINKS},
walk AS (
  SELECT tree, node, [node] AS path FROM links WHERE up IS NULL
  UNION ALL SELECT l.tree, l.node, list_append(w.path, l.node) FROM walk w JOIN links l ON l.tree = w.tree AND l.up = w.node)
SELECT tree, ancestor, node, CAST(len(path) - place AS INTEGER) AS steps FROM (SELECT tree, node, path, unnest(path) AS ancestor, generate_subscripts(path, 1) AS place FROM walk) WHERE place < len(path)""",
    "p4_found": f"WITH {_EVENTS} SELECT DISTINCT src_table, period, row_key, ref_key, why FROM {_judged(_THERE)} WHERE why IS NOT NULL",
    "p4_by_month": f"WITH {_EVENTS} SELECT src_table, period, why, count(*) AS n FROM {_judged(_THERE)} WHERE why IS NOT NULL GROUP BY 1, 2, 3",
    "p4_history": f"WITH {_EVENTS} SELECT src_table, period, why, count(*) AS n, step FROM ({' UNION ALL '.join('SELECT * FROM ' + _judged(_THERE, c, str(k + 1)) for k, c in enumerate(_CUTS))}) WHERE why IS NOT NULL GROUP BY 1, 2, 3, 5",
    "p4_reopened": f"WITH {_EVENTS} SELECT DISTINCT src_table, period, row_key, ref_key, why FROM {_judged(_THERE + ' AND (g.gone_at IS NULL OR g.gone_at <= t.last_at)')} WHERE why IS NOT NULL",
    "p6_found": """SELECT rtrim(lower(trim(domain)), '.') AS domain, count(DISTINCT url_hash) AS n_urls, arg_min(url_hash, (created_at, url_hash)) AS first_hash
FROM frontier WHERE domain IS NOT NULL GROUP BY 1""",
}
