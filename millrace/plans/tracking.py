"""Queries of the ledger, metrics, captures and redaction beyond `catalog`, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import records as rec, redact, text as tx, url as ur
from ..functions.keys import ref
from ..operators import capture, metrics as mt, routing, tasks as tk
from ..runtime import table
from .catalog import _EVID, _EXPIRED, _FORMAT, _MAXA, _REF, _TASKS, NOW, _events, _evidence, _tasks

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH x AS (SELECT min(url) AS u FROM raw_artifacts) SELECT sha256, url, fetched_at FROM raw_artifacts, x WHERE url = u UNION ALL SELECT sha256, url, fetched_at FROM raw_artifacts WHERE sha256 = (SELECT max(sha256) FROM raw_artifacts) UNION ALL SELECT sha256, url, fetched_at FROM raw_artifacts WHERE parent_task = (SELECT min(parent_task) FROM raw_artifacts WHERE length(parent_task) > 10)")
def artifact_lookup(spark, d):
    """SRC-07: by address, content and task."""
    a = table(spark, d, "raw_artifacts")
    u, s, t = a.agg(F.min("url"), F.max("sha256"), F.min(F.when(F.length("parent_task") > 10, F.col("parent_task")))).first()
    parts = [capture.lookup(a, url=u), capture.lookup(a, content=s), capture.lookup(a, task=t)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("sha256", "url", "fetched_at")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'missing' WHEN doc_id % 5 = 2 THEN 'size' WHEN doc_id % 5 = 3 THEN 'hash' ELSE '' END AS why, strlen(text) >= 1024 AND doc_id % 2 = 0 AS packed FROM documents WHERE text IS NOT NULL")
def artifact_integrity(spark, d):
    """SRC-01, SRC-04: bodies made of documents, some of them damaged."""
    k, b = F.col("doc_id") % 5, F.encode("text", "UTF-8")
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", F.when(k != 1, b).alias("body"), (F.length(b) + F.when(k == 2, 1).otherwise(0)).alias("size"), F.when(k == 3, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(b, 256)).alias("sha256"), F.length(b).alias("n"))
    whole = x.withColumn("why", F.when(F.col("body").isNull(), "missing").when(F.length("body") != F.col("size"), "size").when(F.sha2("body", 256) != F.col("sha256"), "hash").otherwise(""))
    return whole.select("doc_id", "why", capture.packed(F.col("n"), F.when(F.col("doc_id") % 2 == 0, "text/html").otherwise("image/png")).alias("packed"))


@query(f"WITH a AS (SELECT DISTINCT sha256, url, size, mime FROM raw_artifacts) SELECT sha256, url, size, mime, CASE WHEN size IS NULL THEN 'missing' WHEN size <= 0 THEN 'empty' WHEN size < 512 THEN 'too_small' WHEN size > 60000 THEN 'too_large' WHEN {_FORMAT} = 'html' THEN 'html' WHEN {_FORMAT} NOT IN ('pdf', 'png', 'jpeg', 'json') THEN 'format' ELSE '' END AS reason FROM a")
def artifact_verdicts(spark, d):
    """FLT-11 with an upper bound and formats."""
    a = table(spark, d, "raw_artifacts").select("sha256", "url", "size", "mime").distinct()
    return a.select("*", capture.verdict(F.col("size"), F.col("url"), F.col("mime"), F.col("sha256"), 512, 60_000, ("pdf", "png", "jpeg", "json"))["reason"].alias("reason"))


@query("SELECT sha256, url, CASE size % 3 WHEN 0 THEN size WHEN 1 THEN size * 2 END AS total, size % 3 = 1 OR status = 206 AS resumable FROM (SELECT DISTINCT sha256, url, size, status FROM raw_artifacts)")
def artifact_probes(spark, d):
    """SUP-24: what headers say of a body's size, and whether it can be resumed."""
    a = table(spark, d, "raw_artifacts").select("sha256", "url", "size", "status").distinct()
    k = F.col("size") % 3
    headers = F.when(k == 0, F.create_map(F.lit("content-length"), F.col("size").cast("string"))).when(k == 1, F.create_map(F.lit("content-range"), F.concat(F.lit("bytes 0-9/"), (F.col("size") * 2).cast("string")), F.lit("accept-ranges"), F.lit("Bytes"))).otherwise(F.create_map(F.lit("content-length"), F.lit("x")))
    return a.withColumn("p", capture.probe(headers, F.coalesce("status", F.lit(0)))).select("sha256", "url", "p.total", F.when(F.col("status").isNull() & (k != 1), F.lit(None)).otherwise(F.col("p.resumable")).alias("resumable"))


@query(f"WITH {_TASKS}, x AS (SELECT *, CASE WHEN {_EXPIRED} THEN CASE WHEN attempts + 1 >= {_MAXA} THEN 'dead' ELSE 'retry' END ELSE state END AS now FROM t) SELECT task_id, updated_at FROM x WHERE now IN ('pending', 'retry') ORDER BY updated_at, task_id LIMIT 200")
def task_claim_recovered(spark, d):
    """TOP-01: expired leases first go back, then the oldest are claimed."""
    return tk.claim(_tasks(spark, d), 200, NOW).select("task_id", "updated_at")


@query(f"WITH {_TASKS} SELECT (SELECT count(*) FROM t WHERE {_EXPIRED}) AS expired, count(*) FILTER (state IN ('pending', 'retry')) AS depth, count(*) FILTER (state IN ('pending', 'retry')) < 100 AS accepts, CASE WHEN count(*) FILTER (state IN ('pending', 'retry')) < 100 THEN '' ELSE 'full' END AS reason FROM t")
def task_capacity(spark, d):
    """AGG-18, AGG-20."""
    return tk.expired_count(_tasks(spark, d), NOW).crossJoin(tk.capacity(_tasks(spark, d), 100))  # one row each


@query(f"WITH {_TASKS}, c AS (SELECT count(*) FILTER (state = 'done') AS new, CAST(0 AS BIGINT) AS unchanged, CAST(0 AS BIGINT) AS updated, count(*) FILTER (state = 'policy_denied') AS policy_denied, count(*) FILTER (state = 'dead') AS failed FROM t) SELECT *, new + policy_denied + failed AS total, new AS changed FROM c")
def task_ledger_summary(spark, d):
    """AGG-04."""
    return tk.ledger_summary(tk.ledger_counts(_tasks(spark, d)))


@query(f"WITH {_TASKS} SELECT updated_at AS at, state, target AS url FROM t WHERE state = 'done' ORDER BY updated_at DESC, target LIMIT 100")
def task_ledger_events(spark, d):
    """AGG-05."""
    return tk.ledger_events(_tasks(spark, d).select(F.col("updated_at").alias("at"), "state", F.col("target").alias("url")), "done")


@query(f"WITH {_TASKS}, {_EVID}, l AS (SELECT \"at\", 'task ' || task_id || '/' || id AS label, task_id FROM e WHERE task_id IS NOT NULL AND signal <> 'ok') SELECT task_id, label, row_number() OVER (PARTITION BY task_id ORDER BY \"at\" DESC NULLS LAST, label) AS rn FROM l WHERE task_id IN (SELECT task_id FROM t) QUALIFY rn <= 5")
def task_dead_letters(spark, d):
    """JOIN-06, WIN-07: evidence that is not ok as dead letters whose label names the task."""
    e = _evidence(spark, d).filter("task_id is not null and signal <> 'ok'")
    letters = e.select("at", F.concat(F.lit("task "), F.col("task_id"), F.lit("/"), F.col("id").cast("string")).alias("label"), F.col("signal").alias("error"))
    return tk.dead_letters_of(letters, _tasks(spark, d)).select("task_id", "label", "rn")


@query(f"WITH {_TASKS}, {_EVID}, s AS (SELECT * FROM t WHERE target LIKE '%/forum/%'), g AS (SELECT task_id FROM s WHERE state NOT IN ('leased', 'running')) SELECT (SELECT count(*) FROM g) AS tasks, (SELECT count(*) FROM s) - (SELECT count(*) FROM g) AS skipped, (SELECT count(*) FROM e WHERE task_id IN (SELECT task_id FROM g)) AS evidence, (SELECT count(*) FROM e WHERE signal = 'parser_failed' AND task_id IN (SELECT task_id FROM g)) AS errors")
def task_forget(spark, d):
    """AGG-19, SUP-31: a dry run over the tasks of one part of the sites."""
    t, e = _tasks(spark, d), _evidence(spark, d)
    return tk.forget(t, e, e.filter("signal = 'parser_failed'"), t.filter("target like '%/forum/%'").select("task_id"))


@query(f"WITH {_EVID} SELECT id, signal, decision, reason, stage, \"at\", TRY_CAST(CASE WHEN json_valid(facts_json) THEN facts_json->>'$.status' END AS BIGINT) AS status FROM e")
def evidence_round_trip(spark, d):
    """SUP-02, SUP-03: evidence to JSON, gathered in an array, spread again and read back."""
    f = F.create_map(F.lit("status"), F.try_variant_get(F.try_parse_json("facts_json"), "$.status", "string"))
    x = _evidence(spark, d).select("id", tk.evidence_json(F.struct("signal", "decision", "reason", "stage", f.alias("facts"), "at")).alias("j"))
    y = x.select(F.col("id").alias("task_id"), F.array(F.from_json("j", tk.EVIDENCE)).alias("items"))
    return tk.add_evidence(y, "items").select(F.col("task_id").alias("id"), "signal", "decision", "reason", "stage", "at", F.col("facts")["status"].try_cast("long").alias("status"))


@query(f"""WITH {_TASKS}, {_EVID}, x AS (SELECT e.id, coalesce(e.stage, '') AS stage, coalesce(e.signal, '') AS signal, coalesce(t.attempts, 0) AS a, coalesce(t.throttles, 0) AS h, coalesce(t.transitions, 0) AS n FROM e LEFT JOIN t ON t.task_id = e.task_id)
SELECT id, CASE
  WHEN a >= 6 THEN 'budget_exhausted' WHEN n >= 8 THEN 'transitions_capped' WHEN signal = 'policy_denied' THEN 'policy_denied'
  WHEN signal = 'throttled' AND h + 1 >= 3 THEN 'throttle_capped' WHEN signal = 'throttled' THEN 'throttle_retry'
  WHEN signal = 'transient_failure' AND a + 1 >= 3 THEN 'attempts_capped' WHEN signal = 'transient_failure' THEN 'transient_retry'
  WHEN signal = 'resource_denied' THEN 'resource_denied' WHEN signal = 'permanent_failure' THEN 'permanent_failure' WHEN signal = 'parser_failed' THEN 'parser_failed_is_not_failure'
  WHEN stage = 'classify' THEN 'classify_done_to_direct'
  WHEN stage = 'direct' THEN CASE WHEN signal = 'ok' THEN 'direct_ok' WHEN signal IN ('media_manifest', 'large_object') THEN 'direct_media_to_artifact' WHEN signal = 'stream' THEN 'direct_stream_candidate' WHEN signal = 'empty_content' THEN 'direct_empty_to_browser' WHEN signal = 'unknown_format' THEN 'direct_unknown_format_to_artifact' ELSE 'none' END
  WHEN stage = 'inspect' THEN CASE WHEN signal = 'ok' THEN 'inspect_ok' WHEN signal = 'empty_content' THEN 'inspect_empty_to_browser' ELSE 'none' END
  WHEN stage = 'artifact' THEN CASE WHEN signal = 'ok' THEN 'artifact_ok' ELSE 'none' END
  WHEN stage IN ('browser', 'observe') THEN CASE WHEN signal = 'ok' THEN 'browser_ok' WHEN signal = 'network_activity' THEN 'browser_network_activity' ELSE 'none' END
  ELSE 'none' END AS rule FROM x""")
def evidence_rules(spark, d):
    """STM-01: the rule that each evidence row meets, with its task's counters as conditions."""
    t = _tasks(spark, d).select(F.col("task_id").alias("tid"), "attempts", "throttles", "transitions")
    e = _evidence(spark, d)
    x = e.join(t, e["task_id"] == t["tid"], "left")
    a, h, n = (F.coalesce(c, F.lit(0)) for c in ("attempts", "throttles", "transitions"))
    conditions = {"budget": a >= 6, "transitions": n >= 8, "throttles_full": h + 1 >= 3, "attempts_full": a + 1 >= 3}
    return x.select("id", routing.route(F.coalesce("stage", F.lit("")), F.coalesce("signal", F.lit("")), conditions)["rule"].alias("rule"))


_KIND = "CASE WHEN event_type IN ('purchase') THEN 'counter' WHEN event_type = 'view' THEN 'gauge' ELSE 'histogram' END"


@query(f"WITH x AS (SELECT event_type AS name, event_type || '{{user=' || user_id % 7 || '}}' AS series, {_KIND} AS kind, value, ts, event_id FROM events) SELECT name, series, kind, count(value) AS n, round(CASE kind WHEN 'counter' THEN sum(value) WHEN 'gauge' THEN arg_max(value, (ts, event_id)) ELSE quantile_cont(value, 0.5) END, 6) AS value, CASE kind WHEN 'histogram' THEN round(quantile_cont(value, 0.95), 6) END AS p95 FROM x WHERE starts_with(name, 'p') OR starts_with(name, 'v') OR starts_with(name, 'c') GROUP BY 1, 2, 3")
def metric_snapshot(spark, d):
    """AGG-09, AGG-11, SUP-11, MAP-01."""
    e = _events(spark, d)
    kind = F.when(F.col("event_type") == "purchase", "counter").when(F.col("event_type") == "view", "gauge").otherwise("histogram")
    key = mt.series_key(F.col("event_type"), F.create_map(F.lit("user"), (F.col("user_id") % 7).cast("string")))
    rows = e.select(F.col("event_type").alias("name"), key.alias("series"), kind.alias("kind"), F.struct("ts", "event_id").alias("t"), "value")
    s = mt.snapshot(rows)
    return mt.by_prefix(s, "p").unionByName(mt.by_prefix(s, "v")).unionByName(mt.by_prefix(s, "c"))


@query("""WITH x AS (SELECT event_type AS metric, event_type IN ('view', 'click') AS up, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'new' END AS run, CASE WHEN event_type = 'purchase' AND event_id % 2 = 1 THEN value * 2 ELSE value END AS value FROM events),
m AS (SELECT metric, up, median(value) FILTER (run = 'base') AS base, median(value) FILTER (run = 'new') AS new FROM x GROUP BY 1, 2), c AS (SELECT *, (new - base) / base * 100 AS delta FROM m)
SELECT metric, round(base, 6) AS base, round(new, 6) AS new, round(delta, 4) AS delta_pct, CASE WHEN CASE WHEN up THEN -delta ELSE delta END > 20 THEN 'regressed' WHEN CASE WHEN up THEN -delta ELSE delta END < -20 THEN 'improved' ELSE 'ok' END AS verdict FROM c""")
def metric_regressions(spark, d):
    """AGG-22, AGG-23: odd against even events as two runs."""
    odd = F.col("event_id") % 2 == 1
    value = F.when((F.col("event_type") == "purchase") & odd, F.col("value") * 2).otherwise(F.col("value"))
    return mt.regressions(table(spark, d, "events").select(F.col("event_type").alias("metric"), F.col("event_type").isin("view", "click").alias("higher_is_better"), F.when(odd, "new").otherwise("base").alias("run"), value.alias("value")))


@query(f"""WITH {_TASKS}, s AS (SELECT kind, unnest([{{'t': created_at, 'd': 1}}, {{'t': updated_at, 'd': -1}}]) AS e FROM t WHERE created_at IS NOT NULL AND updated_at IS NOT NULL),
r AS (SELECT kind, sum(e.d) OVER (PARTITION BY kind ORDER BY e.t, e.d ROWS UNBOUNDED PRECEDING) AS o FROM s) SELECT kind, max(o) AS peak FROM r GROUP BY 1""")
def task_peaks(spark, d):
    """SUP-07: the most tasks of a kind open at once."""
    return mt.peaks(_tasks(spark, d), "kind", "created_at", "updated_at")


@query(f"WITH {_TASKS} SELECT task_id, least(8.0, 0.5 * pow(2, least(attempts + throttles, 8))) AS seconds, true AS within FROM t")
def task_backoff(spark, d):
    """MATH-01, MATH-02: waits after failures, and that the spread ones keep within half either way."""
    n = F.col("attempts") + F.col("throttles")
    plain, spread = F.least(F.lit(8.0), 0.5 * F.pow(F.lit(2.0), n)), mt.retry_delay(n + 1, F.col("task_id"))
    return _tasks(spark, d).select("task_id", mt.backoff(n).alias("seconds"), ((spread >= plain * 0.5) & (spread <= plain * 1.5)).alias("within"))


_T = "(epoch_us(ts) / 1000000.0)"


@query(f"WITH x AS (SELECT event_id, user_id, {_T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT event_id, round(greatest(t, max(t - (k - 1) * 600.0) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + (k - 3) * 600.0) - t, 3) AS waited FROM x")
def event_bucket(spark, d):
    """MATH-04: how long each event of a user would wait for a token: three at first, one in ten minutes after."""
    x = mt.bucket(_events(spark, d).withColumn("id", F.col("event_id")), "user_id", F.unix_micros("ts") / 1e6, 1 / 600.0, 3)
    return x.select("event_id", F.round(F.col("start") - F.col("t"), 3).alias("waited"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 300.0 WHEN 1 THEN CAST(event_id % 250 AS DOUBLE) WHEN 2 THEN CAST(event_id % 200 AS DOUBLE) END AS seconds FROM events")
def retry_after(spark, d):
    """URL-10: headers with seconds, with a date, with too much and with neither."""
    k, i = F.col("event_id") % 4, F.col("event_id")
    date = F.date_format(F.timestamp_seconds(F.lit(NOW) + i % 200), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    h = F.when(k == 0, "5000").when(k == 1, (i % 250).cast("string")).when(k == 2, date).otherwise("soon")
    return table(spark, d, "events").select("event_id", ur.retry_after(h, F.lit(NOW)).alias("seconds"))


@query("SELECT url, 'https://***@' || h || ':8080' AS proxied, url || '?token=[REDACTED]&a=' || length(url) || '#sid=[REDACTED]' AS shown, CASE WHEN length(url) % 2 = 0 THEN 'Cookie: [REDACTED]' ELSE 'password=[REDACTED] end' END AS line FROM (SELECT DISTINCT normalized_url AS url, regexp_extract(normalized_url, '^https?://([^/]+)', 1) AS h FROM frontier)")
def url_redacted(spark, d):
    """STR-08, STR-09, STR-13: addresses and lines with secrets put in."""
    u = table(spark, d, "frontier").select(F.col("normalized_url").alias("url")).distinct()
    n = F.length("url").cast("string")
    line = F.when(F.length("url") % 2 == 0, F.concat(F.lit("Cookie: sid="), n)).otherwise(F.concat(F.lit("password = pw"), n, F.lit(" end")))
    return u.select("url", redact.proxy(F.concat(F.lit("https://u:p"), n, F.lit("@"), ur.host(F.col("url")), F.lit(":8080/x"))).alias("proxied"), redact.url_secrets(F.concat("url", F.lit("?token=t"), n, F.lit("&a="), n, F.lit("#sid=s"), n)).alias("shown"), redact.credentials(line).alias("line"))


@query("SELECT doc_id, text || ' [邮箱] [IP] [手机号]' AS text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '@|[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}|1[3-9][0-9]{9}')")
def doc_redacted(spark, d):
    """STR-10, STR-11: personal data put at the end of documents that have none."""
    docs = table(spark, d, "documents").filter(~F.col("text").rlike(r"@|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|1[3-9][0-9]{9}"))
    i = F.col("doc_id").cast("string")
    x = docs.select("doc_id", F.concat("text", F.lit(" a.b"), i, F.lit("@mail.test 10.0."), (F.col("doc_id") % 200).cast("string"), F.lit(".7 13"), F.lpad(i, 9, "0")).alias("text"))
    return x.filter(F.size(redact.emails(F.col("text"))) == 1).select("doc_id", redact.personal(F.col("text")).alias("text"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '_CON.' || doc_id WHEN doc_id % 3 = 1 THEN 'a_b_' || doc_id ELSE 'x' || doc_id END AS name FROM documents")
def file_names(spark, d):
    """STR-16: names that Windows accepts."""
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("CON."), i)).when(k == 1, F.concat(F.lit("a/b?"), i)).otherwise(F.concat(F.lit("x"), i, F.lit(". . ")))
    return table(spark, d, "documents").select("doc_id", tx.safe_filename(raw).alias("name"))


@query(f"WITH {_TASKS} SELECT 'task' AS kind, to_json({{'kind': 'task', 'task_id': task_id, 'state': state}}) AS line FROM t WHERE task_id IS NOT NULL AND state IS NOT NULL UNION ALL SELECT 'page', to_json({{'kind': 'page', 'url_hash': url_hash, 'batch_no': batch_no}}) FROM (SELECT DISTINCT url_hash, batch_no FROM pages WHERE url_hash IS NOT NULL AND batch_no IS NOT NULL)")
def export_rows(spark, d):
    """SRC-16, SRC-17, SET-02, TOP-04: tagged JSON lines of two kinds of rows."""
    pages = table(spark, d, "pages").select("url_hash", "batch_no").distinct().filter("url_hash is not null and batch_no is not null")
    return tk.export("task", _tasks(spark, d).select("task_id", "state").filter("task_id is not null and state is not null")).unionByName(tk.export("page", pages))


@query(f"""WITH {_TASKS}, {_EVID}, l AS (SELECT task_id, arg_max({{'d': decision, 'r': reason}}, id) FILTER (coalesce(decision, '') <> '') AS x FROM e WHERE task_id IS NOT NULL GROUP BY 1)
SELECT t.task_id, t.task_id || ' ' || state || CASE WHEN coalesce(x.d, '') <> '' THEN ': ' || x.d || CASE WHEN coalesce(x.r, '') <> '' THEN ' (' || x.r || ')' ELSE '' END ELSE '' END || ', attempts ' || coalesce(attempts, 0) AS line FROM t LEFT JOIN l ON l.task_id = t.task_id""")
def task_lines(spark, d):
    """STR-19."""
    return tk.explained(_tasks(spark, d), tk.last_decision(_evidence(spark, d).filter("task_id is not null")))


@query(f"WITH {_TASKS} SELECT task_id, kind, target, 'done' AS state, attempts, CASE WHEN json_valid(policy_json) THEN policy_json->>'$.robots' END AS robots, CASE WHEN json_valid(budget_json) THEN budget_json->>'$.max_attempts' END AS budget, 1 AS n_evidence FROM t")
def task_rows(spark, d):
    """SUP-04: tasks to JSON text and back, then moved to another state."""
    x = tk.deserialized(tk.serialized(_tasks(spark, d)), "row")
    y = tk.with_state(x, F.lit("done"), F.lit("ok"), F.lit(NOW))
    return y.select("task_id", "kind", "target", "state", "attempts", F.col("policy")["robots"].alias("robots"), F.col("budget")["max_attempts"].alias("budget"), F.size("evidence").alias("n_evidence"))


@query("SELECT DISTINCT normalized_url AS target, 'acquire' AS kind, substr(sha256('acquire|' || normalized_url), 1, 32) AS idempotency_key, '2' AS attempts_allowed FROM frontier WHERE normalized_url IS NOT NULL")
def task_new(spark, d):
    """SUP-05, JOIN-08, STM-06: tasks for all addresses, one a key."""
    new = tk.constructed(table(spark, d, "frontier").select("normalized_url"), "acquire", "normalized_url", "small")
    stored = new.limit(0)
    return tk.enqueue(stored, new).select("target", "kind", "idempotency_key", F.get_json_object("budget_json", "$.max_attempts").alias("attempts_allowed"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'disk:over_capacity' WHEN 2 THEN 'gpu:no_capacity' ELSE 'tape:unknown|tier:bad' END AS problems FROM documents")
def request_problems(spark, d):
    """FLT-09."""
    k = F.col("doc_id") % 4
    wanted = F.when(k == 0, F.create_map(F.lit("disk"), F.lit(1))).when(k == 1, F.create_map(F.lit("disk"), F.lit(9))).when(k == 2, F.create_map(F.lit("gpu"), F.lit(1), F.lit("disk"), F.lit(2))).otherwise(F.create_map(F.lit("tape"), F.lit(1)))
    p = tk.problems(wanted, {"disk": 4, "gpu": 0}, ("a", "b"), F.when(k == 3, "z").otherwise("a"))
    return table(spark, d, "documents").select("doc_id", F.array_join(p, "|").alias("problems"))
