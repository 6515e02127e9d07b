"""Queries of the engine's own operators over the capture tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import records as rec, redact, text as tx, url as ur
from ..functions.keys import ref
from ..operators import capture, dedup, metrics as mt, robots, routing, search, tasks as tk
from ..runtime import Scratch, table

QUERIES: dict = {}
SQL: dict = {}
NOW = 1750000000.0
_REF = "CASE WHEN lower(trim({0})) NOT IN ('', '-') THEN lower(trim({0})) END"


def query(sql: str | None = None):
    """Register a query, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, d: str) -> DataFrame:
    """url_hash, url, title, text of readable records, one a url_hash."""
    v = table(spark, d, "extracted").select("url_hash", F.try_parse_json("data_json").alias("v")).filter("v is not null")
    get = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit(""))
    return v.select("url_hash", get("url").alias("url"), get("title").alias("title"), get("text").alias("text")).dropDuplicates(["url_hash"])


_RECORDS = "r AS (SELECT DISTINCT url_hash, coalesce(data_json->>'$.url', '') AS url, coalesce(data_json->>'$.title', '') AS title, coalesce(data_json->>'$.text', '') AS text FROM extracted WHERE json_valid(data_json))"
_HITS = " + ".join(f"CAST(contains(lower(trim(text, ' ') || ' ' || title), '{w}') AS INTEGER)" for w in tx.SHELL_WORDS)
_QUALITY = f"""WITH {_RECORDS}, h AS (SELECT *, {_HITS} AS shell_hits, length(trim(text, ' ')) AS n FROM r),
s AS (SELECT *, n < 400 AND (shell_hits >= 2 OR (n < 80 AND shell_hits >= 1) OR n = 0) AS is_shell FROM h),
q AS (SELECT *, least(1.0, greatest(0.0, least(1.0, length(text) / 400.0) * 0.45 + (CAST(trim(title, ' ') <> '' AS INTEGER) + CAST(n > 0 AS INTEGER) + CAST(trim(url, ' ') <> '' AS INTEGER)) / 3.0 * 0.35 - CASE WHEN is_shell THEN 0.4 ELSE 0.0 END)) AS score FROM s)"""


@query(f"{_QUALITY} SELECT url_hash, substr(sha256(text), 1, 16) AS content_hash, shell_hits, is_shell, round(score, 6) AS score, score >= 0.12 AS accepted FROM q")
def page_quality_gate(spark, d):
    """STR-17, FLT-10, STR-06: every readable record with its score and verdict."""
    r = _records(spark, d)
    t, ti = F.col("text"), F.col("title")
    s = tx.quality(t, ti, F.col("url"))
    return r.select("url_hash", tx.content_hash(t).alias("content_hash"), tx.shell_hits(t, ti).alias("shell_hits"), tx.is_shell(t, ti).alias("is_shell"), F.round(s, 6).alias("score"), (s >= tx.MIN_SCORE).alias("accepted"))


@query(f"{_QUALITY} SELECT count(*) AS n, count(*) FILTER (score >= 0.6) AS accepted, count(*) FILTER (score < 0.6) AS rejected, sum(length(text)) AS chars FROM q")
def page_replay_stats(spark, d):
    """AGG-06 with a raised threshold."""
    r = _records(spark, d)
    s = tx.quality(F.col("text"), F.col("title"), F.col("url"))
    return r.agg(F.count("*").alias("n"), F.count_if(s >= 0.6).alias("accepted"), F.count_if(s < 0.6).alias("rejected"), F.sum(F.length("text")).alias("chars"))


_TOKENS = """list_concat(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'), flatten(list_transform(regexp_extract_all(lower(text), '[一-鿿]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"""


@query(f"SELECT doc_id, coalesce(len({_TOKENS}), 0) AS n_tokens, CASE WHEN text IS NOT NULL THEN substr(sha256(array_to_string({_TOKENS}, ' ')), 1, 16) END AS tokens_hash FROM documents")
def doc_tokens(spark, d):
    """STR-01, STR-02: token counts and the hash of the token blob."""
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.when(F.col("text").isNotNull(), tx.content_hash(F.array_join(t, " "))).alias("tokens_hash"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def doc_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


_SUMS = ", ".join(f"CASE WHEN 2 * sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n ELSE 0 END) > sum(n) THEN {1 << i} ELSE 0 END AS b{i}" for i in range(63))
_SIMHASH = f"""t AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents),
c AS (SELECT doc_id, t, count(*) AS n FROM t GROUP BY 1, 2),
h AS (SELECT doc_id, n, CAST('0x' || substr(sha256(t), 1, 16) AS UBIGINT) AS h FROM c),
v AS (SELECT doc_id, {_SUMS} FROM h GROUP BY doc_id),
s AS (SELECT d.doc_id, d.text, CAST(coalesce({' + '.join(f'CAST(b{i} AS HUGEINT)' for i in range(63))}, 0) AS BIGINT) AS simhash FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id)"""


@query(f"WITH {_SIMHASH} SELECT doc_id, simhash FROM s")
def doc_simhash(spark, d):
    """AGG-14."""
    return tx.simhash(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL")
def doc_exact_dups(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return dedup.exact(docs, "doc_id", "h").select("doc_id", F.col("first_key").alias("first_id"))


def _printed(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", tx.content_hash(t).alias("h"), tx.simhash_of(t).alias("simhash"))
    return Scratch(spark, "printed").put(docs, "docs")  # read several times; each text is fingerprinted once


@query(f"WITH {_SIMHASH}, k AS (SELECT simhash, min(doc_id) AS k FROM s WHERE text IS NOT NULL GROUP BY 1) SELECT a.k AS a, b.k AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM k a JOIN k b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3")
def doc_near_dups(spark, d):
    """JOIN-02 over fingerprints, one row a pair of different ones."""
    return dedup.near_pairs(_printed(spark, d), "doc_id", "simhash").select("a", "b", "distance")


@query(f"""WITH {_SIMHASH}, x AS (SELECT doc_id, substr(sha256(text), 1, 16) AS h, simhash FROM s WHERE text IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM x),
m AS (SELECT a.doc_id, arg_min(b.h, b.doc_id) AS dup FROM f a JOIN f b ON a.rn = 1 AND b.rn = 1 AND b.doc_id < a.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 3 GROUP BY 1)
SELECT f.doc_id, CASE WHEN rn > 1 THEN 'unchanged' ELSE 'new' END AS state, CASE WHEN rn = 1 THEN m.dup END AS duplicate_of FROM f LEFT JOIN m ON m.doc_id = f.doc_id""")
def doc_dedup_verdict(spark, d):
    """PAR-14, Q-2, Q-3."""
    return dedup.verdicts(_printed(spark, d), "doc_id", "h", "simhash")


@query()
def doc_redact(spark, d):
    """STR-08 to STR-11: texts redacted, with the e-mail addresses found (look-around, so no SQL; tests hold the cases)."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", redact.personal(redact.credentials(redact.url_secrets(t))).alias("text"), F.size(redact.emails(t)).alias("n_emails"))


def _search_sql(phrases: list[list[str]]) -> str:
    parts = []
    for n, p in enumerate(phrases):
        joins = " ".join(f"JOIN t t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(p) if i)
        parts.append(f"SELECT {n} AS p, t0.doc_id, count(*) AS f FROM t t0 {joins} WHERE t0.term = '{p[0]}' GROUP BY t0.doc_id")
    toks = _TOKENS.replace("lower(text)", "lower(replace(text, '_', ' '))")
    return f"""WITH l AS (SELECT doc_id, {toks} AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM l),
z AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), a AS (SELECT count(*) AS docs, avg(len) AS av FROM z), h AS ({' UNION ALL '.join(parts)}),
df AS (SELECT p, count(*) AS n FROM h GROUP BY 1),
x AS (SELECT h.doc_id, count(*) AS found, sum(CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))) AS s FROM h JOIN df USING (p) JOIN z USING (doc_id), a GROUP BY 1)
SELECT doc_id, round(-s, 4) AS score FROM x WHERE found = {len(phrases)} ORDER BY 2, 1 LIMIT 20"""


@query(_search_sql([["library"]]))
def doc_search_term(spark, d):
    """AGG-15: one word."""
    return search.search(search.index(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "library")


@query(_search_sql([["copper", "library"], ["each"]]))
def doc_search_phrase(spark, d):
    """JOIN-12: a phrase (joined by a hyphen) and a word."""
    return search.search(search.index(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "copper-library each")


@query("""WITH u AS (SELECT DISTINCT normalized_url AS url FROM frontier),
p AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, rtrim(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '.') AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT url, s || '://' || h || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/+', '/', 'g') AS canon FROM p)
SELECT url, canon, substr(sha256(canon), 1, 16) AS fingerprint, substr(sha256('acquire|' || url), 1, 32) AS idem FROM c""")
def url_canonical(spark, d):
    """URL-01, URL-04, URL-06."""
    u = table(spark, d, "frontier").select(F.col("normalized_url").alias("url")).distinct()
    return u.select("url", ur.canonical(F.col("url")).alias("canon"), ur.fingerprint(F.col("url")).alias("fingerprint"), ur.idempotency_key(F.lit("acquire"), F.col("url")).alias("idem"))


@query("SELECT DISTINCT normalized_url AS url, false AS unsafe FROM frontier")
def url_unsafe(spark, d):
    """No address of the frontier is private; `url_unsafe_hosts` has the cases that are."""
    u = table(spark, d, "frontier").select(F.col("normalized_url").alias("url")).distinct()
    return u.select("url", ur.unsafe(F.col("url")).alias("unsafe"))


@query("SELECT host, count(*) AS n_urls, min(url) AS first_url FROM (SELECT DISTINCT url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM raw_artifacts) GROUP BY 1")
def url_by_host(spark, d):
    """SRC-20, AGG-16."""
    u = table(spark, d, "raw_artifacts").select("url").distinct().withColumn("host", ur.host(F.col("url")))
    return u.groupBy("host").agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url"))


_ART = "a AS (SELECT sha256, url, min(fetched_at) AS fetched_at, arg_min({'size': size, 'mime': mime, 'status': status, 'source': source}, (fetched_at, size)) AS r FROM raw_artifacts GROUP BY 1, 2), u AS (SELECT sha256, url, fetched_at, r.size AS size, r.mime AS mime, r.status AS status FROM a)"


@query(f"WITH {_ART} SELECT count(*) AS n, coalesce(sum(size), 0) AS bytes FROM u")
def artifact_stats(spark, d):
    """SRC-02, SRC-05, SRC-10."""
    return capture.stats(capture.unique(table(spark, d, "raw_artifacts")))


@query("SELECT sha256, min(fetched_at) AS first_at FROM raw_artifacts GROUP BY 1")
def artifact_ids(spark, d):
    """SRC-06."""
    return capture.all_ids(table(spark, d, "raw_artifacts"))


@query(f"WITH {_ART} SELECT sha256, url, fetched_at FROM u WHERE fetched_at >= 1750000000 ORDER BY fetched_at, sha256, url LIMIT 100")
def artifact_since(spark, d):
    """SRC-08."""
    return capture.since(capture.unique(table(spark, d, "raw_artifacts")), NOW, 100).select("sha256", "url", "fetched_at")


@query(f"WITH {_ART} SELECT sha256, url, fetched_at FROM u WHERE url ILIKE '%forum%' ORDER BY fetched_at DESC, sha256, url LIMIT 500")
def artifact_url_like(spark, d):
    """SRC-09."""
    return capture.url_like(capture.unique(table(spark, d, "raw_artifacts")), "FORUM").select("sha256", "url", "fetched_at")


def _case(key: str, pairs: dict) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


_EXT = r"lower(regexp_extract(regexp_extract(url, '^([^?]*)', 1), '\.([A-Za-z0-9]+)$', 1))"
_MIME = "lower(trim(regexp_extract(coalesce(mime, ''), '^([^;]*)', 1)))"
_FORMAT = f"coalesce({_case(_EXT, rec.SUFFIXES)}, {_case(_MIME, rec.TYPES)}, {_case(_EXT, rec.GENERIC)}, 'unknown')"
_SIGNAL = "CASE WHEN status IN (429, 503) THEN 'throttled' WHEN status IN (404, 410) THEN 'permanent_failure' WHEN status >= 500 AND status < 600 THEN 'transient_failure' WHEN regexp_matches(lower(coalesce(mime, '')), 'mpegurl|dash') THEN 'media_manifest' WHEN regexp_matches(lower(coalesce(mime, '')), 'event-stream|websocket') THEN 'stream' WHEN regexp_matches(lower(coalesce(mime, '')), 'octet-stream|zip') OR size > 8388608 THEN 'large_object' ELSE 'ok' END"


@query(f"WITH {_ART} SELECT sha256, url, {_FORMAT} AS format, {_SIGNAL} AS signal FROM u")
def artifact_format(spark, d):
    """PAR-00 (without bodies), STM-03."""
    a = capture.unique(table(spark, d, "raw_artifacts"))
    return a.select("sha256", "url", rec.file_format(F.col("url"), F.col("mime"))["name"].alias("format"), rec.signal(F.col("status"), F.col("mime"), F.col("size")).alias("signal"))


@query(f"WITH {_ART} SELECT sha256, url, CASE WHEN size IS NULL OR size <= 0 THEN 'empty' WHEN size < 1024 THEN 'too_small' WHEN {_FORMAT} = 'html' THEN 'html' ELSE '' END AS document_why, CASE WHEN size IS NULL OR size <= 0 THEN 'empty' WHEN size < 512 THEN 'too_small' WHEN {_FORMAT} = 'html' THEN 'html' WHEN NOT starts_with(lower(coalesce(mime, '')), 'image/') THEN 'mime' ELSE '' END AS image_why FROM u")
def artifact_contracts(spark, d):
    """FLT-11, SUP-23."""
    a = capture.unique(table(spark, d, "raw_artifacts"))
    c = [F.col(x) for x in ("size", "url", "mime")]
    return a.select("sha256", "url", capture.contract(*c, capture.CONTRACTS["document"]).alias("document_why"), capture.contract(*c, capture.CONTRACTS["image"], "image/").alias("image_why"))


_TASKS = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC NULLS LAST, transitions DESC NULLS LAST) AS rn FROM tasks) WHERE rn = 1)"


def _tasks(spark, d) -> DataFrame:
    return tk.latest(table(spark, d, "tasks"), "task_id", "updated_at", "transitions")


@query(f"WITH {_TASKS} SELECT state, count(*) AS n, count(*) FILTER (state IN ('pending', 'retry')) AS claimable, count(*) FILTER (state IN ('leased', 'running')) AS in_flight FROM t GROUP BY 1")
def task_state_counts(spark, d):
    """AGG-01, AGG-02, AGG-18, JOIN-09."""
    return tk.state_counts(_tasks(spark, d))


@query(f"WITH {_TASKS} SELECT count(*) FILTER (state = 'done') AS new, 0 AS unchanged, 0 AS updated, count(*) FILTER (state = 'policy_denied') AS policy_denied, count(*) FILTER (state = 'dead') AS failed FROM t")
def task_ledger_counts(spark, d):
    """AGG-03, AGG-04."""
    return tk.ledger_counts(_tasks(spark, d))


@query(f"WITH {_TASKS} SELECT task_id, updated_at FROM t WHERE state IN ('pending', 'retry') ORDER BY updated_at, task_id LIMIT 50")
def task_claim_batch(spark, d):
    """TOP-01."""
    return tk.claim(_tasks(spark, d), 50).select("task_id", "updated_at")


_EXPIRED = "(state IN ('leased', 'running') AND coalesce(CASE WHEN isnan(lease_expires) THEN 0 ELSE lease_expires END, 0) < 1750000000)"
_MAXA = "coalesce(CASE WHEN json_valid(budget_json) THEN TRY_CAST(budget_json->>'$.max_attempts' AS BIGINT) END, 3)"


@query(f"WITH {_TASKS} SELECT task_id, CASE WHEN {_EXPIRED} THEN CASE WHEN attempts + 1 >= {_MAXA} THEN 'dead' ELSE 'retry' END ELSE state END AS state, attempts + CASE WHEN {_EXPIRED} THEN 1 ELSE 0 END AS attempts FROM t")
def task_recover_leases(spark, d):
    """FLT-02, AGG-20, STM-05."""
    return tk.recover(_tasks(spark, d), NOW).select("task_id", "state", "attempts")


@query(f"WITH {_TASKS} SELECT task_id, NOT (state IN ('leased', 'running') OR attempts >= 5) AS ok, CASE WHEN state IN ('leased', 'running') THEN 'in_flight' WHEN attempts >= 5 THEN 'attempts' ELSE '' END AS reason, CASE WHEN state IN ('leased', 'running') OR attempts >= 5 THEN state ELSE 'pending' END AS state, attempts + CASE WHEN state IN ('leased', 'running') OR attempts >= 5 THEN 0 ELSE 1 END AS attempts FROM t")
def task_requeue(spark, d):
    """STM-04."""
    return tk.requeue(_tasks(spark, d))


@query(f"WITH {_TASKS} SELECT task_id, CASE WHEN attempts >= 3 THEN 'attempts' WHEN transitions >= 8 THEN 'transitions' WHEN seconds_done >= 60 THEN 'seconds' WHEN bytes_done >= 500000 THEN 'bytes' WHEN throttles >= 4 THEN 'throttles' END AS exhausted FROM t")
def task_budget(spark, d):
    """FLT-03."""
    return _tasks(spark, d).select("task_id", tk.exhausted({"attempts": 3, "transitions": 8, "seconds": 60, "bytes": 500000, "throttles": 4}).alias("exhausted"))


@query(f"WITH {_TASKS}, p AS (SELECT * FROM t ORDER BY updated_at DESC, task_id LIMIT 50 OFFSET 10) SELECT p.task_id, p.state, p.updated_at, (SELECT count(*) FROM (SELECT DISTINCT id, {_REF.format('task_id')} AS k FROM task_evidence) e WHERE e.k = p.task_id) AS n_evidence FROM p")
def task_overview(spark, d):
    """TOP-02, JOIN-07."""
    return tk.overview(_tasks(spark, d), _evidence(spark, d), 50, 10)


def _evidence(spark, d) -> DataFrame:
    """Evidence once a row id, its reference folded."""
    return table(spark, d, "task_evidence").withColumn("task_id", ref("task_id")).dropDuplicates(["id"])


_EVID = f"e AS (SELECT * REPLACE ({_REF.format('task_id')} AS task_id) FROM (SELECT DISTINCT ON (id) * FROM task_evidence))"


@query(f"""WITH {_TASKS}, {_EVID} SELECT t.task_id, coalesce(a.n, 0) AS n_evidence, coalesce(b.n, 0) AS n_artifacts, coalesce(c.n, 0) AS n_children, coalesce(g.n, 0) AS n_pages FROM t
LEFT JOIN (SELECT task_id, count(*) AS n FROM e GROUP BY 1) a ON a.task_id = t.task_id
LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT DISTINCT sha256, url, {_REF.format('parent_task')} AS k FROM raw_artifacts) GROUP BY 1) b ON b.k = t.task_id
LEFT JOIN (SELECT {_REF.format('parent_id')} AS k, count(*) AS n FROM t GROUP BY 1) c ON c.k = t.task_id
LEFT JOIN (SELECT url_hash, count(*) AS n FROM (SELECT DISTINCT url_hash FROM pages) GROUP BY 1) g ON g.url_hash = t.idempotency_key""")
def task_lineage(spark, d):
    """JOIN-03, JOIN-05, SUP-08."""
    arts = table(spark, d, "raw_artifacts").select("sha256", "url", ref("parent_task").alias("parent_task")).distinct()
    t = _tasks(spark, d).withColumn("parent_id", ref("parent_id"))
    return tk.lineage(t, _evidence(spark, d), arts, table(spark, d, "pages").select("url_hash").distinct()).select("task_id", "n_evidence", "n_artifacts", "n_children", "n_pages")


@query(f"WITH {_EVID} SELECT task_id, arg_max(signal, id) AS signal, arg_max(decision, id) FILTER (coalesce(decision, '') <> '') AS decision FROM e WHERE task_id IS NOT NULL GROUP BY 1")
def task_last_decision(spark, d):
    """WIN-05, WIN-06."""
    return tk.last_decision(_evidence(spark, d).filter("task_id is not null")).select("task_id", "signal", "decision")


def _route_sql() -> str:
    out = []
    for rule, stages, signals, cond, action, target in routing.RULES:
        if cond in ("budget", "transitions", "throttles_full", "attempts_full"):
            continue
        c = [f"stage IN ({', '.join(repr(x) for x in stages.split())})"] * (stages != "*") + [f"signal IN ({', '.join(repr(x) for x in signals.split())})"] * (signals != "*")
        if action == "stage" and target == "browser":
            action, target = "browser_candidate", "dead"
        out.append(f"WHEN {' AND '.join(c)} THEN '{rule}|{action}|{target}'")
    return "CASE " + " ".join(out) + " ELSE 'none|terminal|dead' END"


@query(f"WITH {_EVID} SELECT id, {_route_sql()} AS decision FROM e")
def evidence_route(spark, d):
    """Every evidence row through the rule table, budgets left open; `evidence_rules` has its conditions and SQL of its own."""
    r = routing.route(F.coalesce(F.col("stage"), F.lit("")), F.coalesce(F.col("signal"), F.lit("")))
    return _evidence(spark, d).select("id", r.alias("r")).select("id", F.concat_ws("|", "r.rule", "r.action", "r.target").alias("decision"))


@query(f"WITH {_EVID} SELECT id, CASE WHEN json_valid(facts_json) THEN TRY_CAST(facts_json->>'$.status' AS BIGINT) END AS status, CASE WHEN json_valid(facts_json) THEN TRY_CAST(facts_json->>'$.ms' AS BIGINT) END AS ms, NOT json_valid(facts_json) AS raw FROM e WHERE facts_json IS NOT NULL")
def evidence_facts(spark, d):
    """JSON-04."""
    x = _evidence(spark, d).filter("facts_json is not null").select("id", rec.facts(F.col("facts_json")).alias("f"))
    return x.select("id", F.try_variant_get("f", "$.status", "long").alias("status"), F.try_variant_get("f", "$.ms", "long").alias("ms"), F.try_variant_get("f", "$.__raw__", "string").isNotNull().alias("raw"))


_TS = "(epoch_us(ts) / 1000000.0)"


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def event_quantiles(spark, d):
    """AGG-08."""
    return mt.quantiles(table(spark, d, "events"), "event_type", "value")


@query("SELECT user_id, l[least(len(l), CAST(floor(len(l) * 0.5) AS BIGINT) + 1)] AS p50, l[least(len(l), CAST(floor(len(l) * 0.95) AS BIGINT) + 1)] AS p95 FROM (SELECT user_id, list_sort(list(value)) AS l FROM events GROUP BY 1)")
def event_floor_quantiles(spark, d):
    """AGG-07."""
    return table(spark, d, "events").groupBy("user_id").agg(mt.floor_quantile(F.col("value"), 0.5).alias("p50"), mt.floor_quantile(F.col("value"), 0.95).alias("p95"))


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_type, count(value) AS n, count(value) FILTER (rn <= 512) AS kept, count(value) - count(value) FILTER (rn <= 512) AS dropped, round(quantile_cont(value, 0.5) FILTER (rn <= 512), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (rn <= 512), 6) AS p95 FROM x GROUP BY 1")
def event_ring(spark, d):
    """WIN-01 with a ring of 512."""
    return mt.ring(table(spark, d, "events"), "event_type", "value", "ts", "event_id", keep=512)


_SERIES = "'events{type=' || event_type || ',user=' || user_id || '}'"


@query(f"WITH s AS (SELECT {_SERIES} AS series, count(*) AS n, min((ts, event_id)) AS seen FROM events GROUP BY 1) SELECT series, n, row_number() OVER (ORDER BY seen) <= 64 AS kept FROM s")
def event_series_cap(spark, d):
    """AGG-09, AGG-10, MAP-01 with a cap of 64 series."""
    key = mt.series_key(F.lit("events"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("none"), F.lit(None).cast("string")))
    return mt.capped_series(_events(spark, d).withColumn("series", key), "series", "ts", "event_id", most=64)


@query(f"""WITH x AS (SELECT event_type, event_id AS id, {_TS} AS t, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
y AS (SELECT *, max(t) OVER (PARTITION BY event_type) AS now FROM x WHERE rn <= 256), z AS (SELECT event_type, max((t, total)) AS z, min((t, total)) FILTER (t >= now - 86400) AS a FROM y GROUP BY 1)
SELECT event_type, round((z[2] - a[2]) / greatest(z[1] - a[1], 1e-6), 6) AS rate FROM z""")
def event_rate(spark, d):
    """WIN-02 over a day."""
    return mt.sliding_rate(_events(spark, d).withColumn("id", F.col("event_id")), "event_type", F.unix_micros("ts") / 1e6, 86400.0)


@query(f"WITH x AS (SELECT event_id, user_id, {_TS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT event_id, round(max(t - k * 30.0) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + k * 30.0 - t, 3) AS waited FROM x")
def event_polite_slots(spark, d):
    """WIN-08: how long each event of a user would wait for slots 30 seconds apart."""
    x = mt.polite_slots(_events(spark, d).withColumn("id", F.col("event_id")), "user_id", F.unix_micros("ts") / 1e6, 30.0)
    return x.select("event_id", F.round(F.col("start") - F.col("t"), 3).alias("waited"))


@query("WITH x AS (SELECT event_id, user_id, ts, CAST(event_type <> 'purchase' AS INTEGER) AS f, sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM x")
def event_runs(spark, d):
    """WIN-09: events since the last purchase of a user."""
    return mt.throttle_runs(table(spark, d, "events"), "user_id", F.col("event_type") != "purchase", "ts", "event_id").select("event_id", "run")


@query(f"SELECT event_type, round(regr_slope(value, {_TS} / 60.0), 9) AS slope FROM events GROUP BY 1")
def event_slope(spark, d):
    """AGG-21."""
    return _events(spark, d).groupBy("event_type").agg(F.round(mt.slope_per_minute(F.unix_micros("ts") / 1e6, F.col("value")), 9).alias("slope"))


@query(f"""WITH {_TASKS}, s AS (SELECT count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'dead') AS failed, count(*) FILTER (state IN ('pending', 'retry')) AS depth FROM t),
a AS (SELECT 'task.failure_rate' AS name, CASE WHEN done + failed = 0 THEN 'unknown' WHEN failed * 100.0 / (done + failed) >= 30 THEN 'critical' WHEN failed * 100.0 / (done + failed) >= 20 THEN 'warn' ELSE 'ok' END AS level FROM s
UNION ALL SELECT 'queue.depth', CASE WHEN depth >= 200 THEN 'critical' WHEN depth >= 160 THEN 'warn' ELSE 'ok' END FROM s UNION ALL SELECT 'disk.free_pct', 'unknown')
SELECT name, level FROM a UNION ALL SELECT 'worst', arg_max(level, CASE level WHEN 'ok' THEN 0 WHEN 'unknown' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END) FROM a""")
def task_alerts(spark, d):
    """AGG-12, AGG-13."""
    s = tk.ledger_counts(_tasks(spark, d)).crossJoin(_tasks(spark, d).agg(F.count_if(F.col("state").isin(*tk.CLAIMABLE)).alias("depth")))  # one row each
    rows = s.select(F.explode(F.array(
        F.struct(F.lit("task.failure_rate").alias("name"), mt.failure_level(F.col("new"), F.col("failed"), 20.0).alias("level")),
        F.struct(F.lit("queue.depth").alias("name"), mt.usage_level(F.col("depth"), F.lit(200), 80.0).alias("level")),
        F.struct(F.lit("disk.free_pct").alias("name"), mt.usage_level(F.lit(None).cast("double"), F.lit(10.0), 80.0).alias("level")),
    )).alias("a")).select("a.*")
    return rows.union(rows.agg(F.lit("worst"), mt.worst(F.col("level"))))


@query("SELECT CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, d):
    """STM-11 as a tumbling window."""
    x = _events(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select(F.unix_seconds("window.start").alias("hour"), "event_type", "n", "total")


@query(f"""WITH x AS (SELECT user_id, {_TS} AS t, lag({_TS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), y AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, CAST(floor(min(t)) AS BIGINT) AS began, count(*) AS n FROM y GROUP BY user_id, s""")
def event_sessions(spark, d):
    """STM-11 as sessions, six hours apart."""
    x = _events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return x.select("user_id", F.unix_seconds("session_window.start").alias("began"), "n")


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def event_props(spark, d):
    """One number of the events' properties; `json_leaves` flattens whole documents."""
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query(f"WITH {_RECORDS}, p AS (SELECT url_hash, data_json->>'$.published_at' AS p FROM extracted WHERE json_valid(data_json)) SELECT DISTINCT url_hash, round(TRY_CAST(p AS DOUBLE), 3) AS published_at FROM p")
def record_times(spark, d):
    """Publication times as the records have them; `record_normal` has other keys and forms."""
    v = table(spark, d, "extracted").select("url_hash", F.try_parse_json("data_json").alias("v")).filter("v is not null")
    return v.select("url_hash", F.round(F.try_variant_get("v", "$.published_at", "double"), 3).alias("published_at")).distinct()


@query()
def export_lines(spark, d):
    """SRC-16, SET-02: tagged JSON lines of tasks and artifacts."""
    return tk.export("task", _tasks(spark, d).select("task_id", "state", "target")).unionByName(tk.export("artifact", capture.unique(table(spark, d, "raw_artifacts")).select("sha256", "url", "size")))


#: A small robots file for the invented web's hosts.
ROBOTS = "User-agent: *\nDisallow: /media/\nAllow: /media/b*\nDisallow: /*survey*$\nUser-agent: millrace\nUser-agent: other\nDisallow: /forum/\nAllow: /forum/thread/s\n"


@query("""WITH u AS (SELECT DISTINCT normalized_url AS url, lower(regexp_extract(normalized_url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(normalized_url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS path FROM frontier)
SELECT url, NOT (starts_with(path, '/forum/') AND NOT starts_with(path, '/forum/thread/s')) AS allowed FROM u""")
def robots_decisions(spark, d):
    """URL-07, FLT-08, JOIN-04: one robots file for all hosts, agent millrace/1.0."""
    u = table(spark, d, "frontier").select(F.col("normalized_url").alias("url")).distinct()
    u = u.select("url", ur.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^#]*)", 1).alias("path"))
    texts = u.select("host").distinct().withColumn("text", F.lit(ROBOTS))
    return robots.decide(u, robots.parse(texts, "host", "text"), "millrace/1.0").select("url", "allowed")
