"""Queries of this folder, and their SQL."""

from .batch_dedup import p3_found
from .bpe import p8_ids, p8_text
from .leaks import p9_found, p9_report
from .lookalikes import p10_found
from .main_text import p5_found
from .near_dups import p7_found
from .residue import p1_found

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p5_found": p5_found, "p7_found": p7_found, "p8_ids": p8_ids, "p8_text": p8_text, "p9_found": p9_found, "p9_report": p9_report, "p10_found": p10_found}

#: Readable texts with their token runs of three, each run once.
_RUNS = """texts AS (SELECT DISTINCT url_hash, coalesce(data_json->>'$.text', '') AS text FROM extracted WHERE url_hash IS NOT NULL AND json_valid(data_json)),
tok AS (SELECT url_hash, text, list_concat(regexp_extract_all(lower(text), '[a-z0-9_]+'), flatten(list_transform(regexp_extract_all(text, '[一-鿿]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))) AS t FROM texts),
sets AS (SELECT url_hash, text, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS s FROM tok),
runs AS (SELECT url_hash, text, len(s) AS n, unnest(s) AS g FROM sets)"""
_BIG = "(SELECT DISTINCT url_hash FROM pages WHERE size >= 500 AND url_hash IS NOT NULL)"

SQL = {
    "p3_found": f"""WITH {_RUNS}, big AS (SELECT DISTINCT url_hash, batch_no, lower(trim(content_hash)) AS ch, simhash & 9223372036854775807 AS sim FROM pages WHERE size >= 500 AND url_hash IS NOT NULL AND batch_no IS NOT NULL),
near AS (SELECT DISTINCT a.url_hash AS a, b.url_hash AS b FROM big a JOIN big b ON a.url_hash <> b.url_hash AND b.batch_no < a.batch_no AND bit_count(xor(a.sim, b.sim)) <= 3)
SELECT a.url_hash FROM big a JOIN big b ON a.ch = b.ch AND a.url_hash <> b.url_hash AND b.batch_no < a.batch_no
UNION
SELECT a FROM (SELECT p.a, p.b, x.text, y.text, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS ratio FROM near p JOIN runs x ON x.url_hash = p.a JOIN runs y ON y.url_hash = p.b AND y.g = x.g GROUP BY p.a, p.b, x.text, y.text) WHERE ratio >= 0.65""",
    "p7_found": f"""WITH {_RUNS}, r AS (SELECT * FROM runs WHERE url_hash IN {_BIG})
SELECT DISTINCT a AS url_hash_a, b AS url_hash_b FROM (SELECT x.url_hash AS a, y.url_hash AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS ratio FROM r x JOIN r y ON y.g = x.g AND x.url_hash < y.url_hash GROUP BY x.url_hash, y.url_hash, x.text, y.text) WHERE ratio >= 0.65""",
    "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
