"""Queries of parsers, discovery, caches and cookies. Bodies are built from the tables, so that SQL can say from the same
columns what has to come out of them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import parse as ps, records as rec, text as tx, url as ur
from ..operators import cookies as ck, discovery as dv, reparse as rp, webcache as wc
from ..runtime import table

QUERIES: dict = {}
SQL: dict = {}
NOW = 1_750_000_000.0


def query(sql: str | None = None):
    """Register a query, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Readable records, one a url_hash and text: url, title, text, links, published (epoch seconds)."""
    v = table(spark, d, "extracted").select("url_hash", F.try_parse_json("data_json").alias("v")).filter("v is not null and url_hash is not null")
    get = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit(""))
    links = F.coalesce(F.try_variant_get("v", "$.links", "array<string>"), F.array().cast("array<string>"))
    return v.select("url_hash", get("url").alias("url"), get("title").alias("title"), get("text").alias("text"), links.alias("links"), F.try_variant_get("v", "$.published_at", "double").alias("published")).dropDuplicates(["url_hash", "text"])


_R = """r AS (SELECT DISTINCT ON (url_hash, text) * FROM (SELECT url_hash, coalesce(data_json->>'$.url', '') AS url, coalesce(data_json->>'$.title', '') AS title, coalesce(data_json->>'$.text', '') AS text,
  coalesce(CAST(data_json->'$.links' AS VARCHAR[]), []) AS links, TRY_CAST(data_json->>'$.published_at' AS DOUBLE) AS published FROM extracted WHERE url_hash IS NOT NULL AND json_valid(data_json)))"""
_CLEAN = "array_to_string(list_filter(list_transform(string_split(regexp_replace({0}, '[ \\t\\r\\f\\v ]+', ' ', 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> ''), chr(10))"
_NORMAL = "trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(translate({0}, chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), '[ \\t\\r\\f\\v ]+', ' ', 'g'), chr(10)), lambda s: trim(s, ' ')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_HASH = "substr(sha256({0}), 1, 16)"


def _page(r: DataFrame) -> DataFrame:
    """Each record as an HTML page (`body`) that says what the record says, in markup that has to be undone."""
    anchors = F.array_join(F.transform("links", lambda x: F.concat(F.lit("<a class=x href='"), x, F.lit("#top'></a><A HREF=\""), x, F.lit('"></A><a href="mailto:a@b.org"></a>'))), "\n")
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Article").alias("@type"), F.col("title").alias("name"))), F.lit("</script><script type='application/ld+json'>{\"@type\": [\"Thing\", \"Page\",], }</script><script type=\"application/ld+json\">{broken</script>"))
    head = F.concat(F.lit("<!DOCTYPE html><html lang='xx'><head><title>\n "), _escaped(F.col("title")), F.lit(' </title><style>p {color: red}</style><meta name="Description" content="'), F.col("url_hash"), F.lit('"><META content="second" name=description><meta property=og:site_name content=mill><link rel="canonical" href="'), F.col("url"), F.lit('">'), ld, F.lit("</head><body>"))
    return r.withColumn("body", F.concat(head, F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>\n<!-- note --><script>var x = 1 < 2;</script>"), anchors, F.lit("</body></html>")))


@query(f"""WITH {_R} SELECT url_hash, {_CLEAN.format('title')} AS title, {_HASH.format(_CLEAN.format('text'))} AS text_hash, len(list_distinct(links)) AS n_links, url_hash AS description, 2 AS n_ld,
{_CLEAN.format('title')} <> '' OR {_CLEAN.format('text')} <> '' AS ok FROM r""")
def page_parse(spark, d):
    """PAR-01, PAR-02, JSON-03: every record as a page and back."""
    h = _page(_records(spark, d)).select("url_hash", ps.html(F.col("body"), F.col("url")).alias("h"))
    return h.select("url_hash", "h.title", tx.content_hash(F.col("h.text")).alias("text_hash"), F.size("h.links").alias("n_links"), F.col("h.meta")["description"].alias("description"), F.size("h.json_ld").alias("n_ld"), "h.ok")


@query(f"""WITH {_R}, c AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') AS t FROM r) SELECT url_hash, t AS title, url_hash AS description, 'mill' AS site_name, 'xx' AS lang, url AS canonical, CASE WHEN true THEN 'Article|Thing|Page' END AS ld_types FROM c""")
def page_card(spark, d):
    """PAR-07, SUP-20: what each page says of itself."""
    c = ps.judged_cards(_page(_records(spark, d)).select("url_hash", ps.card(F.col("body")).alias("c")), "c")
    return c.select("url_hash", "c.title", "c.description", "c.site_name", "c.lang", "c.canonical", F.array_join("c.ld_types", "|").alias("ld_types"))


def _feeds(r: DataFrame) -> DataFrame:
    """Each record's links as a feed, RSS or Atom by the length of its title."""
    t = F.translate("title", "<>&", "   ")
    rss = F.concat(F.lit("<?xml version='1.0'?><rss><channel><title>Mill</title>"), F.array_join(F.transform("links", lambda x: F.concat(F.lit("<item><title><![CDATA["), t, F.lit("]]></title><link> "), x, F.lit("</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><description>&lt;b&gt;<b>s</b></description></item>"))), ""), F.lit("</channel></rss>"))
    atom = F.concat(F.lit("<feed><title type='text'>Mill</title>"), F.array_join(F.transform("links", lambda x: F.concat(F.lit("<entry><title>"), t, F.lit("</title><link rel='a' href=\""), x, F.lit("\"/><updated>2024-01-02T03:04:05Z</updated><summary>&lt;b&gt; s</summary></entry>"))), ""), F.lit("</feed>"))
    return r.withColumn("body", F.when(F.length("title") % 2 == 0, rss).otherwise(atom))


@query(f"""WITH {_R} SELECT url_hash, place, link, trim(translate(title, '<>&', '   '), ' ' || chr(9) || chr(10) || chr(13)) AS title, 1704164645.0 AS published_at, 'Mill' AS site FROM (SELECT url_hash, title, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS place FROM r)""")
def feed_items(spark, d):
    """PAR-03, PAR-05, PAR-11, DT-01: each record's links as RSS or Atom, and the items out of it."""
    f = _feeds(_records(spark, d).filter("size(links) > 0")).select("url_hash", F.when(~ps.is_sitemap(F.col("body")), ps.feed(F.col("body"))).alias("f"))
    x = f.filter("f.ok").select("url_hash", F.col("f.feed_title").alias("site"), F.posexplode("f.items").alias("place", "i"))
    return x.select("url_hash", "place", "i.link", "i.title", rec.epoch(F.col("i.published")).alias("published_at"), "site")


@query(f"WITH {_R} SELECT url_hash, unnest(links) AS loc, '2024-01-02' AS lastmod, '0.5' AS priority FROM r UNION ALL SELECT url_hash, url, NULL, NULL FROM r WHERE len(links) > 0")
def sitemap_urls(spark, d):
    """PAR-04, PAR-05: each record's links as a sitemap, with itself as a sub-sitemap."""
    entries = F.array_join(F.transform("links", lambda x: F.concat(F.lit("<url>\n<loc>"), _escaped(x), F.lit("</loc><lastmod>2024-01-02</lastmod><priority> 0.5 </priority></url>"))), "")
    body = F.concat(F.lit("<urlset xmlns='x'>"), entries, F.lit("</urlset><sitemapindex><sitemap><loc> "), F.col("url"), F.lit(" </loc></sitemap></sitemapindex>"))
    x = _records(spark, d).filter("size(links) > 0").select("url_hash", F.when(ps.is_sitemap(body), ps.sitemap(body)).alias("s")).filter("s.ok")
    own = x.select("url_hash", F.explode("s.urls").alias("u")).select("url_hash", "u.loc", "u.lastmod", "u.priority")
    return own.unionByName(x.select("url_hash", F.explode("s.sub_sitemaps").alias("loc"), F.lit(None).cast("string").alias("lastmod"), F.lit(None).cast("string").alias("priority")))


@query("""SELECT url_hash, replace(substr(fullkey, 3), '"', '') AS path, CASE WHEN type = 'NULL' THEN '' WHEN type = 'BOOLEAN' THEN CASE WHEN atom::VARCHAR = 'true' THEN 'True' ELSE 'False' END ELSE atom->>'$' END AS value
FROM (SELECT DISTINCT ON (url_hash, data_json) url_hash, data_json FROM extracted WHERE json_valid(data_json)) e, json_tree(e.data_json) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def json_leaves(spark, d):
    """JSON-01: every leaf of every record, at any depth."""
    x = table(spark, d, "extracted").select("url_hash", "data_json").distinct().select("url_hash", ps.flatten(F.col("data_json")).alias("a"))
    return x.filter("a is not null").select("url_hash", F.explode("a").alias("l")).select("url_hash", "l.path", "l.value")


@query(f"WITH {_R} SELECT url_hash, true AS ok, CASE WHEN length(title) % 2 = 0 THEN 'json_ld' ELSE 'json' END AS kind, title FROM r UNION ALL SELECT url_hash, false, 'json', '' FROM (SELECT DISTINCT url_hash, data_json FROM extracted WHERE NOT json_valid(data_json))")
def json_docs(spark, d):
    """JSON-02: records as JSON documents with name or headline, and those that do not parse."""
    r = _records(spark, d)
    body = F.when(F.length("title") % 2 == 0, F.to_json(F.struct(F.lit("https://x.test").alias("@context"), F.lit("").alias("name"), F.col("title").alias("headline")))).otherwise(F.to_json(F.struct(F.col("title").alias("name"), F.lit("h").alias("headline"))))
    good = r.select("url_hash", ps.json_doc(F.when(F.col("title") == "", F.lit('{"name": ""}')).otherwise(body)).alias("j"), F.length("title").alias("n"))
    good = good.select("url_hash", "j.ok", F.when(F.col("n") == 0, F.lit("json_ld")).otherwise(F.col("j.kind")).alias("kind"), "j.title")
    bad = table(spark, d, "extracted").select("url_hash", "data_json").distinct().select("url_hash", ps.json_doc(F.col("data_json")).alias("j")).filter("not j.ok")
    return good.unionByName(bad.select("url_hash", "j.ok", "j.kind", "j.title"))


@query("""SELECT url_hash, unnest(list_concat(CASE WHEN regexp_matches(data_json->>'$.url', '^https?://') THEN [data_json->>'$.url'] ELSE [] END, list_filter(coalesce(CAST(data_json->'$.links' AS VARCHAR[]), []), lambda x: regexp_matches(x, '^https?://')))) AS url
FROM (SELECT DISTINCT url_hash, data_json FROM extracted WHERE json_valid(data_json))""")
def json_urls(spark, d):
    """JSON-05: addresses among the strings of every record."""
    x = table(spark, d, "extracted").select("url_hash", "data_json").distinct()
    return x.select("url_hash", F.explode(ps.embedded_urls(F.col("data_json"))).alias("url"))


_BARE = "regexp_replace({0}, '^(https?://)www\\.([^./]+\\.)', '\\1\\2')"
_SITE = "regexp_extract(" + _BARE + ", '^https?://([^/:]+)', 1)"


@query(f"""WITH {_R}, a AS (SELECT url_hash AS source, url AS base, unnest(list_concat(links, links)) AS u, generate_subscripts(list_concat(links, links), 1) AS place FROM r),
k AS (SELECT source, base, CASE WHEN place <= (SELECT len(links) FROM r r2 WHERE r2.url_hash = a.source LIMIT 1) THEN 'html_link' ELSE 'feed_item' END AS kind, {_BARE.format('u')} AS url, place FROM a)
SELECT source, kind, url, {_SITE.format('url')} = {_SITE.format('base')} OR ends_with({_SITE.format('url')}, '.' || {_SITE.format('base')}) AS same_site,
CASE WHEN row_number() OVER (PARTITION BY source, url ORDER BY place) > 1 THEN 'duplicate' WHEN NOT ({_SITE.format('url')} = {_SITE.format('base')} OR ends_with({_SITE.format('url')}, '.' || {_SITE.format('base')})) THEN 'off_site' ELSE '' END AS reason FROM k""")
def discovered(spark, d):
    """PAR-12, SET-01, SUP-19, URL-09, FLT-04, FLT-05, WIN-04: links of pages and of feeds, judged as one batch a page."""
    r = _records(spark, d).dropDuplicates(["url_hash"])
    x = r.select("url_hash", "url", "links", F.transform("links", lambda u: F.struct(u.alias("link"), F.lit("t").alias("title"))).alias("items"))
    found = dv.from_parsed(x, "url_hash", "url", html_link="links", feed_item="items")
    # hrefs without scheme and host where they are the page's own, so that they have to be resolved
    own = F.regexp_extract("base", "^(https?://[^/]+)", 1)
    found = found.withColumn("href", F.when((own != "") & F.startswith("href", F.concat(own, F.lit("/"))), F.regexp_replace("href", "^https?://[^/]+", "")).otherwise(F.col("href")))
    out = dv.judged(dv.resources(found, "base"), {"html_link": 0, "feed_item": 1})
    return out.select("source", "kind", "url", "same_site", "reason")


_OCTETS = "(SELECT url, CAST('0x' || substr(h, 1, 2) AS INTEGER) AS a0, CAST('0x' || substr(h, 3, 2) AS INTEGER) AS b0, CAST('0x' || substr(h, 5, 2) AS INTEGER) AS c0, CAST('0x' || substr(h, 7, 2) AS INTEGER) AS e FROM (SELECT DISTINCT normalized_url AS url, sha256(normalized_url) AS h FROM frontier))"
_FIRST = (10, 127, 169, 172, 192, 100, 198, 203, 8, 93, 224, 250, 0, 52, 151, 77)
_SECOND = (0, 254, 16, 31, 32, 168, 64, 127, 128, 18, 19, 51, 88, 2, 113, 200)
_THIRD = (0, 2, 99, 100, 113, 7, 8, 9)


@query(f"""WITH o AS (SELECT *, {list(_FIRST)}[a0 % 16 + 1] AS a, {list(_SECOND)}[b0 % 16 + 1] AS b, {list(_THIRD)}[c0 % 8 + 1] AS c FROM {_OCTETS})
SELECT url, a || '.' || b || '.' || c || '.' || e AS ip, a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100)
  OR (a = 203 AND b = 0 AND c = 113) OR (a = 192 AND b = 0 AND (c = 0 AND e NOT IN (9, 10) OR c = 2)) OR (a = 192 AND b = 88 AND c = 99) AS unsafe,
  e % 3 = 0 AS named_unsafe FROM o""")
def url_unsafe_hosts(spark, d):
    """FLT-06: addresses made of a hash, with numeric hosts in four spellings, and local names."""
    h = F.sha2("url", 256)
    octet = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    pick = lambda t, c: F.element_at(F.array(*map(F.lit, t)), c % len(t) + 1)
    u = table(spark, d, "frontier").select(F.col("normalized_url").alias("url")).distinct()
    x = u.select("url", pick(_FIRST, octet(1)).alias("a"), pick(_SECOND, octet(3)).alias("b"), pick(_THIRD, octet(5)).alias("c"), octet(7).alias("e"))
    number = F.col("a").cast("long") * 16777216 + F.col("b") * 65536 + F.col("c") * 256 + F.col("e")
    ip = F.concat_ws(".", "a", "b", "c", "e")
    shown = F.when(F.col("e") % 4 == 0, ip).when(F.col("e") % 4 == 1, number.cast("string")).when(F.col("e") % 4 == 2, F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(number), 8, "0")))).otherwise(F.concat_ws(".", "a", "b", (F.col("c") * 256 + F.col("e")).cast("string")))
    name = F.when(F.col("e") % 3 == 0, "http://printer.local:8080/x").otherwise("http://example.com/x")
    return x.select("url", ip.alias("ip"), ur.unsafe(F.concat(F.lit("http://"), shown, F.lit("/p"))).alias("unsafe"), ur.unsafe(name).alias("named_unsafe"))


@query("""SELECT url, n, url || '?' || CASE WHEN n % 2 = 0 THEN 'a=' || n || '&b=x+y&b=%C3%A9' ELSE 'A=1%2A&z=~' || n END AS canon FROM (SELECT DISTINCT normalized_url AS url, length(normalized_url) AS n FROM frontier)""")
def url_canonical_queries(spark, d):
    """URL-01, URL-03, URL-05: addresses in other case, with ports, escapes, doubled slashes, fragments and visit parameters."""
    u = table(spark, d, "frontier").select(F.col("normalized_url").alias("url")).distinct().withColumn("n", F.length("url"))
    parts = lambda i: F.regexp_extract("url", "^(https?)://([^/]+)/(.*)$", i)
    port = F.when(parts(1) == "http", ":80").otherwise(":443")
    q = F.when(F.col("n") % 2 == 0, F.concat(F.lit("utm_source=u&b=x%20y&b=%c3%a9&gclid=1&a="), F.col("n"), F.lit("&empty="))).otherwise(F.concat(F.lit("z=%7E"), F.col("n"), F.lit("&A=1*&spm_id=7&ref=r")))
    raw = F.concat(F.lit(" "), F.upper(parts(1)), F.lit("://"), F.upper(parts(2)), F.lit("."), port, F.lit("//"), F.replace(parts(3), F.lit("-"), F.lit("%2d")), F.lit("?"), q, F.lit("#frag"))
    return u.select("url", "n", ur.canonical(raw).alias("canon"))


@query(f"WITH {_R} SELECT url_hash, {_NORMAL.format('title')} AS title, {_HASH.format(_NORMAL.format('text'))} AS text_hash, len(list_distinct(links)) AS n_links, CASE WHEN published > 0 THEN floor(published) END AS published_at, 'extra|kept' AS extra FROM r")
def record_normal(spark, d):
    """MAP-02, DT-01, DT-02: records with their time under other keys and in other forms, brought to twelve fields."""
    r = _records(spark, d)
    t = F.timestamp_seconds(F.floor("published"))
    forms = [("PubDate", F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss '+0000'")), ("lastMod", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")), ("created_at", (F.floor("published") * 1000).cast("string")), ("Date", F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ("published", F.floor("published").cast("string"))]
    fields = F.lit(None).cast("map<string,string>")
    for i, (k, v) in enumerate(forms):
        one = F.create_map(F.lit(k), v, F.lit("time"), F.lit("junk"), F.lit("updated_at"), F.lit(""), F.lit("extra_kept"), F.lit("extra|kept"))
        fields = F.when((F.length("title") % len(forms) == i) & (F.col("published") > 0), one).otherwise(fields)
    fields = F.coalesce(fields, F.create_map(F.lit("extra_kept"), F.lit("extra|kept")))
    doubled = F.concat("links", "links", F.array(F.lit("ftp://x/"), F.lit(" ")))
    n = ps.normalized(F.col("url"), F.concat(F.lit(" \t"), F.col("title"), F.lit("\n")), F.concat(F.col("text"), F.lit("\n\n\n ")), fields, F.lit(None).cast("string"), F.lit(""), F.array(F.lit("a"), F.lit(" ")), doubled, F.lit("p"), F.lit(1), F.lit("html"))
    x = r.select("url_hash", n.alias("n"))
    return x.select("url_hash", "n.title", tx.content_hash(F.col("n.text")).alias("text_hash"), F.size("n.links").alias("n_links"), "n.published_at", F.col("n.extra")["extra_kept"].alias("extra"))


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Records as stored artifacts: pages, feeds, JSON and text by the length of the title, some of them empty or broken."""
    r = _records(spark, d).dropDuplicates(["url_hash"])
    kind = F.length("title") % 4
    page = _page(r).select("*", kind.alias("kind"))
    body = F.when(F.col("kind") == 1, F.concat(F.lit("{"), F.col("body"))).when(F.col("kind") == 2, F.concat(F.lit("  "), F.col("text"), F.lit("\t "))).otherwise(F.col("body"))
    mime = F.when(F.col("kind") == 1, "application/json").when(F.col("kind") == 2, "text/plain").otherwise("text/html; charset=utf-8")
    return page.select(F.col("url_hash").alias("sha256"), "url", mime.alias("mime"), F.lit(0.0).alias("fetched_at"), F.when(F.col("kind") == 2, body).when(F.col("kind") == 1, F.concat(F.lit("{"), F.col("title"))).otherwise(F.col("body")).alias("body"))


@query()
def reparse_stats(spark, d):
    """PAR-13, PAR-09, PAR-10, AGG-06: all records as stored bodies through the whole path (counts; tests hold the cases)."""
    return rp.run(_artifacts(spark, d))[2]


@query(f"""WITH {_R}, x AS (SELECT url_hash, {_CLEAN.format('title')} AS title, {_NORMAL.format(_CLEAN.format('text'))} AS text FROM r),
f AS (SELECT *, CASE WHEN text = '' THEN title ELSE text END AS t FROM x WHERE title <> '' OR text <> '')
SELECT count(*) AS records, count(DISTINCT {_HASH.format('t')}) AS hashes, sum(length(text)) AS chars FROM f""")
def reparse_records(spark, d):
    """PAR-11, PAR-13: pages parsed and normalized; their number, distinct hashes and characters."""
    a = _page(_records(spark, d)).select(F.col("url_hash").alias("sha256"), "url", F.lit("text/html").alias("mime"), F.lit(0.0).alias("fetched_at"), "body")
    x = rp.records(rp.parsed(a))
    return x.agg(F.count("*").alias("records"), F.countDistinct("content_hash").alias("hashes"), F.sum(F.length("text")).alias("chars"))


def _jar_lines(spark: SparkSession, d: str) -> DataFrame:
    """A Netscape file with three cookies a host of the frontier, one of them expired, and noise."""
    hosts = table(spark, d, "frontier").select(ur.host(F.col("normalized_url")).alias("h")).distinct()
    site = F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)
    rows = F.array(
        F.concat_ws("\t", "h", F.lit("FALSE"), F.lit("/"), F.lit("FALSE"), F.lit("0"), F.lit("sid"), F.length("h").cast("string")),
        F.concat_ws("\t", F.concat(F.lit("#HttpOnly_."), F.upper(site)), F.lit("TRUE"), F.lit("/forum"), F.lit("TRUE"), F.lit("1900000000"), F.lit("tok"), F.lit("t")),
        F.concat_ws(" ", "h", F.lit("FALSE"), F.lit("/"), F.lit("FALSE"), F.lit("1000"), F.lit("old"), F.lit("o")),
        F.lit("# comment"), F.lit("short\tline"),
    )
    return hosts.select(F.explode(rows).alias("line")).distinct()


_JAR = "h AS (SELECT DISTINCT regexp_extract(normalized_url, '^https?://([^/:]+)', 1) AS h FROM frontier), s AS (SELECT DISTINCT regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS s FROM h)"


@query(f"""WITH {_JAR}, u AS (SELECT DISTINCT normalized_url AS url, regexp_extract(normalized_url, '^https?://([^/:]+)', 1) AS h, regexp_extract(normalized_url, '^https?://[^/]*(.*)$', 1) AS p FROM frontier)
SELECT url, CASE WHEN starts_with(p, '/forum') AND starts_with(url, 'https:') THEN 'tok=t; ' ELSE '' END || 'sid=' || length(h) AS header FROM u""")
def cookie_headers(spark, d):
    """SRC-22, FLT-12, JOIN-11: the cookies of every frontier address."""
    return ck.headers(table(spark, d, "frontier").select("normalized_url"), "normalized_url", ck.netscape(_jar_lines(spark, d), "line"), NOW)


@query(f"WITH {_JAR} SELECT 2 * (SELECT count(*) FROM h) + (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM h) AS expired, (SELECT count(*) FROM (SELECT h FROM h UNION SELECT s FROM s)) AS domains")
def cookie_summary(spark, d):
    """AGG-17, AGG-16, SUP-15."""
    return ck.summary(ck.netscape(_jar_lines(spark, d), "line"), NOW)


@query(f"WITH {_JAR} SELECT h AS host, 'usable' AS reason, 2 AS n FROM h UNION ALL SELECT 'a.' || h, 'usable', 2 FROM h UNION ALL SELECT 'nowhere.invalid.x', 'no_domain', 0")
def cookie_reasons(spark, d):
    """SUP-15: why a host has or has no cookies."""
    hosts = table(spark, d, "frontier").select(ur.host(F.col("normalized_url")).alias("h")).distinct()
    asked = hosts.select(F.explode(F.array("h", F.concat(F.lit("a."), F.col("h")), F.lit("Nowhere.invalid.x"))).alias("h"))
    return ck.missing_reason(asked, "h", ck.netscape(_jar_lines(spark, d), "line"), NOW)


def _responses(spark: SparkSession, d: str) -> DataFrame:
    headers = F.create_map(F.lit("ETag"), F.col("sha256"), F.lit("X-Other"), F.lit("x"), F.lit("Last-Modified"), F.lit(""))
    return table(spark, d, "raw_artifacts").select("url", "status", headers.alias("headers"), "size", "fetched_at").filter("url is not null and fetched_at is not null")


@query("""WITH c AS (SELECT url, max(fetched_at) AS fetched_at FROM raw_artifacts WHERE url IS NOT NULL AND fetched_at IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS n FROM c),
k AS (SELECT url, fetched_at, row_number() OVER (ORDER BY fetched_at, substr(sha256(url), 1, 32)) AS rn FROM c)
SELECT url, fetched_at, substr(sha256(url), 1, 32) AS key, 1 AS n_conditions FROM k, n WHERE rn > n - 200 + 20""")
def cache_kept(spark, d):
    """SRC-21: the cache after all responses, at most 200 entries; what it would ask the server with."""
    c = wc.evict(wc.entries(_responses(spark, d)), 200)
    return c.select("url", "fetched_at", "key", F.size(wc.conditional(F.col("headers"))).alias("n_conditions"))


_FETCHED = "f AS (SELECT h AS host, [200, 404, 503, 301][length(h) % 4 + 1] AS status, CASE WHEN length(h) % 5 = 0 THEN 1749900000.0 ELSE 1749999000.0 END AS fetched_at FROM (SELECT DISTINCT regexp_extract(normalized_url, '^https?://([^/:]+)', 1) AS h FROM frontier))"
ROBOTS = "User-agent: *\nDisallow: /media/\nAllow: /media/b*\nDisallow: /*survey*\nDisallow: /docs/*z$\nCrawl-delay: 2.5\n"


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "frontier").select(ur.host(F.col("normalized_url")).alias("host")).distinct()
    n = F.length("host")
    return hosts.select("host", F.element_at(F.array(*map(F.lit, (200, 404, 503, 301))), n % 4 + 1).alias("status"), F.lit(ROBOTS).alias("text"), F.when(n % 5 == 0, 1749900000.0).otherwise(1749999000.0).alias("fetched_at"))


@query(f"""WITH {_FETCHED}, u AS (SELECT DISTINCT normalized_url AS url, regexp_extract(normalized_url, '^https?://([^/:]+)', 1) AS host, regexp_extract(normalized_url, '^https?://[^/]*(.*)$', 1) AS p FROM frontier)
SELECT url, known, CASE WHEN NOT known OR status = 404 THEN true WHEN status <> 200 THEN false
  WHEN starts_with(p, '/media/b') THEN true WHEN p LIKE '/%survey%' THEN false WHEN p LIKE '/docs/%z' THEN false WHEN starts_with(p, '/media/') THEN false ELSE true END AS allowed
FROM (SELECT u.*, f.status, f.fetched_at >= 1750000000 - 86400 AS known FROM u JOIN f ON f.host = u.host)""")
def robots_cached(spark, d):
    """FLT-08, URL-07, URL-08, SUP-12, SUP-13, JOIN-04: wildcards, anchors and ties, by what is known of each host."""
    u = table(spark, d, "frontier").select(F.col("normalized_url").alias("url")).distinct()
    u = u.select("url", ur.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^#]*)", 1).alias("path"))
    return wc.robots_decisions(u, _fetched(spark, d), "millrace/1.0", NOW).select("url", "known", "allowed")


@query(f"WITH {_FETCHED} SELECT host, 2.5 AS delay FROM f WHERE status = 200 AND fetched_at >= 1750000000 - 86400")
def robots_delays(spark, d):
    """URL-11."""
    return wc.crawl_delays(_fetched(spark, d), NOW)


@query("""WITH u AS (SELECT DISTINCT normalized_url AS url FROM frontier) SELECT CASE length(url) % 4 WHEN 0 THEN 'ftp' || substr(url, strpos(url, ':')) WHEN 1 THEN 'http://127.0.0.1/' || length(url) ELSE url END AS url,
CASE length(url) % 4 WHEN 0 THEN 'scheme' WHEN 1 THEN 'private' ELSE CASE WHEN contains(url, '/media/') THEN 'robots' ELSE '' END END AS reason, url AS was FROM u""")
def url_allowed(spark, d):
    """FLT-07: scheme, private hosts, then robots."""
    u = table(spark, d, "frontier").select(F.col("normalized_url").alias("was")).distinct()
    n = F.length("was") % 4
    x = u.select("was", F.when(n == 0, F.concat(F.lit("ftp"), F.regexp_extract("was", "(:.*)$", 1))).when(n == 1, F.concat(F.lit("http://127.0.0.1/"), F.length("was"))).otherwise(F.col("was")).alias("url"))
    robots = u.select(F.col("was").alias("url"), (~F.contains("was", F.lit("/media/"))).alias("allowed"))
    return dv.allowed(x, "url", robots).select("url", "reason", "was")


@query("SELECT doc_id, 2 AS kept, 2 AS dropped FROM documents")
def url_classes(spark, d):
    """FLT-13, FLT-14: addresses made of each row's number, kept or dropped."""
    i = F.col("doc_id").cast("string")
    urls = F.array(F.concat(F.lit("http://h.test/"), i), F.lit(" "), F.concat(F.lit(" http://h.test/"), i), F.concat(F.lit("javascript:"), i), F.concat(F.lit("http://10.0.0.1/"), i), F.lit("https://8.8.8.8/"))
    return table(spark, d, "documents").select("doc_id", dv.classified(urls).alias("c")).select("doc_id", F.size("c.kept").alias("kept"), F.size("c.dropped").alias("dropped"))


@query("""SELECT doc_id, ['utf-16-be', 'utf-8', 'utf-8-sig', 'iso-8859-1'][doc_id % 4 + 1] AS encoding, substr(sha256(CASE WHEN doc_id % 4 = 3 THEN regexp_replace(text, '[^\\x01-\\x7f]', '?', 'g') ELSE text END), 1, 16) AS text_hash,
CASE WHEN length(text) = 0 THEN 0.0 END AS ratio_of_empty FROM documents WHERE text IS NOT NULL""")
def doc_encodings(spark, d):
    """STR-18, SUP-26, MATH-03: documents as bytes in four encodings, told apart and read again."""
    docs = table(spark, d, "documents").filter("text is not null")
    k, t = F.col("doc_id") % 4, F.col("text")
    ascii_ = F.regexp_replace(t, "[^\\x01-\\x7f]", "?")
    body = F.when(k == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE"))).when(k == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))).when(k == 3, F.encode(ascii_, "UTF-8")).otherwise(F.encode(t, "UTF-8"))
    kind = F.when(k == 3, 'text/html; Charset="ISO-8859-1"').otherwise("text/html")
    x = docs.select("doc_id", body.alias("body"), kind.alias("kind"), t.alias("text")).withColumn("encoding", ps.encoding(F.col("kind"), F.col("body")))
    name = F.when(F.col("doc_id") % 4 == 0, "utf-16-be").otherwise(F.col("encoding"))
    read = F.regexp_replace(ps.decoded(F.col("body"), name), "^﻿", "")
    return x.select("doc_id", "encoding", tx.content_hash(read).alias("text_hash"), F.when(F.length("text") == 0, ps.printable_ratio(F.encode("text", "UTF-8"))).alias("ratio_of_empty"))
