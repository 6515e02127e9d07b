"""Parsers as column builders: markup, feeds, sitemaps, JSON, text, cards, playlists; one struct a parser.

Every parser gives a struct with `ok` and `error` ('' if ok) beside its own fields; a null body is not ok. Caps of the
engine are parameters; None, the default, keeps everything.
"""

from __future__ import annotations

import html as _html
import json
import struct
import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .records import epoch
from .text import clean, clean_html_text
from .url import resolve, unsafe_one

#: Keys that may hold a publication time, in this order.
TIME_KEYS = ("published_at", "updated_at", "created_at", "pubdate", "published", "lastmod", "date", "datetime", "time")
#: The fields of a normalized record.
FIELDS = ("url", "title", "text", "published_at", "author", "site", "tags", "links", "parser", "parser_version", "format", "extra")
_DTD = "(?i)<!(?:DOCTYPE|ENTITY)"


def _some(c: Column) -> Column:
    """Null for ''; not `nullif`, whose shared expression keeps a UDF above it from being taken out."""
    return F.when(c != "", c)


def _most(a: Column, n: int | None) -> Column:
    return a if n is None else F.slice(a, 1, n)


def _cut(c: Column, n: int | None) -> Column:
    return c if n is None else F.substring(c, 1, n)


@F.pandas_udf(T.StringType())
def _entities_udf(t: pd.Series) -> pd.Series:
    return t.map(lambda x: _html.unescape(x) if isinstance(x, str) else None)


def entities(c: Column) -> Column:
    """Character references decoded; text without & stays in the JVM."""
    return F.when(F.contains(c, F.lit("&")), _entities_udf(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def attribute(tag: Column, name: str) -> Column:
    """SUP-20: the value of an attribute of a tag, quoted or not; '' without it."""
    quoted = F.regexp_extract(tag, rf"(?is)(?:^|[\s\"'/]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    return F.trim(F.regexp_replace(F.regexp_extract(quoted, r"(?s)=\s*(.*)$", 1), r"^[\"']|[\"']$", ""))


def meta(page: Column) -> Column:
    """Names (or properties) of meta tags, lower-cased, with their contents; the first of a name that is not empty counts."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1))
    name = lambda t: F.lower(F.when(attribute(t, "property") != "", attribute(t, "property")).otherwise(attribute(t, "name")))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(name(t).alias("key"), attribute(t, "content").alias("value"))), lambda p: (p["key"] != "") & (p["value"] != ""))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["key"] == k)[0]))


def links(page: Column, base: Column, most: int | None = None) -> Column:
    """PAR-02: distinct http addresses of anchors in order, seen from base, without fragments."""
    raw = F.transform(F.regexp_extract_all(page, F.lit(r"(?i)<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: F.trim(x))
    kept = F.filter(raw, lambda x: (x != "") & ~x.rlike("^(?:#|javascript:|mailto:|tel:)"))
    seen = _absolute(kept, base)
    return _most(F.array_distinct(F.filter(seen, lambda x: x.rlike("^https?://"))), most)


def _absolute(hrefs: Column, base: Column) -> Column:
    """`resolve` for arrays: an array without dot segments stays in the JVM."""
    b = F.regexp_replace(F.coalesce(F.trim(base), F.lit("")), "#.*$", "")
    origin, road = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(b, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(road == "", "/").otherwise(F.regexp_replace(road, "[^/]*$", ""))

    def one(x: Column) -> Column:
        h = F.regexp_replace(x, "#.*$", "")
        return (
            F.when((origin == "") | h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h == "", b).when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(origin, "^([^/]*)", 1), h))
            .when(F.startswith(h, F.lit("/")), F.concat(origin, h)).when(F.startswith(h, F.lit("?")), F.concat(origin, road, h)).otherwise(F.concat(origin, folder, h))
        )

    dots = F.exists(hrefs, lambda x: x.rlike(r"(?:^|/)\.{1,2}(?:/|$|\?)") & ~x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    hard = _absolute_udf(F.when(dots, hrefs), F.when(dots, b))
    return F.when(dots & (origin != ""), hard).otherwise(F.transform(hrefs, one))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _absolute_udf(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    from urllib.parse import urldefrag, urljoin

    def one(hs, b):
        out = []
        for h in hs:
            try:
                out.append(urldefrag(urljoin(b or "", h))[0])
            except ValueError:
                continue
        return out

    return pd.Series([None if hs is None else one(hs, b) for hs, b in zip(hrefs, base)])


def json_ld(page: Column) -> Column:
    """JSON-03: the JSON-LD blocks that parse, as JSON text, after a trailing comma is mended; others are skipped."""
    raw = F.regexp_extract_all(page, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    mended = lambda x: F.regexp_replace(x, r",\s*([}\]])", "$1")
    good = F.transform(raw, lambda x: F.when(F.try_parse_json(F.trim(x)).isNotNull(), F.trim(x)).when(F.try_parse_json(mended(x)).isNotNull(), F.trim(mended(x))))
    return F.filter(good, lambda x: x.isNotNull())


def html(page: Column, url: Column, most_links: int | None = None) -> Column:
    """PAR-01: title, text, links, meta and JSON-LD of a page by regular expressions; not ok without title and text."""
    title = clean_html_text(entities(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style|noscript|title)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    text = clean_html_text(entities(bare))
    empty = page.isNull() | ((title == "") & (text == ""))
    return F.struct((~empty).alias("ok"), F.when(empty, "no title and no text").otherwise("").alias("error"), title.alias("title"), text.alias("text"), links(page, url, most_links).alias("links"), meta(page).alias("meta"), json_ld(page).alias("json_ld"))


def _tag(block: Column, names: str) -> Column:
    """Text of the first such element of a block, CDATA or not, without markup."""
    raw = F.regexp_extract(block, rf"(?is)<(?:\w+:)?(?:{names})\b[^>]*>(.*?)</(?:\w+:)?(?:{names})>", 1)
    data = F.regexp_extract(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)
    return F.trim(F.regexp_replace(F.when(data != "", data).otherwise(raw), r"<[^>]+>", " "), F.lit(" \t\r\n"))


def _either(block: Column, *names: str) -> Column:
    found = [_some(_tag(block, n)) for n in names]
    return F.coalesce(*found, F.lit(""))


def feed(body: Column, most: int | None = None) -> Column:
    """PAR-03: the feed's title and its items; not ok with a DTD or without items."""
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<(item|entry)\b[^>]*>(.*?)</\1>"), F.lit(2))
    href = lambda x: F.regexp_extract(x, r"(?is)<link\b[^>]*href\s*=\s*[\"']([^\"']+)", 1)
    item = lambda x: F.struct(_tag(x, "title").alias("title"), F.coalesce(_some(_tag(x, "link")), href(x)).alias("link"), _either(x, "pubDate", "updated", "published").alias("published"), _either(x, "description", "summary", "content").alias("summary"))
    danger = F.substring(body, 1, 4096).rlike(_DTD)
    why = F.when(body.isNull(), "no body").when(danger, "DTD").when(F.size(blocks) == 0, "no items").otherwise("")
    return F.struct((why == "").alias("ok"), why.alias("error"), _tag(body, "title").alias("feed_title"), F.when(why == "", F.transform(_most(blocks, most), item)).alias("items"))


def sitemap(body: Column, most: int | None = None) -> Column:
    """PAR-04: addresses of a sitemap (loc, lastmod, changefreq, priority) and sub-sitemaps of an index."""
    decoded = lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))
    entry = lambda x: F.struct(decoded(_tag(x, "loc")).alias("loc"), _tag(x, "lastmod").alias("lastmod"), _tag(x, "changefreq").alias("changefreq"), _tag(x, "priority").alias("priority"))
    urls = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1)), entry), lambda x: x["loc"] != "")
    subs = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<sitemap\b[^>]*>(.*?)</sitemap>"), F.lit(1)), lambda x: decoded(_tag(x, "loc"))), lambda x: x != "")
    danger = F.substring(body, 1, 4096).rlike(_DTD)
    why = F.when(body.isNull(), "no body").when(danger, "DTD").when((F.size(urls) == 0) & (F.size(subs) == 0), "no entries").otherwise("")
    return F.struct((why == "").alias("ok"), why.alias("error"), F.when(why == "", _most(urls, most)).alias("urls"), F.when(why == "", _most(subs, most)).alias("sub_sitemaps"))


def is_sitemap(body: Column) -> Column:
    """PAR-05: which of the two a body is, by its first 4096 characters."""
    return F.lower(F.substring(body, 1, 4096)).rlike("<(?:urlset|sitemapindex)")


def plain_text(body: Column, most: int | None = None) -> Column:
    """PAR-06: the text with blanks collapsed, and its lines; not ok if nothing is left."""
    t = F.trim(F.regexp_replace(body, r"[ \t\r\f\x0B]+", " "), F.lit(" \n"))
    empty = body.isNull() | (t == "")
    return F.struct((~empty).alias("ok"), F.when(empty, "empty").otherwise("").alias("error"), _cut(t, most).alias("text"), F.length(t).alias("text_length"), F.when(empty, 0).otherwise(F.regexp_count(t, F.lit("\n")) + 1).alias("lines"))


def _leaves(text: str | None, depth: int | None, most: int | None, width: int | None) -> list[dict] | None:
    """Paths and values of all leaves of a JSON text, breadth by document order; None if it does not parse."""
    try:
        todo = [("", json.loads(text or ""), 0)]
    except ValueError:
        return None
    out: list[dict] = []
    while todo and (most is None or len(out) < most):
        path, node, level = todo.pop()
        if depth is not None and level > depth:
            continue
        if isinstance(node, dict):
            todo += [(f"{path}.{k}" if path else k, v, level + 1) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(f"{path}[{i}]", v, level + 1) for i, v in reversed(list(enumerate(node)))]
        else:
            out.append({"path": path, "value": "" if node is None else str(node)[:width]})
    return out


def flatten(c: Column, depth: int | None = None, most: int | None = None, width: int | None = None) -> Column:
    """JSON-01: array of (path, value) of the leaves of JSON text, paths as a.b[0], null as '', true as True; null if it
    does not parse. The engine's own bounds are depth 8, most 20 000, width 2000."""

    @F.pandas_udf("array<struct<path: string, value: string>>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _leaves(x, depth, most, width) for x in t])

    return run(c)


def json_doc(c: Column, most: int | None = None) -> Column:
    """JSON-02: kind (json_ld with @context), compact text, title from name or headline; not ok if it does not parse."""
    v = F.try_parse_json(c)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    ld = F.try_variant_get(v, "$['@context']", "variant").isNotNull()
    title = F.coalesce(_some(get("name")), get("headline"), F.lit(""))
    return F.struct(v.isNotNull().alias("ok"), F.when(v.isNull(), "not JSON").otherwise("").alias("error"), F.when(ld, "json_ld").otherwise("json").alias("kind"), title.alias("title"), _cut(F.to_json(v), most).alias("text"))


def embedded_urls(c: Column, depth: int | None = 8) -> Column:
    """JSON-05: http addresses among the strings of JSON text, in document order, those of keys not."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(t: pd.Series) -> pd.Series:
        out = []
        for x in t:
            leaves = None if x is None else _leaves(x, depth, None, None)
            out.append(None if leaves is None else [v["value"] for v in leaves if v["value"].startswith(("http://", "https://"))])
        return pd.Series(out)

    return run(c)


def card(page: Column) -> Column:
    """PAR-07, SUP-20: what a page says of itself: og and twitter fields, description, language, canonical address, JSON-LD
    types. Its addresses are as they stand; `judged_cards` judges them."""
    m = meta(page)
    first = lambda *keys: F.trim(F.regexp_replace(F.coalesce(*[m[k] for k in keys], F.lit("")), r"\s+", " "))
    title = F.trim(F.regexp_replace(F.coalesce(m["og:title"], m["twitter:title"], entities(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))), r"\s+", " "))
    tags = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<link\b([^>]*)>"), F.lit(1)), lambda t: (F.lower(attribute(t, "rel")) == "canonical") & (attribute(t, "href") != ""))
    canonical = F.when(F.size(tags) > 0, attribute(F.try_element_at(tags, F.lit(1)), "href")).otherwise("")
    lang = F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([^\"'\s>]+)", 1), r"\s+", " "))
    kinds = F.transform(json_ld(page), lambda x: F.coalesce(F.get_json_object(x, "$.@type"), F.lit("")))
    kinds = F.array_distinct(F.filter(F.flatten(F.transform(kinds, lambda x: F.when(F.startswith(x, F.lit("[")), F.from_json(x, "array<string>")).otherwise(F.array(x)))), lambda x: F.trim(x) != ""))
    page_url, image = F.coalesce(_some(first("og:url")), canonical), first("og:image", "twitter:image")
    desc, site = first("og:description", "twitter:description", "description"), first("og:site_name")
    empty = page.isNull() | (F.concat(title, desc, image, site, lang, canonical) == "") & (F.size(kinds) == 0)
    return F.struct((~empty).alias("ok"), F.when(empty, "no fields").otherwise("").alias("error"), title.alias("title"), desc.alias("description"), site.alias("site_name"), lang.alias("lang"), page_url.alias("page_url"), canonical.alias("canonical"), image.alias("image"), kinds.alias("ld_types"), F.array_sort(F.map_keys(m)).alias("meta_fields"))


def _flagged(batches):
    import pyarrow as pa

    for b in batches:
        bad = [None if a is None else [unsafe_one(u) for u in a] for a in b.column("_urls").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bad, pa.list_(pa.bool_()))], names=[*b.schema.names, "_bad"])


def judged_cards(cards: DataFrame, column: str) -> DataFrame:
    """Rows with a `card`: canonical and image only if they are safe, the others listed in `dropped`. The page's own address
    (og:url) comes before the canonical one."""
    c = lambda n: F.col(f"{column}.{n}")
    # the rows go through an Arrow batch as they are: a UDF over expressions with lambdas is not always taken out of them
    x = cards.withColumn("_urls", F.array(c("page_url"), c("canonical"), c("image")))
    x = x.mapInArrow(_flagged, T.StructType([*x.schema.fields, T.StructField("_bad", T.ArrayType(T.BooleanType()))])).drop("_urls")
    ok = lambda n, i: (c(n) != "") & ~F.col("_bad")[i]
    own = F.when(ok("page_url", 0), c("page_url")).when(ok("canonical", 1), c("canonical")).otherwise("")
    refused = lambda n, i, here: F.when(here & (c(n) != "") & F.col("_bad")[i], F.array(c(n))).otherwise(F.array().cast("array<string>"))
    dropped = F.concat(refused("page_url", 0, F.lit(True)), refused("canonical", 1, c("canonical") != c("page_url")), refused("image", 2, F.lit(True)))
    fields = [c(f).alias(f) for f in ("ok", "error", "title", "description", "site_name", "lang")]
    out = F.struct(*fields, own.alias("canonical"), F.when(ok("image", 2), c("image")).otherwise("").alias("image"), c("ld_types").alias("ld_types"), c("meta_fields").alias("meta_fields"), dropped.alias("dropped"))
    return x.withColumn(column, out).drop("_bad")


def playlist(text: Column, base: Column) -> Column:
    """SRC-26, SUP-22: segments (absolute), key, media sequence and kind of an m3u8 list; `ivs` is each segment's IV in hex,
    the given one or its own number."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = lambda p: F.filter(lines, lambda x: F.startswith(x, F.lit(p)))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    segments = _absolute(F.filter(lines, lambda x: ~F.startswith(x, F.lit("#"))), base)
    key = last(start("#EXT-X-KEY"))
    method = F.upper(F.coalesce(F.regexp_extract(key, r"METHOD=\"?([^\",]*)", 1), F.lit("")))
    uri = F.coalesce(F.regexp_extract(key, r"URI=\"([^\"]*)\"", 1), F.lit(""))
    iv = F.lower(F.lpad(F.coalesce(F.regexp_extract(key, r"(?i)IV=0x([0-9a-f]+)", 1), F.lit("")), 32, "0"))
    given = F.regexp_like(F.coalesce(key, F.lit("")), F.lit("(?i)IV=0x[0-9a-f]"))
    seq = F.coalesce(F.regexp_extract(last(start("#EXT-X-MEDIA-SEQUENCE:")), r":\s*(\d{1,18})\s*$", 1).try_cast("long"), F.lit(0).cast("long"))
    ivs = F.transform(segments, lambda x, i: F.when(given, iv).otherwise(F.lower(F.lpad(F.hex(seq + i), 32, "0"))))
    return F.struct(segments.alias("segments"), method.alias("key_method"), F.when(uri == "", "").otherwise(resolve(base, uri)).alias("key_uri"), F.when(given, iv).otherwise("").alias("key_iv"), seq.alias("media_sequence"), (F.size(start("#EXT-X-STREAM-INF")) > 0).alias("is_master"), ivs.alias("ivs"))


def _media(name: str | None, body: bytes | None) -> dict:
    out = {"ok": False, "error": "", "kind": name or "", "entries": None, "pages": None, "width": None, "height": None}
    body = bytes(body or b"")
    try:
        if name == "zip":
            with zipfile.ZipFile(BytesIO(body)) as z:
                out |= {"ok": True, "entries": [i.filename for i in z.infolist()]}
        elif name == "pdf":
            n = body.count(b"/Type /Page") + body.count(b"/Type/Page") - body.count(b"/Type /Pages") - body.count(b"/Type/Pages")
            out |= {"ok": True, "pages": max(n, 0)}
        elif name == "png" and body[12:16] == b"IHDR":
            out |= {"ok": True, **dict(zip(("width", "height"), struct.unpack(">II", body[16:24])))}
        elif name == "gif" and len(body) >= 10:
            out |= {"ok": True, **dict(zip(("width", "height"), struct.unpack("<HH", body[6:10])))}
        elif name == "jpeg":
            at = 2
            while at + 9 < len(body) and body[at] == 0xFF:
                kind, size = body[at + 1], int.from_bytes(body[at + 2 : at + 4], "big")
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", body[at + 5 : at + 9])
                    out |= {"ok": True, "width": w, "height": h}
                    break
                at += 2 + size
        if not out["ok"]:
            out["error"] = "unreadable"
    except (zipfile.BadZipFile, struct.error, ValueError, NotImplementedError) as e:
        out |= {"ok": False, "error": type(e).__name__}
    return out


_MEDIA = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("entries", T.ArrayType(T.StringType())), *[T.StructField(n, T.IntegerType()) for n in ("pages", "width", "height")]])


@F.pandas_udf(_MEDIA)
def media_info(name: pd.Series, body: pd.Series) -> pd.DataFrame:
    """PAR-08: entries of a zip, a PDF's pages by rough count, size of an image; a struct, from bytes in Arrow batches."""
    rows = [_media(n, b) for n, b in zip(name, body)]
    out = pd.DataFrame(rows, columns=["ok", "error", "kind", "entries", "pages", "width", "height"])
    return out.astype({"pages": "Int32", "width": "Int32", "height": "Int32"})


def time_of(fields: Column) -> Column:
    """DT-02: of a map of strings, the first time key (any case) that is not empty, as epoch seconds; later keys are not
    tried if it does not parse."""
    low = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_keys(fields), lambda k: F.lower(k))), lambda k: F.struct(k, F.element_at(F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == k), -1)["value"])))
    return epoch(F.coalesce(*[_some(low[k]) for k in TIME_KEYS]))


def normalized(url: Column, title: Column, text: Column, fields: Column, author: Column, site: Column, tags: Column, links_: Column, parser: Column, version: Column, fmt: Column, caps: tuple[int | None, ...] = (500, None, 200, 20_000)) -> Column:
    """MAP-02: the record of twelve fields; `fields` is a map of all others, of which the time keys give published_at and
    the rest goes into `extra`. caps: characters of short fields and of text, tags, links (None: all)."""
    short, long_, n_tags, n_links = caps
    kept_tags = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    kept_links = F.array_distinct(F.filter(F.transform(F.coalesce(links_, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.rlike("^https?://")))
    none = F.create_map().cast("map<string,string>")
    extra = F.map_filter(F.coalesce(fields, none), lambda k, v: ~k.isin(*TIME_KEYS, *FIELDS, "ok", "error"))
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(s(url).alias("url"), clean(title, short).alias("title"), clean(text, long_).alias("text"), time_of(F.coalesce(fields, none)).alias("published_at"), clean(author, short).alias("author"), clean(site, short).alias("site"), _most(kept_tags, n_tags).alias("tags"), _most(kept_links, n_links).alias("links"), s(parser).alias("parser"), F.coalesce(version, F.lit(0)).alias("parser_version"), s(fmt).alias("format"), extra.alias("extra"))


def printable_ratio(body: Column, n: int = 4096) -> Column:
    """MATH-03: share of printable bytes (blank, tab, line ends, 32 to 126, 128 and above) among the first n; 0 for none."""
    hexed = F.hex(F.substring(body, 1, n))
    odd = F.regexp_count(F.regexp_replace(hexed, "(..)", "$1 "), F.lit(r"\b(?:0[0-8BCEF]|1[0-9A-F]|7F)\b"))
    return F.when(F.length(hexed) > 0, 1.0 - odd / (F.length(hexed) / 2)).otherwise(0.0)


#: First bytes (hex) that name an encoding.
MARKS = {"EFBBBF": "utf-8-sig", "FFFE": "utf-16-le", "FEFF": "utf-16-be"}


def encoding(content_type: Column, body: Column) -> Column:
    """STR-18: of the Content-Type's charset, the byte order mark, the page's own charset in its first 4096 bytes, or utf-8,
    the first there is; lower-cased."""
    said = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1))
    hexed = F.hex(F.substring(body, 1, 3))
    mark = F.lit(None).cast("string")
    for h, name in MARKS.items():
        mark = F.coalesce(mark, F.when(F.startswith(hexed, F.lit(h)), name))
    own = F.lower(F.regexp_extract(F.decode(F.substring(body, 1, 4096), "ISO-8859-1"), r"(?is)<meta\b[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1))
    return F.coalesce(_some(said), mark, _some(own), F.lit("utf-8"))


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, name: pd.Series) -> pd.Series:
    """SUP-26: bytes as text by an encoding's name, with replacement characters; unknown names count as utf-8."""

    def one(b, n):
        try:
            return bytes(b).decode(n or "utf-8", "replace")
        except LookupError:
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([None if b is None else one(b, n) for b, n in zip(body, name)])


def capped(body: Column, most: int) -> Column:
    """SUP-25: struct(body, truncated)."""
    return F.struct(F.substring(body, 1, most).alias("body"), (F.length(body) > most).alias("truncated"))
