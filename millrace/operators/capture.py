"""Raw captures: content-addressed rows, the index over them, contracts of stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.records import file_format

CONTRACTS = {"media": 100 * 1024, "document": 1024, "image": 512}


def put(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """SRC-01, SRC-02: rows(body, url, ...) with sha256, size and prefix, one a (sha256, url), those not stored yet."""
    sha = F.sha2("body", 256)
    new = rows.withColumns({"sha256": sha, "size": F.length("body"), "prefix": F.substring(sha, 1, 2)}).dropDuplicates(["sha256", "url"])
    return new if stored is None else new.join(stored.select("sha256", "url"), ["sha256", "url"], "left_anti")


def write(rows: DataFrame, path: str) -> None:
    """Append to the store, in folders by hash prefix; readers prune by it."""
    rows.write.mode("append").partitionBy("prefix").option("compression", "zstd").parquet(path)


def verify(rows: DataFrame) -> DataFrame:
    """SRC-04: sha256 and why a stored row is not intact ('' if it is)."""
    why = F.when(F.col("body").isNull(), "missing").when(F.length("body") != F.col("size"), "size").when(F.sha2("body", 256) != F.col("sha256"), "hash").otherwise("")
    return rows.select("sha256", why.alias("why"))


def unique(rows: DataFrame) -> DataFrame:
    """One row a (sha256, url): the earliest."""
    return rows.groupBy("sha256", "url").agg(F.min_by(F.struct("size", "mime", "status", "source"), F.struct("fetched_at", "size")).alias("r"), F.min("fetched_at").alias("fetched_at")).select("sha256", "url", "r.*", "fetched_at")


def stats(rows: DataFrame) -> DataFrame:
    """SRC-05, SRC-10."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def all_ids(rows: DataFrame) -> DataFrame:
    """SRC-06: each content id with its first time."""
    return rows.groupBy("sha256").agg(F.min("fetched_at").alias("first_at"))


def since(rows: DataFrame, t: float, limit: int) -> DataFrame:
    """SRC-08; the filter reaches the scan."""
    return rows.filter(F.col("fetched_at") >= t).orderBy("fetched_at", "sha256", "url").limit(limit)


def url_like(rows: DataFrame, part: str, limit: int = 500) -> DataFrame:
    """SRC-09: newest first; % and _ are wildcards, ASCII case does not count."""
    return rows.filter(F.col("url").ilike(f"%{part}%")).orderBy(F.col("fetched_at").desc(), "sha256", "url").limit(limit)


def contract(size: Column, url: Column, mime: Column, least: int, prefix: str = "", not_html: bool = True) -> Column:
    """FLT-11: the first check of a contract that fails ('' if none): empty, small, html, mime."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    html = file_format(url, mime)["name"] == "html"
    out = F.when(size.isNull() | (size <= 0), "empty").when(size < least, "too_small")
    if not_html:
        out = out.when(html, "html")
    if prefix:
        out = out.when(~F.startswith(m, F.lit(prefix)), "mime")
    return out.otherwise("")


def lookup(rows: DataFrame, content: str | None = None, url: str | None = None, task: str | None = None) -> DataFrame:
    """SRC-07: rows by content id, address and task, in time order; the filters reach the scan."""
    for name, value in (("sha256", content), ("url", url), ("parent_task", task)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy("fetched_at", "sha256", "url")


def read(spark, path: str, ids: DataFrame) -> DataFrame:
    """SRC-03: stored rows of content ids, from the folders of their prefixes alone (at most 256)."""
    some = [r[0] for r in ids.select(F.substring("sha256", 1, 2)).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("prefix").isin(some)).join(ids.select("sha256").distinct(), "sha256", "left_semi")


#: Kinds of content that are worth packing, and from how many bytes (fixed values).
TEXTY, PACK_FROM = r"^(?:text/|application/(?:json|xml|javascript|xhtml|rss|atom))|\+(?:xml|json)", 1024


def packed(size: Column, mime: Column) -> Column:
    """SRC-01: whether a body is packed (gzip) in a loose store; in this store parquet packs all columns."""
    return (size >= PACK_FROM) & F.lower(F.coalesce(mime, F.lit(""))).rlike(TEXTY)


def verdict(size: Column, url: Column, mime: Column, sha: Column, least: int, most: int | None = None, formats: tuple[str, ...] = (), prefix: str = "", expected: Column | None = None, not_html: bool = True) -> Column:
    """FLT-11: struct(ok, reason) of a contract: missing, empty, too_small, too_large, html, format, mime, hash; the first
    that fails."""
    name = file_format(url, mime)["name"]
    out = F.when(size.isNull(), "missing").when(size <= 0, "empty").when(size < least, "too_small")
    if most is not None:
        out = out.when(size > most, "too_large")
    if not_html:
        out = out.when(name == "html", "html")
    if formats:
        out = out.when(~name.isin(*formats), "format")
    if prefix:
        out = out.when(~F.startswith(F.lower(F.coalesce(mime, F.lit(""))), F.lit(prefix)), "mime")
    if expected is not None:
        out = out.when(sha != expected, "hash")
    why = out.otherwise("")
    return F.struct((why == "").alias("ok"), why.alias("reason"))


def probe(headers: Column, status: Column) -> Column:
    """SUP-24: struct(total, resumable) of a response's headers (lower-case names): bytes in all from Content-Range, else
    Content-Length; resumable with status 206 or Accept-Ranges: bytes."""
    whole = F.regexp_extract(F.coalesce(headers["content-range"], F.lit("")), r"/(\d+)\s*$", 1)
    size = F.regexp_extract(F.coalesce(headers["content-length"], F.lit("")), r"^\s*(\d+)\s*$", 1)
    total = F.coalesce(F.when(whole != "", whole), F.when(size != "", size)).try_cast("long")
    return F.struct(total.alias("total"), ((status == 206) | (F.lower(F.trim(F.coalesce(headers["accept-ranges"], F.lit("")))) == "bytes")).alias("resumable"))


def payload(url: Column, least: int = 200, most: int = 4000) -> Column:
    """SUP-32: a test body that depends on the address alone: words of its hash, between `least` and `most` bytes."""
    h = F.sha2(url, 256)
    n = least + F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(most - least + 1))
    words = F.transform(F.sequence(F.lit(1), F.ceil(n / 8).cast("int")), lambda i: F.substring(F.sha2(F.concat(h, i.cast("string")), 256), 1, 7))
    return F.substring(F.array_join(words, " "), F.lit(1), n.cast("int"))
