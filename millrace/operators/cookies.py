"""Cookie jars as tables: file sources, which cookies go with an address, and summaries without values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.url import host

FIELDS = ["domain", "name", "value", "path", "expires", "secure", "host_only"]


def netscape(lines: DataFrame, line: str) -> DataFrame:
    """SRC-22: rows of a Netscape file, tabs or blanks between fields; #HttpOnly_ lines count, other # lines and short ones
    do not. Expiry that is no number is 0 (a session)."""
    raw = F.col(line)
    only = F.startswith(raw, F.lit("#HttpOnly_"))
    body = F.when(only, F.substring(raw, 11, 1 << 30)).otherwise(raw)
    tabbed = F.split(body, "\t")
    parts = F.when(F.size(tabbed) >= 7, tabbed).otherwise(F.split(F.trim(body), r"\s+"))
    x = lines.filter((F.trim(raw) != "") & (only | ~F.startswith(raw, F.lit("#")))).select(parts.alias("p"), only.alias("only")).filter(F.size("p") >= 7)
    dotted = F.startswith(F.col("p")[0], F.lit("."))
    return x.select(_domain(F.col("p")[0]).alias("domain"), F.col("p")[5].alias("name"), F.col("p")[6].alias("value"), F.col("p")[2].alias("path"), F.coalesce(F.col("p")[4].try_cast("double"), F.lit(0.0)).alias("expires"), (F.upper(F.col("p")[3]) == "TRUE").alias("secure"), (~dotted & ~F.col("only")).alias("host_only"))


def _domain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\.+", ""))


def from_json(texts: DataFrame, text: str) -> DataFrame:
    """SRC-22: cookies of JSON texts: a list, an object with `cookies` or `data`, or one cookie."""
    one = "struct<domain: string, name: string, value: string, path: string, expires: string, expirationDate: string, secure: boolean>"
    t = F.trim(F.col(text))
    listed = F.coalesce(F.get_json_object(t, "$.cookies"), F.get_json_object(t, "$.data"), t)
    array = F.when(F.startswith(listed, F.lit("[")), listed).otherwise(F.concat(F.lit("["), listed, F.lit("]")))
    x = texts.select(F.explode(F.from_json(array, f"array<{one}>")).alias("c")).filter("c is not null").select("c.*")
    return x.select(_domain(F.coalesce("domain", F.lit(""))).alias("domain"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("path", F.lit("/")).alias("path"), F.coalesce(F.coalesce("expires", "expirationDate").try_cast("double"), F.lit(0.0)).alias("expires"), F.coalesce("secure", F.lit(False)).alias("secure"), (~F.startswith(F.coalesce("domain", F.lit("")), F.lit("."))).alias("host_only"))


def expired(now: float) -> Column:
    """FLT-12: a cookie with an expiry before now; 0 never expires."""
    return (F.col("expires") > 0) & (F.col("expires") < now)


def usable(jar: DataFrame, now: float) -> DataFrame:
    """SUP-15: the jar without what has expired."""
    return jar.filter(~expired(now))


def headers(urls: DataFrame, url: str, jar: DataFrame, now: float) -> DataFrame:
    """JOIN-11, FLT-12: (url, header) with all cookies that go with it, the longest path first, then by name; '' for none.

    A host meets cookies by its own suffixes, so the join is on equal domains however large the jar is.
    """
    u = urls.select(F.col(url).alias("url")).distinct()
    h = host(F.col("url"))
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    x = u.select("url", h.alias("h"), F.when(path == "", "/").otherwise(path).alias("p"), F.lower("url").startswith("https:").alias("tls"), F.explode(suffixes).alias("d"))
    c = usable(jar, now).select(*[F.col(f).alias(f"c_{f}") for f in FIELDS])
    fits = (F.col("d") == F.col("c_domain")) & (~F.col("c_secure") | F.col("tls")) & (~F.col("c_host_only") | (F.col("h") == F.col("c_domain"))) & F.startswith("p", F.col("c_path"))
    met = x.join(c, fits).groupBy("url").agg(F.array_sort(F.collect_list(F.struct((-F.length("c_path")).alias("n"), F.col("c_name").alias("name"), F.col("c_value").alias("value")))).alias("a"))
    header = F.array_join(F.transform("a", lambda e: F.concat(e["name"], F.lit("="), e["value"])), "; ")
    return u.join(met, "url", "left").select("url", F.coalesce(header, F.lit("")).alias("header"))


def summary(jar: DataFrame, now: float) -> DataFrame:
    """AGG-17, AGG-16: total, expired and the number of domains; no values."""
    return jar.agg(F.count("*").alias("total"), F.count_if(expired(now)).alias("expired"), F.countDistinct("domain").alias("domains"))


def missing_reason(hosts: DataFrame, host_: str, jar: DataFrame, now: float) -> DataFrame:
    """SUP-15: per host why there is no cookie: `empty_jar`, `no_domain`, `all_expired`, or `usable` with their number n."""
    d = jar.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(~expired(now)).alias("alive"))
    h = hosts.select(F.lower(F.col(host_)).alias("host")).distinct()
    labels = F.split("host", r"\.")
    x = h.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    met = x.join(d, "domain").groupBy("host").agg(F.sum("n").alias("n"), F.sum("alive").alias("alive"))
    none = jar.limit(1).count() == 0
    why = F.lit("empty_jar") if none else F.when(F.col("n").isNull(), "no_domain").when(F.col("alive") == 0, "all_expired").otherwise("usable")
    return h.join(met, "host", "left").select("host", why.alias("reason"), F.coalesce("alive", F.lit(0)).cast("long").alias("n"))
