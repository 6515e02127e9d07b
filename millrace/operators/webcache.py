"""Caches of fetched things as tables: revalidated responses, robots rules by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .robots import decide, parse

#: Response headers that a cache keeps.
KEPT_HEADERS = ("etag", "last-modified", "content-type", "cache-control", "expires", "date")
#: Seconds that robots rules count.
ROBOTS_TTL = 86_400.0


def key(url: Column) -> Column:
    """Name of a cached response: 32 hex digits of the address's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 32)


def entries(responses: DataFrame) -> DataFrame:
    """SRC-21: responses(url, status, headers map, size, fetched_at) as the cache keeps them: the last of each address,
    with those headers that matter."""
    kept = F.map_filter(F.transform_keys("headers", lambda k, v: F.lower(k)), lambda k, v: k.isin(*KEPT_HEADERS))
    last = responses.groupBy("url").agg(F.max_by(F.struct("status", kept.alias("headers"), "size"), F.struct("fetched_at", "size")).alias("r"), F.max("fetched_at").alias("fetched_at"), F.count("*").alias("n"))
    return last.select(key(F.col("url")).alias("key"), "url", "r.status", "r.headers", "r.size", "fetched_at", (F.col("n") - 1).alias("hits"))


def stale(fetched_at: Column, now: float, ttl: float) -> Column:
    """Whether a response has to be asked for again; without a time to live always."""
    return F.lit(True) if ttl <= 0 else F.lit(now) - fetched_at > ttl


def conditional(headers: Column) -> Column:
    """Request headers that let the server answer that nothing has changed."""
    pairs = F.array(F.struct(F.lit("If-None-Match").alias("key"), headers["etag"].alias("value")), F.struct(F.lit("If-Modified-Since").alias("key"), headers["last-modified"].alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")))


def evict(cache: DataFrame, most: int) -> DataFrame:
    """The cache with at most `most` entries: beyond it, the oldest go until a tenth of `most` is free."""
    n = cache.count()
    if n <= most:
        return cache
    oldest = cache.orderBy("fetched_at", "key").limit(n - most + max(1, most // 10)).select("key")
    return cache.join(oldest, "key", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def robots_rules(fetched: DataFrame, now: float, ttl: float = ROBOTS_TTL) -> DataFrame:
    """URL-08, SUP-13: rules (host, agent, allow, pattern) of fetched(host, status, text, fetched_at) that still count: 2xx
    are parsed, 4xx allow all (no rule), all others forbid all."""
    live = fetched.filter(F.col("fetched_at") >= now - ttl)
    own = parse(live.filter("status between 200 and 299"), "host", "text")
    shut = live.filter("status < 200 or status between 300 and 399 or status >= 500").select("host", F.lit("*").alias("agent"), F.lit(False).alias("allow"), F.lit("/").alias("pattern"))
    return own.unionByName(shut)


def robots_decisions(urls: DataFrame, fetched: DataFrame, agent: str, now: float, ttl: float = ROBOTS_TTL) -> DataFrame:
    """SUP-12: urls(url, host, path) with allowed and known; hosts without live rules are unknown and allowed."""
    known = fetched.filter(F.col("fetched_at") >= now - ttl).select(F.col("host").alias("kh")).distinct()
    x = decide(urls, robots_rules(fetched, now, ttl), agent)
    return x.join(known, F.col("host") == F.col("kh"), "left").select("url", "allowed", F.col("kh").isNotNull().alias("known"))


def crawl_delays(fetched: DataFrame, now: float, ttl: float = ROBOTS_TTL) -> DataFrame:
    """URL-11: (host, delay) of live 2xx texts, the last Crawl-delay that is a number; null without one."""
    found = F.regexp_extract_all("text", F.lit(r"(?im)^[ \t]*crawl-delay[ \t]*:[ \t]*([0-9]+(?:\.[0-9]+)?)[ \t]*(?:#.*)?\r?$"), F.lit(1))
    live = fetched.filter((F.col("fetched_at") >= now - ttl) & F.col("status").between(200, 299))
    return live.groupBy("host").agg(F.max_by(F.try_element_at(found, F.lit(-1)), "fetched_at").cast("double").alias("delay"))


def cooldowns(rows: DataFrame, now: float) -> DataFrame:
    """STM-12: rows(domain, until_epoch, tier, throttle_count) as restored: the last of each domain, without those that are
    over."""
    last = rows.groupBy("domain").agg(F.max_by(F.struct("until_epoch", "tier", "throttle_count"), F.struct("until_epoch", "throttle_count")).alias("r"))
    return last.select("domain", "r.*").filter(F.col("until_epoch") > now)
