"""Addresses found in parsed bodies: one table of resources from all sources, and why some are not followed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import url as ur

SCHEMA = ["source", "kind", "place", "url", "detail", "same_site"]


def resources(found: DataFrame, base: str, strip_www: bool = True, hosts: list[str] | None = None) -> DataFrame:
    """SUP-19: rows (source, kind, place, href, detail) and a base address to resources in canonical form.

    Addresses without one have no row. same_site: below one of `hosts`, else below the base's own host (false without a
    base); with strip_www both sides lose their www.
    """
    url = ur.canonical(ur.resolve(F.col(base), F.col("href")), strip_www)
    x = found.select("source", F.col(base).alias("_base"), "kind", "place", "detail", url.alias("url")).filter("url is not null")
    there = ur.host(F.col("url"))
    if hosts:
        same = reduce(lambda a, b: a | b, [ur.same_site(there, F.lit(h.lower())) for h in hosts])
    else:
        same = F.coalesce(ur.same_site(there, ur.host(ur.canonical(F.col("_base"), strip_www))), F.lit(False))
    return x.select("source", "kind", "place", "url", "detail", same.alias("same_site"))


def from_parsed(parsed: DataFrame, source: str, base: str, most: int | None = None, **columns: str) -> DataFrame:
    """PAR-12, SET-01: rows (source, kind, place, href, detail, base) of all columns that hold addresses.

    columns: kind of resource to the column with it: arrays of addresses, or of structs with link and title, or loc.
    """
    parts = []
    for kind, column in columns.items():
        each = parsed.schema[column].dataType.elementType
        names = getattr(each, "names", None)
        x = parsed.select(F.col(source).alias("source"), F.col(base).alias("base"), F.posexplode(column if most is None else F.slice(column, 1, most)).alias("place", "e"))
        href = F.col("e") if names is None else F.col("e.link" if "link" in names else "e.loc")
        detail = F.col("e.title") if names is not None and "title" in names else F.lit("")
        parts.append(x.select("source", F.lit(kind).alias("kind"), "place", href.alias("href"), detail.alias("detail"), "base").filter("href <> ''"))
    return reduce(DataFrame.unionByName, parts)


def judged(found: DataFrame, order: dict[str, int], same_site_only: bool = True, denied: Column | None = None) -> DataFrame:
    """FLT-05, WIN-04: resources with `reason`: `duplicate` but for the first of an address in its source's batch (by the
    kinds' order, then place), `off_site`, `policy` where `denied` (a column) holds, '' if accepted.

    The first is the least of a partial aggregate by (source, url), so no batch is sorted whole.
    """
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("kind")]
    at = F.struct(rank.alias("rank"), F.col("place"))
    first = found.groupBy(F.col("source").alias("_s"), F.col("url").alias("_u")).agg(F.min(at).alias("_first"))
    x = found.join(first, (F.col("source") == F.col("_s")) & (F.col("url") == F.col("_u")))
    why = F.when(at > F.col("_first"), "duplicate")
    if same_site_only:
        why = why.when(~F.col("same_site"), "off_site")
    if denied is not None:
        why = why.when(denied, "policy")
    return x.select(*SCHEMA, F.coalesce(why, F.lit("")).alias("reason"))


def allowed(urls: DataFrame, url: str, robots: DataFrame | None = None) -> DataFrame:
    """FLT-07: each address with `reason`: `scheme`, `private`, `robots` (a table url, allowed) or '' if allowed."""
    u = F.col(url)
    x = urls.join(robots.select(F.col("url").alias("_r"), F.col("allowed").alias("_ok")), u == F.col("_r"), "left") if robots is not None else urls.withColumn("_ok", F.lit(True))
    why = F.when(~F.coalesce(u.rlike("(?i)^https?://"), F.lit(False)), "scheme").when(ur.unsafe(u), "private").when(~F.coalesce("_ok", F.lit(True)), "robots").otherwise("")
    return x.select(*urls.columns, why.alias("reason"))


def classified(urls: Column) -> Column:
    """FLT-13, FLT-14: struct(kept, dropped) of an array of addresses: http ones that are not private, each once."""
    each = F.array_distinct(F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    marked = ur.unsafe_each(each)
    return F.struct(F.transform(F.filter(F.arrays_zip(each.alias("u"), marked.alias("bad")), lambda p: ~p["bad"]), lambda p: p["u"]).alias("kept"), F.transform(F.filter(F.arrays_zip(each.alias("u"), marked.alias("bad")), lambda p: p["bad"]), lambda p: p["u"]).alias("dropped"))
