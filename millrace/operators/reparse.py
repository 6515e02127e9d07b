"""Stored bodies interpreted anew: detect, parse, expand, normalize, judge, fingerprint, deduplicate, count.

Bodies are read once; every step up to the verdicts is narrow. The verdicts join on hashes and fingerprints (`dedup`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse as ps, text as tx
from ..functions.records import file_format
from ..runtime import Scratch
from .dedup import verdicts

#: What every parser gives: the records it found, as an array of these.
RECORD = "struct<url: string, title: string, text: string, fields: map<string,string>, site: string, links: array<string>>"


@dataclass(frozen=True)
class Parser:
    """PAR-09: a parser of formats: (body, url) to struct(ok, error, records); the least (order, name) is tried first."""

    name: str
    version: int
    accepts: tuple[str, ...]
    build: Callable[[Column, Column], Column]
    order: int = 100
    note: str = ""


def _records(ok: Column, error: Column, records: Column) -> Column:
    return F.struct(ok.alias("ok"), error.alias("error"), F.when(ok, records.cast(f"array<{RECORD}>")).alias("records"))


def _one(url: Column, title: Column, text: Column, fields: Column | None = None, site: Column | None = None, links: Column | None = None) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.struct(url.alias("url"), title.alias("title"), text.alias("text"), (none if fields is None else fields).alias("fields"), (F.lit("") if site is None else site).alias("site"), (F.array().cast("array<string>") if links is None else links).alias("links"))


def _html(body: Column, url: Column) -> Column:
    h = ps.html(body, url)
    return _records(h["ok"], h["error"], F.array(_one(url, h["title"], h["text"], h["meta"], links=h["links"])))


def _feed(body: Column, url: Column) -> Column:
    f = ps.feed(body)
    each = F.transform(f["items"], lambda i: _one(i["link"], i["title"], F.when(i["summary"] == "", i["title"]).otherwise(i["summary"]), F.create_map(F.lit("published"), i["published"]), f["feed_title"]))
    return _records(f["ok"], f["error"], each)


def _sitemap(body: Column, url: Column) -> Column:
    s = ps.sitemap(body)
    each = F.transform(s["urls"], lambda i: _one(i["loc"], i["loc"], F.trim(F.concat_ws(" ", i["lastmod"], i["changefreq"], i["priority"])), F.create_map(F.lit("lastmod"), i["lastmod"])))
    return _records(s["ok"], s["error"], each)


def _feed_or_sitemap(body: Column, url: Column) -> Column:
    return F.when(ps.is_sitemap(body), _sitemap(body, url)).otherwise(_feed(body, url))


def _json(body: Column, url: Column) -> Column:
    j = ps.json_doc(body)
    return _records(j["ok"], j["error"], F.array(_one(url, j["title"], j["text"])))


def _text(body: Column, url: Column) -> Column:
    t = ps.plain_text(body)
    return _records(t["ok"], t["error"], F.array(_one(url, F.lit(""), t["text"])))


DEFAULT = (
    Parser("html_text", 1, ("html",), _html, 10),
    Parser("feed_sitemap", 1, ("rss", "atom", "sitemap", "sitemap_index", "xml"), _feed_or_sitemap, 20),
    Parser("json", 1, ("json",), _json, 30),
    Parser("text", 1, ("text", "json", "csv"), _text, 40),
)


@dataclass
class Registry:
    """PAR-09, SUP-27: parsers by format; `skipped` names those that were refused, with why."""

    parsers: list[Parser] = field(default_factory=lambda: list(DEFAULT))
    skipped: list[tuple[str, str]] = field(default_factory=list)

    def add(self, parser: object) -> None:
        if not isinstance(parser, Parser):
            self.skipped.append((repr(parser), "not a Parser"))
        elif any(p.name == parser.name for p in self.parsers):
            self.skipped.append((parser.name, "name taken"))
        else:
            self.parsers.append(parser)

    def candidates(self, fmt: str) -> list[Parser]:
        return sorted((p for p in self.parsers if fmt in p.accepts), key=lambda p: (p.order, p.name))

    def formats(self) -> list[str]:
        return sorted({f for p in self.parsers for f in p.accepts})

    def summary(self) -> list[tuple[str, int, str]]:
        return [(p.name, p.version, " ".join(p.accepts)) for p in sorted(self.parsers, key=lambda p: (p.order, p.name))]

    def parse(self, fmt: Column, body: Column, url: Column) -> Column:
        """JOIN-13, PAR-10: struct(ok, error, parser, version, tried, records) of the first candidate that succeeds."""
        out = None
        for f in self.formats():
            done = None
            tried: list[str] = []
            for p in self.candidates(f):
                tried = [*tried, p.name]
                r = p.build(body, url)
                said = F.struct(r["ok"].alias("ok"), r["error"].alias("error"), F.lit(p.name).alias("parser"), F.lit(p.version).alias("version"), F.array(*map(F.lit, tried)).alias("tried"), r["records"].alias("records"))
                done = said if done is None else F.when(done["ok"], done).otherwise(said)
            out = F.when(fmt == f, done) if out is None else out.when(fmt == f, done)
        none = F.struct(F.lit(False).alias("ok"), F.lit("no parser").alias("error"), F.lit("").alias("parser"), F.lit(0).alias("version"), F.array().cast("array<string>").alias("tried"), F.lit(None).cast(f"array<{RECORD}>").alias("records"))
        return out.otherwise(none) if out is not None else none


def selected(artifacts: DataFrame, since: float | None = None, parent_task: str | None = None, url_like: str | None = None, limit: int | None = None) -> DataFrame:
    """The artifacts a run reads: filters reach the scan; a limit takes the first by time."""
    x = artifacts
    if since is not None:
        x = x.filter(F.col("fetched_at") >= since)
    if parent_task is not None:
        x = x.filter(F.col("parent_task") == parent_task)
    if url_like is not None:
        x = x.filter(F.col("url").ilike(f"%{url_like}%"))
    return x if limit is None else x.orderBy("fetched_at", "sha256", "url").limit(limit)


def parsed(artifacts: DataFrame, registry: Registry | None = None) -> DataFrame:
    """PAR-13, first half: artifacts(sha256, url, mime, fetched_at, body) with the struct of `Registry.parse` in `p` and the
    format in `format`; body is text, and its first bytes help to detect the format."""
    registry = registry or Registry()
    fmt = file_format(F.col("url"), F.col("mime"), F.encode(F.substring("body", 1, 1024), "UTF-8"))["name"]
    x = artifacts.withColumn("format", fmt)
    return x.withColumn("p", registry.parse(F.col("format"), F.col("body"), F.col("url")))


def records(parsed_: DataFrame, least_score: float = tx.MIN_SCORE) -> DataFrame:
    """PAR-11, MAP-02, STR-17: one row a record: place, the normalized fields, score, accepted, content hash (of the title
    where there is no text) and fingerprint."""
    x = parsed_.filter("p.ok").select("sha256", F.col("url").alias("from_url"), "fetched_at", "format", F.col("p.parser").alias("parser"), F.col("p.version").alias("version"), F.posexplode("p.records").alias("place", "r"))
    r = ps.normalized(F.when(F.col("r.url") == "", F.col("from_url")).otherwise(F.col("r.url")), F.col("r.title"), F.col("r.text"), F.col("r.fields"), F.col("r.fields")["author"], F.col("r.site"), F.array().cast("array<string>"), F.col("r.links"), F.col("parser"), F.col("version"), F.col("format"))
    x = x.select("sha256", "from_url", "fetched_at", "place", r.alias("r")).select("sha256", "from_url", "fetched_at", "place", "r.*")
    s = tx.quality(F.col("text"), F.col("title"), F.col("url"))
    text = F.when(F.col("text") == "", F.col("title")).otherwise(F.col("text"))
    return x.withColumns({"score": F.round(s, 6), "accepted": s >= least_score, "content_hash": tx.content_hash(text), "simhash": tx.simhash_of(F.col("text"))})


def run(artifacts: DataFrame, registry: Registry | None = None, least_score: float = tx.MIN_SCORE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PAR-13: (records with state and duplicate_of, the parsed artifacts, statistics).

    Records arrive by fetched_at, then sha256, url and place; rejected ones have the state `rejected`. Statistics (AGG-06)
    is one row: scanned, parsed_ok, parsed_failed, records, accepted, rejected, new, unchanged, near.
    """
    scratch = Scratch(artifacts.sparkSession, "reparse")
    p = scratch.put(parsed(artifacts, registry), "parsed")
    key = F.struct("fetched_at", "sha256", "from_url", "place")
    recs = scratch.put(records(p, least_score).withColumn("key", key), "records")
    good = recs.filter("accepted").select("key", "content_hash", "simhash")
    v = verdicts(good, "key", "content_hash", "simhash").withColumnRenamed("key", "vkey")
    out = recs.join(v, F.col("key") == F.col("vkey"), "left").drop("vkey").withColumn("state", F.coalesce("state", F.lit("rejected")))
    out = scratch.put(out, "judged")
    a = p.agg(F.count("*").alias("scanned"), F.count_if("p.ok").alias("parsed_ok"), F.count_if(~F.col("p.ok")).alias("parsed_failed"))
    b = out.agg(F.count("*").alias("records"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(F.col("state") == "new").alias("new"), F.count_if(F.col("state") == "unchanged").alias("unchanged"), F.count_if(F.col("duplicate_of").isNotNull()).alias("near"))
    return out.drop("key"), p, a.crossJoin(b)  # one row each
