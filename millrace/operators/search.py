"""Full-text search: a positional inverted index, phrases joined by AND, BM25."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import tokens
from ..runtime import Scratch
from .runs import Runs

K1, B = 1.2, 0.75


def index(docs: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """STR-02: postings (key, pos, term) of whole texts, or of their first `most` tokens; `_` separates words."""
    t = tokens(F.regexp_replace(F.col(text), "_", " "))
    t = t if most is None else F.slice(t, 1, most)
    return docs.select(key, F.posexplode(t).alias("pos", "term"))


def phrases(query: str) -> list[list[str]]:
    """STR-03: each blank-separated word of a query is a phrase of its tokens."""
    out = []
    for word in query.lower().replace("_", " ").split():
        t = re.findall("[a-z0-9]+", word)
        for run in re.findall("[一-鿿]+", word):
            t += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        if t:
            out.append(t)
    return out


def search(postings: DataFrame, key: str, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """AGG-15, JOIN-12, TOP-03: (key, score), the lowest score first; nothing for a query without tokens.

    Only postings of the query's terms leave the scan; phrases are checked by joining positions.
    """
    ps = phrases(query)
    terms = {t for p in ps for t in p}
    return ranked(postings.filter(F.col("term").isin(*terms)) if terms else postings.limit(0), postings.groupBy(key).agg(F.count("*").alias("len")), key, ps, limit, offset)


def ranked(hits_: DataFrame, sizes: DataFrame, key: str, ps: list[list[str]], limit: int, offset: int) -> DataFrame:
    """BM25 over postings (key, pos, term) of the phrases' terms; sizes(key, len) of all documents with a token."""
    total = sizes.agg(F.count("*").alias("docs"), F.avg("len").alias("avg"))
    hits = None
    for n, p in enumerate(ps):
        x = hits_.filter(F.col("term") == p[0]).select(key, "pos")
        for i, term in enumerate(p[1:], 1):
            y = hits_.filter(F.col("term") == term).select(F.col(key), (F.col("pos") - i).alias("pos"))
            x = x.join(y, [key, "pos"])
        f = x.groupBy(key).agg(F.count("*").alias("f")).withColumn("p", F.lit(n))
        hits = f if hits is None else hits.union(f)
    if hits is None:
        return sizes.select(key, F.lit(0.0).alias("score")).limit(0)
    df = hits.groupBy("p").agg(F.count("*").alias("n"))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    # df and total have one row a phrase and one row: bounded by the query
    x = hits.join(F.broadcast(df), "p").join(sizes, key).crossJoin(F.broadcast(total)).withColumn("part", part)
    x = x.groupBy(key).agg(F.count("*").alias("found"), F.round(-F.sum("part"), 4).alias("score")).filter(F.col("found") == len(ps))
    return x.select(key, "score").orderBy("score", key).offset(max(0, offset)).limit(max(1, min(200, limit)))


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by("len", "version").alias("len"), F.max("version").alias("version"))


class SearchIndex:
    """STR-02, JOIN-10, SUP-10: an index in a folder that grows by batches of documents; another session opens it.

    Postings lie in slots by term, so a search reads the slots of its terms; a document's last version counts, a removed one
    has none. Keys are text; null keys are left out; a batch with a key twice keeps one of its texts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.scratch = spark, Scratch(spark, "search")
        self.docs = Runs(spark, f"{folder}/docs", "key string, len long, version long", ["key"], _latest)
        self.postings = Runs(spark, f"{folder}/postings", "term string, key string, pos int, version long", ["term"], DataFrame.distinct)

    def _next(self) -> int:
        return (self.docs.raw().agg(F.max("version")).first()[0] or 0) + 1

    def put(self, docs: DataFrame, key: str, text: str) -> None:
        """Add documents, or replace those of the same key."""
        v = F.lit(self._next()).cast("long")
        one = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        one = self.scratch.put(one, "batch")
        posts = index(one, "key", "text")
        self.postings.append(posts.select("term", "key", "pos", v.alias("version")))
        sizes = posts.groupBy("key").agg(F.count("*").alias("len"))
        self.docs.append(one.select("key").join(sizes, "key", "left").select("key", F.coalesce("len", F.lit(0)).alias("len"), v.alias("version")))
        self.scratch.drop(one)
        self._compact()

    def remove(self, keys: DataFrame, key: str) -> None:
        """Take documents out."""
        rows = keys.select(F.col(key).cast("string").alias("key"), F.lit(None).cast("long").alias("len"), F.lit(self._next()).cast("long").alias("version")).filter("key is not null").distinct()
        self.docs.append(rows)
        self._compact()

    def _compact(self) -> None:
        self.docs.compact()
        self.postings.compact()

    def search(self, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        """(key, score) as `search`."""
        ps = phrases(query)
        live = self.docs.read().filter("len > 0")
        terms = self.scratch.put(self.spark.createDataFrame(sorted((t,) for t in {t for p in ps for t in p}), "term string"), "terms")
        hits = self.postings.asked(terms).join(live.select("key", "version"), ["key", "version"], "left_semi").distinct()
        return ranked(hits, live.select("key", "len"), "key", ps, limit, offset)


def upsert(postings: DataFrame, key: str, fresh: DataFrame) -> DataFrame:
    """JOIN-10, SUP-10: postings with the documents of `fresh` replaced."""
    return postings.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
