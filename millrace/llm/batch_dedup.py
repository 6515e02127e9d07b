"""Problem 3: each new batch against all history, by multi-key sorted neighbourhoods.

A page's fingerprint yields one key a table: the bits of two of its five blocks; of two fingerprints within three bits at
least two blocks are equal, so they are neighbours under some key. History is a folder of sorted runs in key ranges
(`Runs`), one run a batch, merged level by level, so a row is rewritten O(log n) times. A batch is probed before it is
added: its keys go to the key ranges they fall into (few enough are sent to the scan, which then shuffles nothing) and
meet the equal keys there, which are its window in that order, however long; only windows around new records are
compared. Runs hold (key, fingerprint, class), a class being one fingerprint and text, so a page copied a million times
is one row a table; classes are compared with classes, pages come in at the end.

Beside the keys stands one table by id: `h` and a content hash, or `c` and a class, each with the least and greatest
url_hash that has it, which tell whether another page than the probing one has it. Both tables only grow by the batch.
Texts are read by the exact check alone: those of classes in a window, found by a url_hash that has them.

The driver keeps the plans of what it has run for a while, so a batch is few jobs, and what the batches found is read
back as one table: the last plan is as large for a thousand batches as for two.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.runs import Runs
from ..runtime import Scratch, table
from . import alike
from .near_dups import BIG
from .residue import BLOCKS, simhash_tables
from .texts import readable, text_or_null

FAR, BITS, TABLES = 3, 63, math.comb(BLOCKS, 2)
_LOW = (1 << 63) - 1


def _ranges(slots: int) -> Column:
    """Equal ranges of the keys, which have less than 30 bits."""
    return F.shiftright(F.col("key") * slots, 30)


def _known(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "id").agg(F.first("tkey").alias("tkey"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class NeighbourIndex:
    """All earlier batches, in `folder`; another session opens it by that. Pages are (url_hash, chash, sim, tkey); chash,
    sim and tkey may be null. Rows without url_hash are left out; repeated rows count once; empty batches are fine."""

    def __init__(self, scratch: Scratch, folder: str | None = None):
        self.scratch, spark = scratch, scratch.spark
        folder = folder or scratch.path("index")
        self.keys = Runs(spark, f"{folder}/keys", "key long, sim long, cid long", ["key"], DataFrame.distinct, ranges=_ranges)
        self.known = Runs(spark, f"{folder}/known", "kind string, id string, tkey string, lo string, hi string", ["kind", "id"], _known)

    @staticmethod
    def _class() -> Column:
        return F.xxhash64("sim", "tkey")

    def _classed(self, batch: DataFrame) -> DataFrame:
        return batch.filter("url_hash is not null and sim is not null and tkey is not null").withColumn("cid", self._class())

    def pages(self, batch: DataFrame, name: Column) -> DataFrame:
        """batch, url_hash and class of pages of one batch or several, with repeats."""
        return self._classed(batch).select(name.alias("batch"), "url_hash", F.col("cid").alias("mine"))

    def probe(self, new: DataFrame, name: str | None = None, rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of a batch: exact(url_hash), pages with an equal content hash earlier; near(batch, mine, tkey, holder, other, lo, hi),
        its classes with earlier ones within FAR bits, to be checked; `pages`. `holder` and `lo` are pages that have the texts
        `tkey` and `other`; `lo` and `hi` are the least and greatest page of the earlier class. name: of the batch, which no
        other has. rows: at most so many has the batch; counted if not given.
        """
        s, another = self.scratch, (F.col("lo") != F.col("url_hash")) | (F.col("hi") != F.col("url_hash"))
        batch, n = F.lit(name or uuid.uuid4().hex), new.count() if rows is None else rows
        hashed = new.filter("url_hash is not null and chash is not null").select("url_hash", F.lit("h").alias("kind"), F.col("chash").alias("id"))
        same = _known(self.known.asked(hashed.select("kind", "id"), n=n))
        exact = hashed.join(same, ["kind", "id"]).filter(another).select("url_hash").distinct()
        classes = self._classed(new).groupBy("cid").agg(F.first("sim").alias("msim"), F.first("tkey").alias("tkey"), F.min("url_hash").alias("holder"))
        keyed = classes.select(F.col("cid").alias("mine"), "msim", F.explode(simhash_tables("msim", BITS)).alias("key"))
        window = self.keys.asked(keyed, "inner", 48, n * TABLES).filter(F.bit_count(F.col("msim").bitwiseXOR(F.col("sim"))) <= FAR)
        pairs = s.put(window.select("mine", "cid").distinct(), "pairs")
        held = _known(self.known.asked(pairs.select(F.lit("c").alias("kind"), F.col("cid").cast("string").alias("id"))))
        met = pairs.select("mine", F.col("cid").cast("string").alias("id")).join(held.select("id", F.col("tkey").alias("other"), "lo", "hi"), "id")
        near = met.join(classes.select(F.col("cid").alias("mine"), "tkey", "holder"), "mine").select(batch.alias("batch"), "mine", "tkey", "holder", "other", "lo", "hi")
        return s.put(exact, "exact"), s.put(near, "near"), self.pages(new, batch)

    def add(self, batch: DataFrame, rows: int | None = None) -> None:
        """Add a batch: one run of keys, one of hashes and classes. rows: at most so many has the batch; counted if not given."""
        ends = [F.min("url_hash").alias("lo"), F.max("url_hash").alias("hi")]
        classed = self._classed(batch)
        hashes = batch.filter("url_hash is not null and chash is not null").groupBy(F.lit("h").alias("kind"), F.col("chash").alias("id")).agg(F.lit(None).cast("string").alias("tkey"), *ends)
        self.known.append(classed.groupBy(F.lit("c").alias("kind"), F.col("cid").cast("string").alias("id")).agg(F.first("tkey").alias("tkey"), *ends).unionByName(hashes), n=rows and 2 * rows)
        self.keys.append(classed.select("cid", "sim").distinct().select(F.explode(simhash_tables("sim", BITS)).alias("key"), "sim", "cid"), n=rows and TABLES * rows)
        self.known.compact()
        self.keys.compact()


def arrivals(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    """Big pages with batch, folded content hash, low 63 bits of simhash and the key of their readable text, one folder a
    batch."""
    pages = table(spark, d, "pages").filter(f"size >= {BIG} and url_hash is not null and batch_no is not null")
    pages = pages.select("url_hash", "batch_no", F.lower(F.trim("content_hash")).alias("chash"), F.col("simhash").bitwiseAND(F.lit(_LOW)).alias("sim")).distinct()
    texts = table(spark, d, "extracted").filter("url_hash is not null").select(F.col("url_hash").alias("u"), F.md5(text_or_null(F.col("data_json"))).alias("tkey")).distinct()
    path = scratch.path("arrivals")
    pages.join(texts, F.col("url_hash") == F.col("u"), "left").drop("u").repartition("batch_no", F.pmod(F.xxhash64("url_hash"), F.lit(8))).write.partitionBy("batch_no").parquet(path)
    return spark.read.schema("url_hash string, chash string, sim long, tkey string, batch_no int").parquet(path)


def repeats(probed: list[tuple[DataFrame, DataFrame, DataFrame]], source: DataFrame, scratch: Scratch, build=None, pages: DataFrame | None = None) -> DataFrame:
    """url_hash of the pages of `probe` that are repeats, the near ones checked by source(url_hash, text), or what `build`
    makes of it; only records of wanted pages are parsed. Classes are checked and then come down to one row each, the least
    and greatest page they met, before pages come in. pages: those of all batches in one table, where there is one."""
    near = scratch.all([p[1] for p in probed])
    holders = scratch.put(near.select(F.col("holder").alias("u")).union(near.select("lo")).distinct(), "holders")
    side = F.broadcast(holders) if holders.count() <= alike.SENT else holders
    held = source.join(side, F.col("url_hash") == F.col("u"), "left_semi")
    read = (held if build is None else build(held)).select(F.md5("text").alias("id"), "text")
    ok = alike.verify(near.select(F.col("tkey").alias("a"), F.col("other").alias("b")), read, scratch)
    good = near.join(ok, (F.col("tkey") == F.col("a")) & (F.col("other") == F.col("b")), "left_semi")
    met = good.groupBy("batch", "mine").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pages = reduce(DataFrame.union, [p[2] for p in probed]) if pages is None else pages
    hit = pages.join(met, ["batch", "mine"]).filter((F.col("lo") != F.col("url_hash")) | (F.col("hi") != F.col("url_hash")))
    return scratch.all([p[0] for p in probed]).union(hit.select("url_hash")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Big pages that repeat, exactly or nearly, what an earlier batch brought."""
    scratch = Scratch(spark, "p3")
    pages = arrivals(spark, d, scratch)
    index, probed = NeighbourIndex(scratch), []
    for i, (no, n) in enumerate(pages.groupBy("batch_no").count().orderBy("batch_no").collect()):  # batches, not rows
        batch = pages.filter(F.col("batch_no") == no).drop("batch_no")
        if i:
            probed.append(index.probe(batch, str(no), n))
        index.add(batch, n)
    if not probed:
        return pages.select("url_hash").limit(0)
    every = index.pages(pages, F.col("batch_no").cast("string"))
    return repeats(probed, table(spark, d, "extracted").select("url_hash", "data_json"), scratch, readable, every)
