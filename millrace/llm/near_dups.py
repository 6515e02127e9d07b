"""Problem 7: records that are the same text with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import Scratch, table
from . import chosen_path
from .texts import text_or_null

#: Least pages.size of a big page.
BIG = 500


def similar_sets(records: DataFrame, scratch: Scratch, build=None) -> tuple[DataFrame, DataFrame]:
    """records(id, text), or what `build` makes them of, to members(id, sid) and links(a, b): the pairs of different sets that are alike.

    Sets without a token run are alike to nothing and have no members. Each set is checked by one record that has it;
    classes are never expanded here. An id with several texts is a member of each one's set. Null texts are
    no members; repeated rows count once.
    """
    members, links = chosen_path.similar(records, scratch, build)
    return members.distinct(), links


def big_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(f"size >= {BIG} and url_hash is not null").select("url_hash").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """All alike pairs of readable records of big pages, equal texts included (a < b)."""
    scratch = Scratch(spark, "p7")
    records = table(spark, d, "extracted").filter("url_hash is not null").select(F.col("url_hash").alias("id"), "data_json")
    members, links = similar_sets(records, scratch, lambda r: r.select("id", text_or_null(F.col("data_json")).alias("text")))
    big = scratch.put(members.join(big_pages(spark, d), F.col("id") == F.col("url_hash"), "left_semi"), "members")
    both = links.union(links.select("b", "a")).union(big.select(F.col("sid").alias("a"), F.col("sid").alias("b")).distinct())
    x = both.join(big.select(F.col("sid").alias("a"), F.col("id").alias("url_hash_a")), "a").join(big.select(F.col("sid").alias("b"), F.col("id").alias("url_hash_b")), "b")
    return x.filter("url_hash_a < url_hash_b").select("url_hash_a", "url_hash_b").distinct()
