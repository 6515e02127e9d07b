"""File sources and sinks: link lists, tagged JSON lines, dead letters, stores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: one URL a line; blank lines and # comments are skipped."""
    x = spark.read.text(path).select(F.trim("value").alias("url"))
    return x.filter((F.col("url") != "") & ~F.startswith(F.col("url"), F.lit("#")))


def text_links(lines: DataFrame, no: str, line: str) -> DataFrame:
    """SRC-19: the first URL of each line, without closing punctuation; its first line and how often it stands."""
    url = F.regexp_replace(F.regexp_extract(line, r"(?i)https?://[^\s<>\"'，。；、）】》]+", 0), r"[.,;:!?)\]}]+$", "")
    x = lines.select(F.col(no).alias("no"), url.alias("url")).filter("url <> ''")
    return x.groupBy("url").agg(F.min("no").alias("line"), F.count("*").alias("times"))


def decoded_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-19: the lines (path, no, line) of text files in UTF-8 (with a mark or not), UTF-16 with a mark, or else GBK."""

    @F.pandas_udf("string")
    def read(body: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
                if b.startswith(mark):
                    return b.decode(name, "replace")
            try:
                return b.decode("utf-8")
            except UnicodeDecodeError:
                return b.decode("gbk", "replace")

        return body.map(lambda b: one(bytes(b)))

    x = spark.read.format("binaryFile").load(path).select("path", read("content").alias("text"))
    return x.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("no", "line"))


def hashes(spark: SparkSession, path: str, n: int = 64) -> DataFrame:
    """SRC-25: path, length and the first n hex digits of SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.substring(F.sha2("content", 256), 1, n).alias("sha256"))


def url_blocks(urls: DataFrame, url: str, host: Column) -> DataFrame:
    """SRC-20: addresses as text lines by host: (host, line) with the host as a heading line, '' before each but ordered
    by host and line number so that a sorted text sink gives the blocks; no host is gathered in one row."""
    x = urls.select(host.alias("host"), F.col(url).alias("line")).filter("line is not null").distinct()
    heads = x.select("host").distinct().select("host", F.concat(F.lit("# "), F.col("host")).alias("line"), F.lit(0).alias("part"))
    return heads.unionByName(x.withColumn("part", F.lit(1))).orderBy("host", "part", "line")


LOG = "ts double, level string, logger string, message string, fields map<string,string>, error string"


def logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-27: structured log records of JSON lines; corrupt lines are skipped."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path)


def json_lines(rows: DataFrame, path: str) -> None:
    """SRC-15 to SRC-17: append ready lines (column `line`)."""
    rows.select("line").write.mode("append").text(path)


DEAD = "at double, label string, error string, statements string"


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: dead letters, corrupt lines skipped."""
    return spark.read.schema(DEAD).option("mode", "DROPMALFORMED").json(path)


def newest_dead_letters(letters: DataFrame, n: int = 5) -> DataFrame:
    """WIN-07: the newest n of each label."""
    w = Window.partitionBy("label").orderBy(F.col("at").desc(), "error")
    return letters.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def count_dead_letters(letters: DataFrame) -> DataFrame:
    """SRC-14: dead letters by label."""
    return letters.groupBy("label").agg(F.count("*").alias("n"))


def replay_script(letters: DataFrame) -> DataFrame:
    """SRC-14: dead letters as lines of a script, oldest first: a comment with time, label and error, then the statements."""
    head = F.concat(F.lit("-- "), F.col("at").cast("string"), F.lit(" "), F.col("label"), F.lit(" "), F.regexp_replace("error", r"\s+", " "))
    return letters.orderBy("at", "label").select(F.concat(head, F.lit("\n"), F.col("statements")).alias("line"))


def commit_batch(rows: DataFrame, batch: int, good, path: str, dead_path: str) -> None:
    """SRC-13, STM-14: a micro-batch in foreachBatch: good rows to the table, the others to the dead letters, each in a
    folder of the batch that is replaced as a whole, so a batch that comes again doubles nothing. Read with
    `spark.read.parquet(path)`: the batch is a partition column."""
    ok = F.coalesce(good, F.lit(False))
    rows.filter(ok).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    bad = rows.filter(~ok).select(F.unix_timestamp().cast("double").alias("at"), F.lit("row").alias("label"), F.lit("rejected").alias("error"), F.to_json(F.struct("*")).alias("statements"))
    bad.write.mode("overwrite").json(f"{dead_path}/batch={batch}")


def split_and_write(rows: DataFrame, good, path: str, dead_path: str) -> None:
    """Rows that meet `good` to the table, the others to the dead letters, once; in foreachBatch use `commit_batch`."""
    rows.filter(good).write.mode("append").parquet(path)
    rows.filter(~F.coalesce(good, F.lit(False))).select(F.unix_timestamp().cast("double").alias("at"), F.lit("row").alias("label"), F.lit("rejected").alias("error"), F.to_json(F.struct("*")).alias("statements")).write.mode("append").json(dead_path)


LETTER = "struct<at: double, label: string, error: string, statements: string>"


def letter_json(at: Column, label: Column, error: Column, statements: Column) -> Column:
    """SUP-33: a dead letter as JSON text; `F.from_json` with LETTER brings it back."""
    return F.to_json(F.struct(at.alias("at"), label.alias("label"), error.alias("error"), statements.alias("statements")))


def missing(requested: Column, found: Column) -> Column:
    """SET-05: what was asked for and is not there."""
    return F.array_except(requested, found)
