"""Streaming equals batch under availableNow; file sources."""

from pyspark.sql import functions as F

from millrace.sources import files
from millrace.streaming import evidence


def test_rates_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 50:02}:{i % 60:02}", "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    s = evidence.rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "5 minutes", "5 minutes", "2 hours")
    q = s.writeStream.outputMode("complete").format("memory").queryName("rates_t").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["s"], r["event_type"], r["n"]) for r in spark.sql("select string(window.start) s, event_type, n from rates_t").collect()}
    want = {(r["s"], r["event_type"], r["n"]) for r in df.groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes"), "event_type").agg(F.count("*").alias("n")).selectExpr("string(window.start) s", "event_type", "n").collect()}
    assert got == want and want


def test_files(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# c\nhttp://a/\n\n http://b/ \n")
    assert {r[0] for r in files.url_list(spark, str(tmp_path / "urls.txt")).collect()} == {"http://a/", "http://b/"}
    x = spark.createDataFrame([(1, "see http://a/x。"), (2, "http://a/x, ok"), (3, "none")], "no long, line string")
    assert [tuple(r) for r in files.text_links(x, "no", "line").collect()] == [("http://a/x", 1, 2)]
    df = spark.createDataFrame([(1, "ok"), (2, None)], "id long, v string")
    files.split_and_write(df, F.col("v").isNotNull(), str(tmp_path / "t"), str(tmp_path / "dead"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and files.dead_letters(spark, str(tmp_path / "dead")).count() == 1
