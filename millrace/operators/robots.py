"""robots.txt: parsing to rules, and decisions by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def parse(texts: DataFrame, host: str, text: str) -> DataFrame:
    """URL-07: rules (host, agent, allow, pattern) of robots texts; an empty Disallow allows all (RFC 9309) and gives none.

    A group begins at a user-agent line that does not follow another one.
    """
    lines = texts.select(F.col(host).alias("host"), F.posexplode(F.split(text, r"\r?\n")).alias("no", "raw"))
    l1 = F.trim(F.regexp_replace("raw", "#.*$", ""))
    x = lines.select("host", "no", F.lower(F.trim(F.regexp_extract(l1, "^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract(l1, "^[^:]+:(.*)$", 1)).alias("v")).filter("k in ('user-agent','allow','disallow')")
    w = Window.partitionBy("host").orderBy("no")
    x = x.withColumn("starts", (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")).withColumn("grp", F.sum(F.col("starts").cast("int")).over(w))
    agents = x.filter("k = 'user-agent'").select("host", "grp", F.lower("v").alias("agent"))
    rules = x.filter("k <> 'user-agent' and v <> ''").select("host", "grp", (F.col("k") == "allow").alias("allow"), F.col("v").alias("pattern"))
    return agents.join(rules, ["host", "grp"]).select("host", "agent", "allow", "pattern")


def matches(pattern: Column, path: Column) -> Column:
    """FLT-08: `*` stands for anything, a final `$` for the end, else a prefix."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.\\+?^\[\](){}|$])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(F.endswith(pattern, F.lit("$")), "$").otherwise(""))
    return F.regexp_like(path, regex)


def decide(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """JOIN-04: urls(url, host, path) with `allowed`: the group of the longest name within the agent (else `*`), there
    the longest matching pattern, Allow winning ties; no rule allows. Joined by host, so only its rules meet a URL."""
    name = agent.lower()
    usable = rules.filter(F.contains(F.lit(name), F.col("agent")) | (F.col("agent") == "*")).withColumn("rank", F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")))
    best = usable.groupBy(F.col("host").alias("bh")).agg(F.max("rank").alias("br"))
    mine = usable.join(best, (F.col("host") == F.col("bh")) & (F.col("rank") == F.col("br"))).select(F.col("host").alias("rhost"), "allow", "pattern").distinct()
    x = urls.join(mine, (F.col("host") == F.col("rhost")) & matches(F.col("pattern"), F.col("path")), "left")
    size = F.length(F.regexp_replace("pattern", r"\$$", ""))
    return x.groupBy("url", "host", "path").agg(F.coalesce(F.max_by("allow", F.struct(size, "allow")), F.lit(True)).alias("allowed"))
