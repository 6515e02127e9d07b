"""Metrics over long tables: counters, gauges, bounded histograms, quantiles, rates, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RING, SERIES = 2048, 1024
LEVELS = {"ok": 0, "unknown": 1, "warn": 2, "critical": 3}


def series_key(name: Column, labels: Column) -> Column:
    """MAP-01: name{a=1,b=2}, labels sorted, null ones left out."""
    kept = F.map_filter(labels, lambda k, v: v.isNotNull())
    body = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.when(F.coalesce(body, F.lit("")) == "", name).otherwise(F.concat(name, F.lit("{"), body, F.lit("}")))


def quantiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """AGG-08: count, sum, least, greatest and the linear quantiles."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    x = df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"), q.alias("q"))
    return x.select(by, "n", "total", "least", "greatest", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


def floor_quantile(value: Column, q: float) -> Column:
    """AGG-07: element min(n - 1, int(q * n)) of the sorted values, as an aggregate. percentile_disc would round the
    other way, so the place is computed; meant for groups of bounded size such as one run's latencies."""
    a = F.sort_array(F.collect_list(value))
    return F.element_at(a, F.least(F.size(a), F.floor(F.size(a) * F.lit(q)).cast("int") + 1))


def last_rows(df: DataFrame, by: str, *order: str, keep: int, salts: int = 32) -> DataFrame:
    """The last `keep` rows of each key, with their place from the end in `rn`. A hot key is cut down in `salts` parts
    first, so no task holds more than salts * keep of its rows at the end."""
    back = [F.col(c).desc() for c in order]
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    x = part.withColumn("rn", F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*back))).filter(F.col("rn") <= keep)
    return x.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*back))).filter(F.col("rn") <= keep).drop("_salt")


def ring(df: DataFrame, by: str, value: str, *order: str, keep: int = RING) -> DataFrame:
    """WIN-01: count over all values, quantiles over the last `keep`; dropped = the rest."""
    n = df.groupBy(by).agg(F.count(value).alias("n"))
    y = last_rows(df, by, *order, keep=keep).groupBy(by).agg(F.count(value).alias("kept"), F.percentile(value, F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return n.join(y, by).select(by, "n", "kept", (F.col("n") - F.col("kept")).alias("dropped"), F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"))


def capped_series(df: DataFrame, key: str, *order: str, most: int = SERIES) -> DataFrame:
    """AGG-10: per series its operations and whether it is among the first `most` seen; `most` names are sent to all."""
    first = df.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))
    kept = first.orderBy("seen").limit(most).select(F.col(key).alias("_k"), F.lit(True).alias("kept"))
    return first.join(F.broadcast(kept), F.col(key) == F.col("_k"), "left").select(key, "n", F.coalesce("kept", F.lit(False)).alias("kept"))


def sliding_rate(df: DataFrame, by: str, t: Column, window: float = 60.0, points: int = 256) -> DataFrame:
    """WIN-02: per series the rate of its running count at its last point: against the earliest of the last `points`
    within the window. The running count at a point is the whole count less the rows after it, so no key is sorted whole."""
    x = df.withColumn("t", t)
    n = x.groupBy(by).agg(F.count("*").alias("_n"), F.max("t").alias("now"))
    y = last_rows(x, by, "t", "id", keep=points).join(n, by).withColumn("total", F.col("_n") - F.col("rn") + 1)
    z = y.groupBy(by).agg(F.max(F.struct("t", "total")).alias("z"), F.min(F.when(F.col("t") >= F.col("now") - window, F.struct("t", "total"))).alias("a"))
    return z.select(by, F.round((F.col("z.total") - F.col("a.total")) / F.greatest(F.col("z.t") - F.col("a.t"), F.lit(1e-6)), 6).alias("rate"))


def polite_slots(df: DataFrame, by: str, t: Column, gap: float) -> DataFrame:
    """WIN-08: start of each request, at least `gap` after the one before: a running maximum instead of a loop."""
    w = Window.partitionBy(by).orderBy("t", "id")
    x = df.withColumn("t", t).withColumn("k", F.row_number().over(w))
    return x.withColumn("start", F.max(F.col("t") - F.col("k") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k") * gap)


def throttle_runs(df: DataFrame, by: str, is_throttle: Column, *order: str) -> DataFrame:
    """WIN-09: consecutive throttles at each row; any other row resets."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_t", F.when(is_throttle, 1).otherwise(0)).withColumn("_g", F.sum(1 - F.col("_t")).over(w))
    g = Window.partitionBy(by, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("run", F.sum("_t").over(g)).drop("_t", "_g")


def usage_level(value: Column, limit: Column, pct: float) -> Column:
    """AGG-12: level of a value against its limit; unknown without either."""
    used = value / limit * 100.0
    return F.when(value.isNull() | limit.isNull() | (limit <= 0), "unknown").when(used >= min(100.0, pct + 20.0), "critical").when(used >= pct, "warn").otherwise("ok")


def failure_level(done: Column, failed: Column, pct: float) -> Column:
    rate = F.when(done + failed > 0, failed / (done + failed) * 100.0)
    return F.when(rate.isNull(), "unknown").when(rate >= pct * 1.5, "critical").when(rate >= pct, "warn").otherwise("ok")


def worst(level: Column) -> Column:
    """AGG-13: the most severe level, as an aggregate."""
    return F.max_by(level, F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), level))


def slope_per_minute(t: Column, y: Column) -> Column:
    """AGG-21: least-squares slope a minute; null below three points or without spread."""
    return F.when((F.count(y) >= 3) & (F.var_pop(t) > 0), F.regr_slope(y, t / 60.0))


def snapshot(series: DataFrame) -> DataFrame:
    """AGG-09, AGG-11: rows (name, kind, series, t, value) to one row a series: counters summed, gauges at their last value,
    histograms with count and linear quantiles. A series with two kinds is a conflict and says so."""
    kind = F.when(F.countDistinct("kind") > 1, "conflict").otherwise(F.first("kind"))
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    x = series.groupBy("name", "series").agg(kind.alias("kind"), F.count("value").alias("n"), F.sum("value").alias("total"), F.max_by("value", "t").alias("last"), q.alias("q"))
    value = F.when(F.col("kind") == "counter", F.col("total")).when(F.col("kind") == "gauge", F.col("last")).when(F.col("kind") == "histogram", F.col("q")[0])
    return x.select("name", "series", "kind", "n", F.round(value, 6).alias("value"), F.when(F.col("kind") == "histogram", F.round(F.col("q")[1], 6)).alias("p95"))


def by_prefix(snap: DataFrame, prefix: str) -> DataFrame:
    """AGG-11: series whose name begins with `prefix`."""
    return snap.filter(F.startswith("name", F.lit(prefix)))


def regressions(runs: DataFrame, pct: float = 20.0) -> DataFrame:
    """AGG-22, AGG-23: runs(run, metric, higher_is_better, value) with run `base` and `new`, repeated: medians, the change
    in percent and a verdict (worse by more than `pct`: regressed; `unknown` without a base that is not 0)."""
    m = runs.groupBy("metric", "higher_is_better").agg(F.median(F.when(F.col("run") == "base", F.col("value"))).alias("base"), F.median(F.when(F.col("run") == "new", F.col("value"))).alias("new"))
    delta = F.when(F.col("base") != 0, (F.col("new") - F.col("base")) / F.col("base") * 100.0)
    worse = F.when(F.col("higher_is_better"), -delta).otherwise(delta)
    return m.select("metric", F.round("base", 6).alias("base"), F.round("new", 6).alias("new"), F.round(delta, 4).alias("delta_pct"), F.when(worse.isNull(), "unknown").when(worse > pct, "regressed").when(worse < -pct, "improved").otherwise("ok").alias("verdict"))


def peaks(spans: DataFrame, by: str, begin: str, end: str) -> DataFrame:
    """SUP-07: the most spans open at once, per key: a running sum over begins and ends; an end frees before a begin takes."""
    e = F.explode(F.array(F.struct(F.col(begin).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"))))
    x = spans.filter(F.col(begin).isNotNull() & F.col(end).isNotNull()).select(by, e.alias("e")).groupBy(by, "e.t", "e.d").agg(F.sum("e.d").alias("d2"))
    w = Window.partitionBy(by).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("open", F.sum("d2").over(w)).groupBy(by).agg(F.max("open").alias("peak"))


def backoff(failures: Column) -> Column:
    """MATH-01: seconds to wait after so many failures."""
    return F.least(F.lit(8.0), 0.5 * F.pow(F.lit(2.0), F.least(failures, F.lit(8))))


def retry_delay(attempt: Column, seed: Column) -> Column:
    """MATH-02: doubled delay of a network retry, spread by half either way by a hash of `seed`, so runs can be repeated."""
    spread = F.pmod(F.xxhash64(seed), F.lit(1_000_000)) / 1e6
    return F.least(F.lit(8.0), 0.5 * F.pow(F.lit(2.0), attempt - 1)) * (0.5 + spread)


def bucket(df: DataFrame, by: str, t: Column, rate: float, burst: float) -> DataFrame:
    """MATH-04: a token bucket over the requests of a key in time: `start` of each, with `burst` tokens at first and `rate`
    a second after: the k-th waits until the running maximum of t - k / rate allows it."""
    w = Window.partitionBy(by).orderBy("t", "id")
    x = df.withColumn("t", t).withColumn("k", F.row_number().over(w))
    floor = F.max(F.col("t") - (F.col("k") - 1) / F.lit(rate)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("start", F.greatest("t", floor + (F.col("k") - burst) / F.lit(rate)))
