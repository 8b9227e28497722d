"""Queries over time series and measurements; events are points of one metric tagged by type, and latencies of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measure as M
from ..operators import timeseries as T
from ..sources import text as X
from .registry import micros, query, table

S = "epoch_us(ts) // 1000000"
DAY10, DAY20 = 1704844800, 1705708800


def points(spark: SparkSession, d: str, q: T.TimeQuery | None = None) -> DataFrame:
    """(event_type, user_id, ts in seconds, value), of the query's times."""
    events = table(spark, d, "events")
    return micros(events.where(T.within(q)) if q else events).select("event_id", "event_type", "user_id", F.floor(F.col("us") / 1_000_000).cast("long").alias("ts"), "value")


def _scan(spark: SparkSession, d: str, *parts: str, keep: tuple[str, ...] = ("event_type", "ts", "value")) -> DataFrame:
    q = T.parse(list(parts))
    status, rows = T.scan(points(spark, d, q).select(*keep), None, q)
    if status != T.OK:
        raise ValueError(status)
    return rows


@query(f"SELECT event_type, {S} AS ts, value FROM events WHERE {S} = 1704067432 AND event_type IN ('view', 'error', 'click') OR {S} = 1704067432 AND event_type = 'none'")
def ts_point(spark: SparkSession, d: str) -> DataFrame:
    q = T.parse(["YCSBTS=1704067432", "event_type=view", "event_type=error", "event_type=click"])
    return T.read(points(spark, d, q).select("event_type", "ts", "value"), None, q)[1]


@query(f"SELECT event_type, {S} AS ts, value FROM events WHERE {S} BETWEEN {DAY10} AND {DAY20} AND event_type IN ('view', 'click')")
def ts_range(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, f"YCSBTS={DAY10},{DAY20}", "event_type=view", "event_type=click")


def _group_sql(f: str) -> str:
    return f"SELECT event_type, {S} // 3600 * 3600 AS ts, {f} AS value FROM events WHERE {S} BETWEEN {DAY10} AND {DAY20} GROUP BY 1, 2"


def _group(spark: SparkSession, d: str, function: str) -> DataFrame:
    rows = points(spark, d).withColumn("ts", T.bucket(F.col("ts"), 3600))
    q = T.parse([f"YCSBTS={DAY10},{DAY20}", "event_type", f"YCSBGB={function}"])
    return T.scan(rows.select("event_type", "ts", "value"), None, q)[1]


@query(_group_sql("round(sum(value), 4)").replace(f"BETWEEN {DAY10} AND {DAY20}", f"// 3600 * 3600 BETWEEN {DAY10} AND {DAY20}"))
def ts_groupby_sum(spark: SparkSession, d: str) -> DataFrame:
    return _group(spark, d, "SUM").withColumn("value", F.round("value", 4))


@query(_group_sql("round(avg(value), 6)").replace(f"BETWEEN {DAY10} AND {DAY20}", f"// 3600 * 3600 BETWEEN {DAY10} AND {DAY20}"))
def ts_groupby_avg(spark: SparkSession, d: str) -> DataFrame:
    return _group(spark, d, "AVERAGE").withColumn("value", F.round("value", 6))


@query(_group_sql("count(value)").replace(f"BETWEEN {DAY10} AND {DAY20}", f"// 3600 * 3600 BETWEEN {DAY10} AND {DAY20}"))
def ts_groupby_count(spark: SparkSession, d: str) -> DataFrame:
    return _group(spark, d, "COUNT")


@query(_group_sql("min(value)").replace(f"BETWEEN {DAY10} AND {DAY20}", f"// 3600 * 3600 BETWEEN {DAY10} AND {DAY20}"))
def ts_groupby_min(spark: SparkSession, d: str) -> DataFrame:
    return _group(spark, d, "MIN")


@query(_group_sql("max(value)").replace(f"BETWEEN {DAY10} AND {DAY20}", f"// 3600 * 3600 BETWEEN {DAY10} AND {DAY20}"))
def ts_groupby_max(spark: SparkSession, d: str) -> DataFrame:
    return _group(spark, d, "MAX")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def ts_downsample_hour(spark: SparkSession, d: str) -> DataFrame:
    return T.downsample(table(spark, d, "events"), ["event_type"], "ts", "1 hour", "SUM").withColumn("value", F.round("value", 4))


@query(f"SELECT event_type, {S} // 21600 * 21600 AS ts, max(value) AS value FROM events WHERE {S} BETWEEN {DAY10} AND {DAY20} GROUP BY 1, 2")
def ts_downsample(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, f"YCSBTS={DAY10},{DAY20}", "YCSBDS=MAX21600")


@query(f"""SELECT event_type, ts // 21600 * 21600 AS ts, max(value) AS value FROM (
  SELECT event_type, {S} AS ts, round(sum(value), 4) AS value FROM events WHERE {S} BETWEEN {DAY10} AND {DAY20} GROUP BY 1, 2) GROUP BY 1, 2""")
def ts_groupby_downsample(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, f"YCSBTS={DAY10},{DAY20}", "event_type", "YCSBGB=SUM", "YCSBDS=MAX=21600").withColumn("value", F.round("value", 4))


@query(f"SELECT event_id, event_type, {S} AS ts, value FROM events WHERE NOT ({S} BETWEEN {DAY10} AND {DAY20} AND event_type = 'view')")
def ts_delete_range(spark: SparkSession, d: str) -> DataFrame:
    _, q = T.parse_delete(f"m:event_type=view:user_id:YCSBTS={DAY10},{DAY20}")
    return T.delete(points(spark, d).drop("user_id"), None, q)


@query(f"""SELECT event_type, ts, event_id, value FROM (SELECT event_type, {S} // 600 * 600 AS ts, event_id, value,
  row_number() OVER (PARTITION BY event_type, {S} // 600 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def ts_overwrite(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).drop("user_id").withColumn("ts", T.bucket(F.col("ts"), 600))
    return T.overwrite(rows, ["event_type"], "ts", "event_id")


@query(f"SELECT event_id, CASE WHEN (user_id % 100) / 100.0 < 0.3 THEN {S} - 60 * ((user_id % 100) % 4) ELSE {S} END AS ts FROM events")
def ts_late_points(spark: SparkSession, d: str) -> DataFrame:
    late = T.delayed(F.col("ts"), F.col("user_id") % 100, 100, 0.3, 4, 60)
    return points(spark, d).select("event_id", late.cast("long").alias("ts"))


US = "CAST(round(value * 1000) AS BIGINT)"


def latencies(spark: SparkSession, d: str) -> DataFrame:
    """(op, ts, ms, latency_us, status, user_id)"""
    rows = micros(table(spark, d, "events"))
    return rows.select(
        F.col("event_type").alias("op"), "event_id", "user_id", "ts", F.floor(F.col("us") / 1000).cast("long").alias("ms"), F.round(F.col("value") * 1000).cast("long").alias("latency_us"),
        F.when(F.col("user_id") % 7 == 0, "NOT_FOUND").when(F.col("user_id") % 11 == 0, "ERROR").otherwise("OK").alias("status"),
    )


@query(f"""SELECT op, count(*) AS n, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99
FROM (SELECT event_type AS op, {US} AS v FROM events) GROUP BY op""")
def lat_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(latencies(spark, d), ["op"], "latency_us").withColumn("mean", F.round("mean", 4))


HIST = f"h AS (SELECT op, bucket, count(*) AS n FROM (SELECT event_type AS op, least({US} // 1000, 200) AS bucket FROM events) GROUP BY 1, 2)"


@query(f"WITH {HIST} SELECT op, bucket, n, CAST(sum(n) OVER (PARTITION BY op ORDER BY bucket) AS BIGINT) AS upto FROM h")
def lat_hist_ms(spark: SparkSession, d: str) -> DataFrame:
    return M.bucket_histogram(latencies(spark, d), ["op"], "latency_us", 200)


@query(f"""WITH {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY bucket) / sum(n) OVER (PARTITION BY op) AS q FROM h),
m AS (SELECT event_type AS op, round(avg({US}), 3) AS mean, round(var_pop({US}) / 1e6, 3) AS variance_ms FROM events GROUP BY 1)
SELECT op, mean, variance_ms, CAST(min(bucket * 1000) FILTER (bucket < 200 AND q >= 0.95) AS BIGINT) AS p95_us, CAST(min(bucket * 1000) FILTER (bucket < 200 AND q >= 0.99) AS BIGINT) AS p99_us
FROM c JOIN m USING (op) GROUP BY ALL""")
def lat_hist_summary(spark: SparkSession, d: str) -> DataFrame:
    out = M.bucket_summary(latencies(spark, d), ["op"], "latency_us", 200)
    return out.select("op", F.round("mean", 3).alias("mean"), F.round(F.col("variance") / 1e6, 3).alias("variance_ms"), "p95_us", "p99_us")


PERCENTILES = [0.01, 0.05, 0.5, 0.9, 0.95, 0.99, 0.999, 0.9999]


@query(f"""WITH v AS (SELECT event_type AS op, {US} AS v, row_number() OVER (PARTITION BY event_type ORDER BY {US}) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT op, p, v AS value FROM v, (SELECT CAST(unnest({PERCENTILES}) AS DOUBLE) AS p) WHERE i = floor(n * p)""")
def lat_raw_pct(spark: SparkSession, d: str) -> DataFrame:
    return M.raw_percentiles(latencies(spark, d), ["op"], "latency_us", PERCENTILES)


@query(f"""WITH e AS (SELECT event_type AS op, epoch_us(ts) // 1000 AS ms, {US} AS v FROM events), f AS (SELECT op, min(ms) AS first FROM e GROUP BY op)
SELECT op, CAST((ms - first) // 3600000 * 3600000 AS BIGINT) AS step, count(*) AS n, round(avg(v), 4) AS mean FROM e JOIN f USING (op) GROUP BY 1, 2""")
def lat_timeseries(spark: SparkSession, d: str) -> DataFrame:
    return M.latency_series(latencies(spark, d), ["op"], "ms", "latency_us", 3_600_000).withColumn("mean", F.round("mean", 4))


#: The bounds by their rule, as SQL: ones up to nine, then sixteen steps of each power of ten.
BOUNDS = """b AS (SELECT b, CAST(row_number() OVER (ORDER BY b) - 1 AS INT) AS i FROM (
  SELECT CAST(unnest(range(1, 10)) AS DOUBLE) AS b UNION ALL
  SELECT s * pow(10, e) FROM (SELECT unnest([10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90]) AS s), (SELECT unnest(range(0, 9)) AS e))),
l AS (SELECT i, b AS high, coalesce(lag(b) OVER (ORDER BY i), 0.0) AS low FROM b),
h AS (SELECT op, i AS bucket, low, high, count(*) AS n FROM (SELECT event_type AS op, CAST(round(value * 1000) AS BIGINT) AS v FROM events) JOIN l ON v >= low AND v < high GROUP BY ALL),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY op ORDER BY bucket) AS BIGINT) AS upto, sum(n) OVER (PARTITION BY op) AS total FROM h)"""


@query(f"WITH {BOUNDS} SELECT op, bucket, n, low, high, upto FROM c")
def lat_logbuckets(spark: SparkSession, d: str) -> DataFrame:
    return M.log_histogram(latencies(spark, d), ["op"], "latency_us")


@query(f"""WITH {BOUNDS}, e AS (SELECT event_type AS op, min(CAST(round(value * 1000) AS BIGINT)) AS lo, max(CAST(round(value * 1000) AS BIGINT)) AS hi FROM events GROUP BY 1)
SELECT op, p, round(greatest(least(low + (high - low) * ((total * (p / 100.0) - (upto - n)) / n), hi), lo), 4) AS value
FROM c JOIN e USING (op), (SELECT CAST(unnest([50, 95, 99]) AS DOUBLE) AS p) WHERE upto >= total * (p / 100.0) AND upto - n < total * (p / 100.0)""")
def lat_log_pct(spark: SparkSession, d: str) -> DataFrame:
    return M.log_percentiles(latencies(spark, d), ["op"], "latency_us", [50, 95, 99]).withColumn("value", F.round("value", 4))


@query(f"WITH {BOUNDS} SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def lat_hist_merge(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_histograms(M.log_histogram(latencies(spark, d), ["op"], "latency_us"), [])


@query(f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.99) AS p99,
  quantile_disc(v, 0.999) AS p99_9, quantile_disc(v, 0.9999) AS p99_99 FROM (SELECT ts, {US} AS v FROM events) GROUP BY 1""")
def lat_interval(spark: SparkSession, d: str) -> DataFrame:
    return M.interval_summary(latencies(spark, d), "ts", "1 day", "latency_us").withColumn("mean", F.round("mean", 4))


STATUS = "CASE WHEN user_id % 7 = 0 THEN 'NOT_FOUND' WHEN user_id % 11 = 0 THEN 'ERROR' ELSE 'OK' END"


@query(f"SELECT event_type AS op, {STATUS} AS status, count(*) AS n FROM events GROUP BY 1, 2")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.status_counts(latencies(spark, d), "op", "status")


@query(f"""SELECT CASE {STATUS} WHEN 'OK' THEN event_type WHEN 'NOT_FOUND' THEN event_type || '-NOT_FOUND' ELSE event_type || '-FAILED' END AS label, count(*) AS n FROM events GROUP BY 1""")
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = latencies(spark, d).withColumn("label", M.relabelled(F.col("op"), F.col("status"), ["NOT_FOUND"]))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT event_type AS op, count(*) AS n, round(1000.0 * count(*) / (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)), 6) AS ops_per_sec FROM events GROUP BY 1")
def throughput_overall(spark: SparkSession, d: str) -> DataFrame:
    return M.throughput(latencies(spark, d), ["op"], F.max("ms") - F.min("ms")).withColumn("ops_per_sec", F.round("ops_per_sec", 6))


@query("""SELECT start, n, CAST(sum(n) OVER (ORDER BY start) AS BIGINT) AS total, n / 86400 AS ops_per_sec, n - lag(n) OVER (ORDER BY start) AS change
FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1)""")
def throughput_interval(spark: SparkSession, d: str) -> DataFrame:
    return M.interval_throughput(table(spark, d, "events"), "ts", "1 day", 86400)


@query("SELECT event_type AS workload, user_id % 4 AS db, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY 1, 2")
def run_mean_std(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("db", F.col("user_id") % 4).withColumnRenamed("event_type", "workload")
    return M.repeats(rows, ["workload", "db"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT user_id AS worker, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percent FROM events WHERE event_type = 'signup' GROUP BY 1")
def worker_share(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type = 'signup'").withColumnRenamed("user_id", "worker")
    return M.shares(rows, "worker").withColumn("percent", F.round("percent", 9))


@query(f"""WITH t AS (SELECT round(sum(rate), 6) AS ops_per_sec, count(*) AS threads FROM (SELECT user_id, count(*) / 60.0 AS rate FROM events GROUP BY 1))
SELECT ops_per_sec, threads, count(*) AS n, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, quantile_disc(v, 0.999) AS p99_9
FROM (SELECT {US} AS v FROM events), t GROUP BY ops_per_sec, threads""")
def thread_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.thread_totals(latencies(spark, d), "user_id", "latency_us", 60).withColumns({"ops_per_sec": F.round("ops_per_sec", 6), "mean": F.round("mean", 4)})


@query("SELECT event_type, user_id, props, count(*) AS n FROM events GROUP BY ALL")
def request_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.request_counts(table(spark, d, "events"), ["event_type", "user_id", "props"])


@query("SELECT event_type, count(DISTINCT user_id) AS n_series, count(DISTINCT ts) AS n_times, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def series_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.series_counts(table(spark, d, "events"), ["event_type"], ["user_id"], "ts")


@query("SELECT event_id, event_type AS op, 'AverageLatency(us)' AS metric, value FROM events WHERE event_type <> 'error'")
def result_log_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a result log made of events and read again; those whose value isn't a number are left out."""
    value = F.when(F.col("event_type") == "error", "none").otherwise(F.col("value").cast("string"))
    lines = table(spark, d, "events").select("event_id", F.concat(F.lit("["), "event_type", F.lit("], AverageLatency(us), "), value).alias("line"))
    return X.metrics(lines)


@query("""SELECT event_id, date_trunc('millisecond', ts) AS at, event_id * 10 AS sec, event_id AS operations, value AS ops_per_sec FROM events""")
def status_log_parse(spark: SparkSession, d: str) -> DataFrame:
    at = F.concat_ws(":", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("ts", "SSS"))
    line = F.concat(at, F.lit(" "), (F.col("event_id") * 10).cast("string"), F.lit(" sec: "), F.col("event_id").cast("string"), F.lit(" operations; "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" current ops/sec; est completion in 1 minute"))
    return X.statuses(table(spark, d, "events").select("event_id", line.alias("line")))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS worker, CAST(2 AS INT) AS n_inputs, 'sstable1/' || event_id || '.sst' AS output FROM events WHERE event_type = 'signup'""")
def compaction_log_parse(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    work = F.concat(u, F.lit(":Compacting datalog/"), e, F.lit(" datalog/"), e, F.lit(" into:sstable1/"), e, F.lit(".sst"))
    lines = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "signup", work).otherwise("Starting test.").alias("line"))
    return X.compactions(lines).select("event_id", "worker", F.size("inputs").alias("n_inputs"), "output")
