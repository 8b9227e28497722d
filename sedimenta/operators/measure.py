"""Analytics of measurements: summaries, histograms, percentiles, throughput."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of columns, null with null."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def running(counts: DataFrame, by: Sequence[str], value: str, n: str) -> DataFrame:
    """counts(by..., value, n) with _upto, the running sum of n by value in each group, and _all, its total.

    Values are cut into cells by the logarithm, 64 to an octave; sums run over a group's cells, of which there are a few
    thousand, and within a cell. So a group of very many distinct values is spread over many tasks.
    """
    cell = (F.signum(F.col(value)) * F.floor(F.log2(F.abs(F.col(value)) + 1) * 64)).cast("long")
    counts = counts.withColumn("_cell", cell)
    cells = counts.groupBy(*by, "_cell").agg(F.sum(n).alias("_in"))
    order = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_in").over(order), F.lit(0))).withColumn("_all", F.sum("_in").over(Window.partitionBy(*by)))
    within = counts.withColumn("_within", F.sum(n).over(Window.partitionBy(*by, "_cell").orderBy(value)))
    placed = within.join(cells, _same(within, cells, [*by, "_cell"]))
    return placed.select(*[within[c] for c in counts.columns if c != "_cell"], (F.col("_before") + F.col("_within")).alias("_upto"), "_all")


def summary(rows: DataFrame, by: Sequence[str], latency: str, percentiles: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """n, mean, min, max and exact percentiles (the least latency that so many don't exceed) of each group.

    Equal latencies are counted first, map-side, so that what is sorted is a group's distinct values, cell by cell.
    """
    counts = rows.groupBy(*by, F.col(latency).alias("_v")).agg(F.count("*").alias("_n"))
    counts = running(counts, by, "_v", "_n")
    picks = [F.min(F.when(F.col("_upto") >= F.col("_all") * F.lit(p), F.col("_v"))).alias(f"p{p * 100:g}".replace(".", "_")) for p in percentiles]
    return counts.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"), *picks)


def bucket_histogram(rows: DataFrame, by: Sequence[str], latency_us: str, buckets: int = 1000, width_us: int = 1000) -> DataFrame:
    """Counts by buckets of a millisecond; `buckets` itself is the one for all above. With the running count."""
    b = F.least(F.floor(F.col(latency_us) / width_us), F.lit(buckets)).cast("long")
    counts = rows.groupBy(*by, b.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bucket")))


def bucket_summary(rows: DataFrame, by: Sequence[str], latency_us: str, buckets: int = 1000, width_us: int = 1000) -> DataFrame:
    """Mean, population variance and the lower bounds, in microseconds, of the buckets that hold the 95th and 99th percentile."""
    h = bucket_histogram(rows, by, latency_us, buckets, width_us).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda p: F.min(F.when((F.col("bucket") < buckets) & (F.col("upto") / F.col("all") >= p), F.col("bucket") * width_us))
    tails = h.groupBy(*by).agg(at(0.95).alias("p95_us"), at(0.99).alias("p99_us"))
    moments = rows.groupBy(*by).agg(F.avg(latency_us).alias("mean"), F.var_pop(F.col(latency_us)).alias("variance"))
    return moments.join(tails, list(by))


def raw_percentiles(rows: DataFrame, by: Sequence[str], latency: str, percentiles: Sequence[float]) -> DataFrame:
    """(by..., p, value): the element at place floor(n * p), from 0, of each group's sorted latencies."""
    counts = rows.groupBy(*by, F.col(latency).alias("_v")).agg(F.count("*").alias("_n"))
    each = running(counts, by, "_v", "_n").withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    return each.where(F.col("_upto") > F.floor(F.col("_all") * F.col("p"))).groupBy(*by, "p").agg(F.min("_v").alias("value"))


def latency_series(rows: DataFrame, by: Sequence[str], ts_ms: str, latency: str, step_ms: int) -> DataFrame:
    """Mean latency of each step since the group's first measurement: (by..., step, n, mean)."""
    first = rows.groupBy(*by).agg(F.min(ts_ms).alias("_first"))
    step = (F.floor((F.col(ts_ms) - F.col("_first")) / step_ms) * step_ms).cast("long")
    return rows.join(first, list(by)).groupBy(*by, step.alias("step")).agg(F.count("*").alias("n"), F.avg(latency).alias("mean"))


#: The steps of a decade of the logarithmic histogram, and its decades above ten.
STEPS, DECADES = (10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90), 9


def log_bounds() -> list[float]:
    """The 154 upper bounds of the logarithmic histogram: ones up to nine, the steps of each decade, and one for all above."""
    return [float(x) for x in chain(range(1, 10), *([s * 10**e for s in STEPS] for e in range(DECADES)))] + [1e200]


def log_bucket(value: Column) -> Column:
    """How many bounds a value reaches: the place of the first above it. Comparisons only, so it stays in generated code."""
    scale = F.lit(10.0 ** (DECADES - 1))
    place = F.lit(len(STEPS) * (DECADES - 1))
    for e in reversed(range(DECADES - 1)):
        below = value < 10.0 ** (e + 2)
        scale, place = F.when(below, 10.0**e).otherwise(scale), F.when(below, len(STEPS) * e).otherwise(place)
    steps = sum(((value >= scale * s).cast("int") for s in STEPS), F.lit(0))
    return F.when(value < 10, F.greatest(F.floor(value), F.lit(0))).otherwise(9 + place + steps).cast("int")


def log_histogram(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., bucket, n, low, high, upto): counts in logarithmic buckets; mergeable by adding n."""
    bounds = F.array(*[F.lit(b) for b in log_bounds()])
    # Equal values are counted first, so a value's bucket is worked out once.
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counts = counts.groupBy(*by, log_bucket(F.col("_v")).alias("bucket")).agg(F.sum("_n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    low = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.get(bounds, F.col("bucket") - 1))
    return counts.select(*by, "bucket", "n", low.alias("low"), F.get(bounds, F.col("bucket")).alias("high"), upto.alias("upto"))


def log_percentiles(rows: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[float]) -> DataFrame:
    """(by..., p, value): linear within the bucket that the percentile falls in, within the group's least and greatest value."""
    ends = rows.groupBy(*by).agg(F.min(value).cast("double").alias("_least"), F.max(value).cast("double").alias("_most"), F.count("*").alias("_all"))
    h = log_histogram(rows, by, value).join(ends, list(by)).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    want = F.col("_all") * (F.col("p") / 100.0)
    hit = h.withColumn("_want", want).where((F.col("upto") >= F.col("_want")) & (F.col("upto") - F.col("n") < F.col("_want")))
    at = F.col("low") + (F.col("high") - F.col("low")) * ((F.col("_want") - (F.col("upto") - F.col("n"))) / F.col("n"))
    return hit.select(*by, "p", F.greatest(F.least(at, F.col("_most")), F.col("_least")).alias("value"))


def merge_histograms(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Histograms added up: (by..., bucket, n)."""
    return parts.groupBy(*by, "bucket").agg(F.sum("n").cast("long").alias("n"))


def log_statistics(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., n, least, most, total, squares): with log_histogram(), all that a logarithmic histogram holds; mergeable."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))


def merge_statistics(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """log_statistics() of parts added up, with average and population deviation."""
    out = parts.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    variance = F.greatest((F.col("squares") * F.col("n") - F.col("total") * F.col("total")) / (F.col("n") * F.col("n")), F.lit(0.0))
    return out.withColumn("average", F.col("total") / F.col("n")).withColumn("deviation", F.sqrt(variance))


def log_report(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """A histogram's buckets with their share and the share up to them, in per cent."""
    every = F.sum("n").over(Window.partitionBy(*by))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    return histogram.withColumns({"percent": F.col("n") * 100.0 / every, "cumulative": upto * 100.0 / every})


def with_intended(rows: DataFrame, op: str, started: str, ended: str, intended: str, which: str = "both") -> DataFrame:
    """(op, latency): each operation from its start and, as Intended-op, from when its schedule wanted it; or one of the two.

    An operation that had to wait for the one before began late; the latency from its intended start shows the wait.
    """
    kinds = {"op": (F.col(op), F.col(ended) - F.col(started)), "intended": (F.concat(F.lit("Intended-"), F.col(op)) if which == "both" else F.col(op), F.col(ended) - F.col(intended))}
    picked = kinds.values() if which == "both" else [kinds[which]]
    each = F.explode(F.array(*[F.struct(name.alias("op"), latency.alias("latency")) for name, latency in picked]))
    return rows.select(*[c for c in rows.columns if c not in (op, started, ended, intended)], each.alias("_m")).select("*", "_m.*").drop("_m")


def scheduled(place: Column, start: Column, tick: int) -> Column:
    """When the place-th operation (from 0) of a thread is meant to start: one each `tick`."""
    return start + place * tick


def status_counts(rows: DataFrame, op: str, status: str) -> DataFrame:
    return rows.groupBy(op, status).agg(F.count("*").alias("n"))


def relabelled(op: Column, status: Column, tracked: Sequence[str] = ()) -> Column:
    """The name a measurement is reported under: failures apart, those with tracked codes by code."""
    return F.when(status == "OK", op).when(status.isin(*tracked) if tracked else F.lit(False), F.concat_ws("-", op, status)).otherwise(F.concat(op, F.lit("-FAILED")))


def throughput(rows: DataFrame, by: Sequence[str], runtime_ms: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.lit(1000.0) * F.count("*") / runtime_ms).alias("ops_per_sec"))


def interval_throughput(rows: DataFrame, ts: str, every: str, seconds: int) -> DataFrame:
    """(start, n, total, ops_per_sec, change): operations of each interval, so far, a second, and against the interval before."""
    counts = rows.groupBy(F.window(ts, every).alias("_w")).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), "n")
    w = Window.orderBy("start")
    return counts.select("start", "n", F.sum("n").over(w).alias("total"), (F.col("n") / seconds).alias("ops_per_sec"), (F.col("n") - F.lag("n").over(w)).alias("change"))


def interval_summary(rows: DataFrame, ts: str, every: str, latency: str, percentiles: Sequence[float] = (0.9, 0.99, 0.999, 0.9999)) -> DataFrame:
    """summary() of each interval since the last report."""
    return summary(rows.withColumn("start", F.window(ts, every).start), ["start"], latency, percentiles)


def repeats(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation of repeated runs."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def shares(rows: DataFrame, who: str) -> DataFrame:
    """(who, n, percent): each worker's share of all rows."""
    counts = rows.groupBy(who).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


def thread_totals(rows: DataFrame, thread: str, latency_ns: str, seconds: float) -> DataFrame:
    """Throughput summed over threads, and latency percentiles over all: one row."""
    each = rows.groupBy(thread).agg((F.count("*") / F.lit(float(seconds))).alias("rate")).agg(F.sum("rate").alias("ops_per_sec"), F.count("*").alias("threads"))
    return each.withColumn("_g", F.lit(1)).join(summary(rows.withColumn("_g", F.lit(1)), ["_g"], latency_ns, (0.5, 0.95, 0.99, 0.999)), "_g").drop("_g")


def request_counts(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """How often each distinct request was made."""
    return rows.groupBy(*parts).agg(F.count("*").alias("n"))


def series_counts(rows: DataFrame, by: Sequence[str], series: Sequence[str], ts: str) -> DataFrame:
    """Distinct series and times, first and last time, of each group."""
    return rows.groupBy(*by).agg(F.count_distinct(*series).alias("n_series"), F.count_distinct(ts).alias("n_times"), F.min(ts).alias("first"), F.max(ts).alias("last"))
