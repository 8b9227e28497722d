"""Request and data generators as column expressions over a uniform number or a row number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scalar import fnv64

#: Fixed values of the scrambled generator: items of the inner distribution and its zeta at theta 0.99.
SCRAMBLED_ITEMS, SCRAMBLED_ZETA, THETA = 10_000_000_000, 26.46902820178302, 0.99


def unit(seed: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash: reruns and retries of a task agree, as those of rand() needn't."""
    return F.conv(F.substring(F.md5(seed.cast("string")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def counter(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n)


def uniform(u: Column, low: int, high: int) -> Column:
    """An integer from low to high, both included."""
    return (F.lit(low) + F.floor(u * (high - low + 1))).cast("long")


def sequential(i: Column, low: int, high: int) -> Column:
    return (F.lit(low) + i % (high - low + 1)).cast("long")


def choice(u: Column, values: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


@lru_cache(64)
def zeta(n: int, theta: float = THETA) -> float:
    """The sum of 1 / i ** theta for i up to n; beyond a million by the Euler-Maclaurin tail."""
    m = min(n, 1_000_000)
    head = sum(1 / i**theta for i in range(1, m + 1))
    if m == n:
        return head
    return head + (n ** (1 - theta) - m ** (1 - theta)) / (1 - theta) + (n**-theta - m**-theta) / 2


def zipfian(u: Column, items: int, theta: float = THETA, zetan: float | None = None, base: int = 0) -> Column:
    """Gray's closed form: rank 0 is the most frequent."""
    zetan = zetan or zeta(items, theta)
    eta = (1 - (2.0 / items) ** (1 - theta)) / (1 - zeta(2, theta) / zetan)
    uz = u * zetan
    rest = F.floor(F.lit(float(items)) * F.pow(F.lit(eta) * u - eta + 1, F.lit(1 / (1 - theta)))).cast("long")
    return F.lit(base) + F.when(uz < 1.0, 0).when(uz < 1.0 + 0.5**theta, 1).otherwise(rest)


def scrambled_zipfian(u: Column, low: int, high: int) -> Column:
    """A zipfian rank whose hash names the item, so that frequent items lie anywhere."""
    return F.lit(low) + fnv64(zipfian(u, SCRAMBLED_ITEMS, zetan=SCRAMBLED_ZETA)) % (high - low + 1)


def latest(u: Column, newest: int) -> Column:
    """Mostly the newest items."""
    return F.lit(newest) - zipfian(u, newest)


def hotspot(u: Column, v: Column, low: int, high: int, hot_items: float, hot_requests: float) -> Column:
    """With chance hot_requests (by u) one of the first hot_items of all, else one of the others (by v)."""
    n = high - low + 1
    hot = int(n * hot_items)
    return (F.lit(low) + F.when(u < hot_requests, F.floor(v * hot)).otherwise(hot + F.floor(v * (n - hot)))).cast("long")


def exponential(u: Column, percentile: float, range_: float) -> Column:
    """`percentile` per cent of the numbers are below `range_`."""
    import math

    gamma = -math.log(1 - percentile / 100) / range_
    return (-F.ln(1 - u) / gamma).cast("long")


def discrete(u: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """A name with the chance of its share of the weights."""
    total, upto, out = sum(w for _, w in weights), 0.0, None
    for name, w in weights:
        upto += w
        test = u < upto / total
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(weights[-1][0])


def from_histogram(u: Column, counts: Sequence[int], block: int = 1) -> Column:
    """A length from a histogram: place i of the counts stands for (i + 1) * block."""
    total, upto, out = sum(counts), 0, None
    for i, n in enumerate(counts):
        upto += n
        out = F.when(u < upto / total, (i + 1) * block) if out is None else out.when(u < upto / total, (i + 1) * block)
    return out.otherwise(len(counts) * block)


def field_length(kind: str, u: Column, length: int, least: int = 1, counts: Sequence[int] = ()) -> Column:
    if kind == "constant":
        return F.lit(length)
    if kind == "uniform":
        return uniform(u, least, length)
    if kind == "zipfian":
        return zipfian(u, length - least + 1, base=least)
    if kind == "histogram":
        return from_histogram(u, counts)
    raise ValueError(f"not a length distribution: {kind}")


def epoch(i: Column, start: int, step: int) -> Column:
    return (F.lit(start) + i * step).cast("long")


def shuffled_epochs(spark: SparkSession, n: int, start: int, step: int, seed: int) -> DataFrame:
    """(ts): each of n times once, in an order of their hashes (column `place`), without a global sort of rows in one task."""
    return spark.range(n).select(epoch(F.col("id"), start, step).alias("ts"), F.xxhash64("id", F.lit(seed)).alias("place"))


def zipf_table(spark: SparkSession, n: int, theta: float) -> DataFrame:
    """(rank, mass, cdf) of the distribution of n items; the window is over n rows."""
    mass = 1 / F.pow(F.col("id") + 1, F.lit(theta))
    rows = spark.range(n).select(F.col("id").alias("rank"), mass.alias("mass"))
    upto = F.sum("mass").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cdf", upto / F.sum("mass").over(Window.partitionBy(F.lit(1))))
