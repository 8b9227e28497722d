"""Workloads as tables of operations, run as sets instead of one by one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generators as G
from ..functions.scalar import field_value, key_name, printable, series_check
from ..model import NOT_FOUND, OK
from ..sources.text import numbered_lines

#: The share of each operation, and the request distribution, of the standard workloads.
MIXES = {
    "a": ({"READ": 0.5, "UPDATE": 0.5}, "zipfian"),
    "b": ({"READ": 0.95, "UPDATE": 0.05}, "zipfian"),
    "c": ({"READ": 1.0}, "zipfian"),
    "d": ({"READ": 0.95, "INSERT": 0.05}, "latest"),
    "e": ({"SCAN": 0.95, "INSERT": 0.05}, "zipfian"),
    "f": ({"READ": 0.5, "READMODIFYWRITE": 0.5}, "zipfian"),
}


@dataclass
class Core:
    """records there are, operations to do; keys by `distribution`; scans of 1 to max_scan rows."""

    records: int
    operations: int
    mix: dict[str, float]
    distribution: str = "zipfian"
    max_scan: int = 100
    fields: int = 10
    padding: int = 1
    ordered: bool = False

    @classmethod
    def standard(cls, name: str, records: int, operations: int) -> Core:
        mix, distribution = MIXES[name]
        return cls(records, operations, mix, distribution)


def request(u: Column, v: Column, w: Core) -> Column:
    """The number of the record that an operation asks for."""
    n = w.records
    return {
        "uniform": lambda: G.uniform(u, 0, n - 1),
        "zipfian": lambda: G.scrambled_zipfian(u, 0, n - 1),
        "latest": lambda: F.greatest(G.latest(u, n - 1), F.lit(0)),
        "sequential": lambda: G.sequential(F.col("op_id"), 0, n - 1),
        "hotspot": lambda: G.hotspot(u, v, 0, n - 1, 0.2, 0.8),
        "exponential": lambda: F.pmod(F.lit(n - 1) - G.exponential(u, 95, n * 0.8571428571), F.lit(n)),
    }[w.distribution]().cast("long")


def operations(spark: SparkSession, w: Core, seed: int = 1) -> DataFrame:
    """(op_id, op, keynum, key, field, length): what each operation does. Inserts count on from the last record."""
    u = lambda i: G.unit(F.concat_ws(":", F.lit(seed), F.lit(i), "op_id"))
    ops = spark.range(w.operations).withColumnRenamed("id", "op_id").withColumn("op", G.discrete(u(0), list(w.mix.items())))
    # An insert's number is its place among all operations, so that no running count over all rows is needed.
    keynum = F.when(F.col("op") == "INSERT", F.col("op_id") + w.records).otherwise(request(u(1), u(2), w))
    ops = ops.withColumn("keynum", keynum).withColumn("key", key_name(F.col("keynum"), w.padding, w.ordered))
    length = F.when(F.col("op") == "SCAN", G.uniform(u(3), 1, w.max_scan)).otherwise(1)
    return ops.withColumn("field", F.concat(F.lit("field"), G.uniform(u(4), 0, w.fields - 1))).withColumn("length", length.cast("long"))


def read_results(ops: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(op_id, op, key, status) of the single-row operations against the rows: a missing row is NOT_FOUND, but not for an insert."""
    there = rows.select(F.col(key).alias("_k"))
    single = ops.where("op <> 'SCAN'").join(there, F.col("key") == F.col("_k"), "left")
    status = F.when((F.col("op") == "INSERT") | F.col("_k").isNotNull(), OK).otherwise(NOT_FOUND)
    return single.select("op_id", "op", "key", status.alias("status"))


def series(
    spark: SparkSession, keys: int, cards: Sequence[int], times: int, start: int = 1451606400, step: int = 60,
    key_length: int = 4, tag_length: int = 2, value_length: int = 4, delayed: float = 0.0, intervals: int = 1,
) -> DataFrame:
    """(point, metric, tags, ts, value): every series at every time, in the order an odometer gives: time, key, tags, the last fastest.

    Each row is worked out from its own number, so no rows are paired. Late series lag as in timeseries.delayed(); the
    value is what verification expects.
    """
    total = keys
    for c in cards:
        total *= c
    rows = spark.range(total * times).withColumnRenamed("id", "point")
    inner = F.col("point") % total
    tags, below = [], total // keys
    for i, c in enumerate(cards):
        below //= c
        tags += [printable(F.lit(i), tag_length), printable(F.floor(inner / below) % c, value_length)]
    now = F.lit(start) + F.floor(F.col("point") / total) * step
    late = F.when(inner / F.lit(total) < delayed, now - step * (inner % max(1, intervals))).otherwise(now)
    rows = rows.select("point", printable(F.floor(inner / (total // keys)), key_length).alias("metric"), F.create_map(*tags).alias("tags"), now.cast("long").alias("_now"), late.cast("long").alias("ts"))
    return rows.withColumn("value", series_check(F.col("tags"), F.col("_now"))).drop("_now")


def verified(points: DataFrame) -> DataFrame:
    """points with a status: whether the value is what was generated for its tags and time."""
    return points.withColumn("status", F.when(series_check(F.col("tags"), F.col("ts")) == F.col("value"), OK).otherwise("UNEXPECTED_STATE"))


def verify_rows(rows: DataFrame, size: int) -> DataFrame:
    """(key, status) of rows(key, fields) read back: OK if every field holds what was generated for it, UNEXPECTED_STATE if one doesn't, ERROR for a row without fields."""
    each = rows.select("key", F.explode_outer("fields").alias("field", "value"))
    good = (field_value(F.coalesce("key", F.lit("")), F.coalesce("field", F.lit("")), F.lit(size)) == F.col("value")).alias("good")
    sums = each.select("key", "field", good).groupBy("key").agg(F.count("field").alias("n"), F.min(F.coalesce("good", F.lit(False))).alias("good"))
    return sums.select("key", F.when(F.col("n") == 0, "ERROR").when(F.col("good"), OK).otherwise("UNEXPECTED_STATE").alias("status"))


def retried(inserts: DataFrame, fails: Callable[[int], Column], limit: int) -> DataFrame:
    """inserts with attempts and status: one that fails (fails(i) for its i-th attempt) is tried again, `limit` times at most."""
    attempts, status = F.lit(limit + 1), F.lit("ERROR")
    for i in reversed(range(limit + 1)):
        attempts, status = F.when(~fails(i), i + 1).otherwise(attempts), F.when(~fails(i), OK).otherwise(status)
    return inserts.select("*", attempts.alias("attempts"), status.alias("status"))


def occupancy_records(disk_bytes: int, occupancy: float, fields: int = 10, field_length: int = 100, memory_ratio: int = 1) -> int:
    """How many records fill a share of a disk."""
    return int(disk_bytes * occupancy / (fields * field_length * memory_ratio))


def templated(text: str, records: int, operations_: int) -> str:
    """A workload's settings with its numbers of records and operations replaced."""
    out = []
    for line in text.splitlines():
        name = line.split("=", 1)[0].strip()
        out.append({"recordcount": f"recordcount={records}", "operationcount": f"operationcount={operations_}"}.get(name, line))
    return "\n".join(out)


@dataclass
class Trace:
    """Operations on addresses that trace files list: `traces` has a file or folder for each kind of operation.

    Each kind has its own number of addresses (at most `limits`) and its own zipfian constant. What isn't an insert,
    update or delete is a read. Inserts and updates bring `length` bytes, of the distribution `lengths`.
    """

    traces: dict[str, str]
    operations: int
    mix: dict[str, float]
    distribution: str = "zipfian"
    theta: dict[str, float] = field(default_factory=dict)
    limits: dict[str, int] = field(default_factory=dict)
    lengths: str = "constant"
    length: int = 100
    length_theta: float = 0.99
    counts: Sequence[int] = ()


def _address(kind: str, n: int, u: Column, v: Column, w: Trace) -> Column:
    """The place in a trace of n addresses; beyond its end for the tail of the exponential distribution."""
    try:
        return {
            "uniform": lambda: G.uniform(u, 0, n - 1),
            "zipfian": lambda: G.zipfian(u, n, w.theta.get(kind, G.THETA)),
            "hotspot": lambda: G.hotspot(u, v, 0, n - 1, 0.2, 0.8),
            "exponential": lambda: G.exponential(u, 95, n * 0.8571428571),
        }[w.distribution]().cast("long")
    except KeyError:
        raise ValueError(f"not a distribution of addresses: {w.distribution}") from None


def traced(spark: SparkSession, w: Trace, seed: int = 1) -> DataFrame:
    """(op_id, op, address, length): address is null where the trace has no such place, length for reads and deletes."""
    u = lambda i: G.unit(F.concat_ws(":", F.lit(seed), F.lit(i), "op_id"))
    kinds = ["READ", "INSERT", "DELETE", "UPDATE"]
    lines = reduce(DataFrame.unionByName, [numbered_lines(spark, w.traces[k], w.limits.get(k)).withColumn("op", F.lit(k)) for k in kinds if k in w.traces])
    sizes = {r.op: r.n for r in lines.groupBy("op").agg(F.count("*").alias("n")).collect()}
    drawn = G.discrete(u(0), list(w.mix.items()))
    op = F.when(drawn.isin(kinds[1:]), drawn).otherwise("READ")
    ops = spark.range(w.operations).withColumnRenamed("id", "op_id").withColumn("op", op)
    place = F.coalesce(*[F.when(F.col("op") == k, _address(k, n, u(1), u(2), w)) for k, n in sorted(sizes.items())]) if sizes else F.lit(None).cast("long")
    size = G.zipfian(u(3), w.length, w.length_theta, base=1) if w.lengths == "zipfian" else G.field_length(w.lengths, u(3), w.length, 1, w.counts)
    ops = ops.withColumn("place", place).withColumn("length", F.when(F.col("op").isin("INSERT", "UPDATE"), size.cast("long")))
    return ops.join(lines, ["op", "place"], "left").select("op_id", "op", F.col("line").alias("address"), "length")
