"""Ordered range scans, one or many at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one quantile cell is to hold, and cells at most (their bounds are constants of the plan).
CELL_ROWS, MOST_CELLS = 1 << 16, 4096


def scan(rows: DataFrame, key: str, start: object, n: int, fields: Sequence[str] | None = None, partition: tuple[str, object] | None = None) -> DataFrame:
    """The first n rows with key >= start, in order of key; each task keeps n rows at most. `partition` fixes another column."""
    if partition:
        rows = rows.where(F.col(partition[0]) == F.lit(partition[1]))
    rows = rows.where(F.col(key) >= F.lit(start))
    return (rows if fields is None else rows.select(key, *fields)).orderBy(key).limit(n)


def scan_back(rows: DataFrame, key: str, start: object, n: int) -> DataFrame:
    """The last n rows with key <= start, greatest first."""
    return rows.where(F.col(key) <= F.lit(start)).orderBy(F.desc(key)).limit(n)


def cell_of(rows: DataFrame, key: str, cells: int) -> Column:
    """The number of the quantile cell that a key lies in; cells ascend with the key and hold about as many rows each."""
    cuts = quantiles(rows, key, cells)
    return cell_among(cuts, F.col(key), rows.schema[key].dataType.simpleString())


def quantiles(rows: DataFrame, key: str, cells: int) -> list:
    """Keys that cut the rows into `cells` parts of about as many each; at most cells - 1, whatever the rows."""
    return sorted(set(rows.agg(F.percentile_approx(key, [i / cells for i in range(1, cells)], 20 * cells)).first()[0] or []))


def cell_among(cuts: list, key: Column, kind: str) -> Column:
    """How many of the ascending cuts a key reaches, found in two steps: among every n-th, then among the n after that."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    array = lambda values: F.array(*[F.lit(c).cast(kind) for c in values])
    coarse = F.size(F.filter(array(cuts[step - 1 :: step]), lambda b: b <= key))
    fine = F.slice(array(cuts), coarse * step + 1, F.lit(step))
    return coarse * step + F.size(F.filter(fine, lambda b: b <= key))


def scan_batch(starts: DataFrame, start: str, length: str, rows: DataFrame, key: str, cells: int | None = None) -> DataFrame:
    """For each of starts its first `length` rows with key >= start: the starts' columns, the rows' columns and `place` from 1.

    Starts are ranked among the keys, and the wanted ranks are joined by equality; the cost follows the rows returned,
    where a join by key >= start would pair every start with all keys above it. Ranks are sums within quantile cells of
    the keys, one for each CELL_ROWS rows unless `cells` is given.
    """
    keyed = rows.withColumn("_k", F.col(key))
    unique = starts.select(F.col(start).cast(rows.schema[key].dataType).alias("_k")).distinct()
    both = rows.select(F.col(key).alias("_k"), F.lit(1).alias("_isrow")).unionByName(unique.withColumn("_isrow", F.lit(0)))
    order = both.groupBy("_k").agg(F.sum("_isrow").alias("_here"))
    cells = cells or max(16, min(MOST_CELLS, -(-rows.count() // CELL_ROWS)))
    cuts = quantiles(rows, key, cells)
    order = order.withColumn("_cell", cell_among(cuts, F.col("_k"), rows.schema[key].dataType.simpleString()))
    sizes = order.groupBy("_cell").agg(F.sum("_here").alias("_n"))
    sizes = sizes.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    below = F.coalesce(F.sum("_here").over(Window.partitionBy("_cell").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = order.withColumn("_below", below).join(F.broadcast(sizes), "_cell").select("_k", "_here", (F.col("_start") + F.col("_below")).alias("_rank"))
    wanted = starts.withColumn("_k", F.col(start).cast(rows.schema[key].dataType)).where(F.col(length) > 0).join(order.select("_k", "_rank"), "_k").drop("_k")
    wanted = wanted.select("*", F.posexplode(F.sequence(F.col("_rank"), F.col("_rank") + F.col(length) - 1))).drop("_rank")
    placed = keyed.join(order.where("_here > 0").select("_k", F.col("_rank").alias("col")), "_k").drop("_k")
    return wanted.join(placed, "col").withColumn("place", (F.col("pos") + 1).cast("long")).drop("col", "pos")


def range_lookup(probes: DataFrame, probe: str, ranges: DataFrame, low: str, high: str, cells: int = 64) -> DataFrame:
    """Pairs of a probe and a range that holds it, both ends included.

    Probes are cut into quantile cells; ranges are repeated for each cell that they touch, `cells` times at most
    however wide they are, and meet probes by equality on the cell.
    """
    cuts, kind = quantiles(probes, probe, cells), probes.schema[probe].dataType.simpleString()
    cell = lambda c: cell_among(cuts, F.col(c).cast(kind), kind)
    cut = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return probes.withColumn("_cell", cell(probe)).join(cut, "_cell").where(F.col(probe).between(F.col(low), F.col(high))).drop("_cell")


def range_totals(probes: DataFrame, probe: str, ranges: DataFrame, low: str, high: str, value: str, bits: int = 4, depth: int = 4) -> DataFrame:
    """For each key of the probes that a range holds, both ends included: the key, `n` pairs of its rows and ranges, and their `least` value.

    What grouping the pairs of range_lookup by the probe gives, without the pairs, whose number may be that of probes
    times that of ranges. Keys are numbered in ascending order, within quantile cells. A range is cut into nodes, blocks of
    2**(bits * level) numbers, fewer than 2**(bits + 1) a level; nodes are added up and meet each key by equality, once for
    each level up to `depth`. Larger nodes are handed down to those of that level first, so that none meets all keys.
    """
    spans = ranges.where(F.col(low) <= F.col(high)).groupBy(F.col(low).alias("_low"), F.col(high).alias("_high")).agg(F.count("*").alias("_n"), F.min(value).alias("_least"))
    keys = probes.where(F.col(probe).isNotNull()).select(F.col(probe).alias("_k"), F.lit(1).alias("_m"))
    ends = spans.select(F.explode(F.array("_low", "_high")).alias("_k"), F.lit(0).alias("_m"))
    order = keys.unionByName(ends).groupBy("_k").agg(F.sum("_m").alias("_m"))
    size = order.count()
    cuts = quantiles(order, "_k", max(16, min(MOST_CELLS, -(-size // CELL_ROWS))))
    order = order.withColumn("_here", (F.col("_m") > 0).cast("long")).withColumn("_cell", cell_among(cuts, F.col("_k"), order.schema["_k"].dataType.simpleString()))
    sizes = order.groupBy("_cell").agg(F.sum("_here").alias("_c"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_cell", before("_c", Window.orderBy("_cell")).alias("_start"))
    order = order.withColumn("_below", before("_here", Window.partitionBy("_cell").orderBy("_k"))).join(F.broadcast(sizes), "_cell")
    order = order.select("_k", "_m", "_here", (F.col("_start") + F.col("_below")).alias("_rank"))

    starts = order.select(F.col("_k").alias("_low"), F.col("_rank").alias("_from"))
    stops = order.select(F.col("_k").alias("_high"), (F.col("_rank") + F.col("_here")).alias("_to"))
    top = max(0, size.bit_length() - 1) // bits
    nodes = spans.join(starts, "_low").join(stops, "_high").where("_from < _to").select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    down = lambda c, level: F.call_function("shiftright", c, (level * bits).cast("int"))
    up = lambda c, level: -down(-c, level)
    first = [up(F.col("_from"), F.col("level") + i) for i in (0, 1)]
    after = [down(F.col("_to"), F.col("level") + i) for i in (0, 1)]
    nodes = nodes.select("_n", "_least", "level", *[c.alias(f"_{x}{i}") for x, cs in (("a", first), ("z", after)) for i, c in enumerate(cs)]).where("_a0 < _z0")
    # what the next level's nodes _a1 to _z1 leave of this one's _a0 to _z0: both sides, or all if the next has none
    width, some = F.lit(1 << bits), F.col("_a1") < F.col("_z1")
    upto = lambda a, z: F.when(a < z, F.sequence(a, z - 1)).otherwise(F.array().cast("array<long>"))
    sides = F.concat(upto(F.col("_a0"), F.col("_a1") * width), upto(F.col("_z1") * width, F.col("_z0")))
    nodes = nodes.select("level", "_n", "_least", F.explode(F.when(some, sides).otherwise(upto(F.col("_a0"), F.col("_z0")))).alias("node"))
    added = lambda df, *by: df.groupBy(*by).agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    nodes = added(nodes, "level", "node")
    if top > depth:
        blocks = probes.sparkSession.range((size >> bits * depth) + 1).select(F.col("id").alias("_block"), F.explode(F.sequence(F.lit(depth), F.lit(top))).alias("level"))
        blocks = blocks.withColumn("node", down(F.col("_block"), F.col("level") - depth))
        handed = added(blocks.join(nodes.where(F.col("level") >= depth), ["level", "node"]), "_block")
        nodes = nodes.where(F.col("level") < depth).unionByName(handed.select(F.lit(depth).alias("level"), F.col("_block").alias("node"), "_n", "_least"))
    each = order.where("_here > 0").select("_k", "_m", "_rank", F.explode(F.sequence(F.lit(0), F.lit(min(top, depth)))).alias("level"))
    found = each.withColumn("node", down(F.col("_rank"), F.col("level"))).join(nodes, ["level", "node"])
    return found.groupBy(F.col("_k").alias(probe)).agg(F.sum(F.col("_m") * F.col("_n")).alias("n"), F.min("_least").alias("least"))
