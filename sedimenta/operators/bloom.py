"""Membership by a filter of bits: no member is missed, few others pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def may_hold(probes: DataFrame, probe: str, keys: DataFrame, key: str, per_key: int = 10, hashes: int = 6, cells: int = 1 << 16) -> DataFrame:
    """probes with may_hold, as columns only: `hashes` places for each key in a bit space of per_key bits a key.

    Places are start + i * step of two 64-bit hashes. The set bits are kept as bitmaps of `cells` bits each, joined by
    the number of the bitmap, so that neither side needs the whole filter in memory. A filter without keys holds nothing.
    """
    bits = max(64, keys.count() * per_key)
    place = lambda c, i: F.pmod(F.pmod(F.xxhash64(c), F.lit(bits)) + F.lit(i) * F.pmod(F.xxhash64(c, F.lit(7)), F.lit(bits)), F.lit(bits))
    at = lambda c: F.explode(F.array(*[place(F.col(c), i) for i in range(hashes)])).alias("_at")
    have = keys.select(at(key)).select(F.floor(F.col("_at") / cells).alias("_cell"), F.pmod("_at", F.lit(cells)).alias("_bit"))
    have = have.groupBy("_cell").agg(F.collect_set(F.col("_bit").cast("int")).alias("_set"))
    asked = probes.select(probe).distinct().select(probe, at(probe)).select(probe, F.floor(F.col("_at") / cells).alias("_cell"), F.pmod("_at", F.lit(cells)).cast("int").alias("_bit"))
    hit = asked.join(have, "_cell", "left").groupBy(probe).agg(F.min(F.coalesce(F.array_contains("_set", F.col("_bit")), F.lit(False))).alias("may_hold"))
    return probes.join(hit, probe, "left")


def slot_of(offset: Column, lg_base: int = 11) -> Column:
    """filter_slot() of a column of offsets."""
    return F.shiftright(offset.cast("long"), lg_base)


def filter_slot(offset: int, lg_base: int = 11) -> int:
    """The filter that covers a block's offset, of a run with a filter for each 2**lg_base bytes."""
    return offset >> lg_base
