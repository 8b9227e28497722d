"""Last writer wins: the state of a log, point reads, history, field-level updates and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETED, NOT_FOUND, OK


def _order(seq: Sequence[str]) -> Column:
    return F.struct(*seq) if len(seq) > 1 else F.col(seq[0])


def last_records(log: DataFrame, key: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The record of each key with the greatest seq, deletions included. One exchange, after map-side reduction.

    Each task sorts its records by key to reduce them (a buffer that holds strings can't be changed in a hash table), and
    what is left is exchanged and reduced again. Columns that have no order, such as maps, are allowed.

    A condition on the key may be put before or after; one on the value or kind of a record may only be put after,
    or an old value comes back for a key that was overwritten or deleted.
    """
    rest = [c for c in log.columns if c not in key and c not in seq]
    whole = F.struct(*seq, *rest)
    unordered = any("map<" in log.schema[c].dataType.simpleString() for c in rest)
    newest = (F.max_by(whole, F.struct(*seq)) if unordered else F.max(whole)).alias("_r")
    return log.groupBy(*key).agg(newest).select(*key, *[F.col("_r").getField(c).alias(c) for c in [*seq, *rest]])


def snapshot(log: DataFrame, key: Sequence[str], seq: Sequence[str], deleted: Column) -> DataFrame:
    """The live keys and their values."""
    return last_records(log, key, seq).where(~deleted)


def deleted_keys(log: DataFrame, key: Sequence[str], seq: Sequence[str], deleted: Column) -> DataFrame:
    """Keys whose last record is a deletion."""
    return last_records(log, key, seq).where(deleted)


def as_of(log: DataFrame, key: Sequence[str], seq: Sequence[str], deleted: Column, position: Column) -> DataFrame:
    """The state that a reader saw who stopped at `position` (a condition on seq)."""
    return snapshot(log.where(position), key, seq, deleted)


def get(log: DataFrame, key: str, seq: Sequence[str], deleted: Column, value: object) -> DataFrame:
    """The record of one key, or no row. The key's condition reaches the scan."""
    return snapshot(log.where(F.col(key) == F.lit(value)), [key], seq, deleted)


def multi_get(probes: DataFrame, probe: str, log: DataFrame, key: str, seq: Sequence[str], deleted: Column, value: Sequence[str]) -> DataFrame:
    """Each probe with a status and, if that is OK, the value. The log is reduced before it meets the probes."""
    last = last_records(log, [key], seq).select(F.col(key).alias("_key"), deleted.alias("_gone"), *value)
    status = F.when(F.col("_key").isNull(), NOT_FOUND).when(F.col("_gone"), DELETED).otherwise(OK)
    got = probes.join(last, F.col(probe) == F.col("_key"), "left")
    return got.select(*probes.columns, status.alias("status"), *[F.when(status == OK, F.col(c)).alias(c) for c in value])


def layered_get(probes: DataFrame, probe: str, layers: Sequence[DataFrame], key: str, seq: Sequence[str], deleted: Column) -> DataFrame:
    """As a point read walks: newest layer first, and older ones only for keys that no newer layer has."""
    left, found = probes.select(F.col(probe).alias(key)).distinct(), None
    for layer in layers:
        hit = last_records(layer.join(left, key, "left_semi"), [key], seq)
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select(key), key, "left_anti")
    return found.where(~deleted)


def as_of_join(probes: DataFrame, probe_key: str, at: str, log: DataFrame, key: str, seq: str, value: Sequence[str], partitions_of: str | None = None) -> DataFrame:
    """For each probe the newest record of its key at or before its own position.

    Probes and records of a key are sorted together and the last record is carried along: one exchange on the key and
    no pairs of a probe and all older records.
    """
    part = [probe_key, *([partitions_of] if partitions_of else [])]
    carried = F.struct(*[F.col(c) for c in (seq, *value)])
    a = log.select(F.col(key).alias(probe_key), F.col(seq).alias("_at"), F.lit(0).alias("_role"), carried.alias("_r"), F.lit(None).cast(probes.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_p"))
    b = probes.select(F.col(probe_key), F.col(at).alias("_at"), F.lit(1).alias("_role"), F.lit(None).cast(a.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_p"))
    w = Window.partitionBy(*part).orderBy("_at", "_role").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_role = 1")
    return both.select("_p.*", *[F.col("_r").getField(c).alias(f"visible_{c}") for c in (seq, *value)])


def history(log: DataFrame, key: Sequence[str], seq: Sequence[str], value: str) -> DataFrame:
    """Every version of every key: its number, the value that it replaced and whether it is the last."""
    w = Window.partitionBy(*key).orderBy(*seq)
    return log.withColumns(
        {
            "version": F.row_number().over(w).cast("long"),
            "previous": F.lag(value).over(w),
            "is_last": F.lead(seq[0]).over(w).isNull(),
        }
    )


def merge_fields(writes: DataFrame, key: Sequence[str], seq: str, field: str, value: str, resets: DataFrame | None = None) -> DataFrame:
    """(key..., fields): a map of each field's last value, as read-modify-write leaves it.

    `resets` (key..., seq, deleted) are whole-row writes: fields written before a row's last reset don't count, and a
    row whose last reset is a deletion, with no field written since, isn't there.
    """
    if resets is not None:
        last = resets.groupBy(*key).agg(F.max(F.struct(F.col(seq).alias("at"), "deleted")).alias("_reset"))
        writes = writes.join(last, list(key), "left").where(F.col("_reset").isNull() | (F.col(seq) >= F.col("_reset.at")))
    newest = writes.groupBy(*key, field).agg(F.max_by(value, seq).alias("_v"))
    return newest.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(field, "_v")))).alias("fields"))


def merge_wide(writes: DataFrame, key: Sequence[str], seq: str, field: str, value: str, fields: Sequence[str]) -> DataFrame:
    """merge_fields() with a column for each of the known `fields`: one aggregation, no map."""
    return writes.groupBy(*key).agg(*[F.max_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.col(seq))).alias(f) for f in fields])


def insert_conflicts(batch: DataFrame, state: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key is live already."""
    return batch.join(state.select(*key), list(key), "left_semi")


def without(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't deleted."""
    return rows.join(gone.select(*key), list(key), "left_anti")


def read_fields(rows: DataFrame, key: str, fields: Sequence[str] | None) -> DataFrame:
    """A projection; all columns for None."""
    return rows if fields is None else rows.select(key, *fields)


def project_map(fields: Column, wanted: Sequence[str]) -> Column:
    """The entries of a map column whose names are wanted."""
    return F.map_filter(fields, lambda k, _: k.isin(*wanted))
