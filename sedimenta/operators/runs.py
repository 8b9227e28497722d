"""Segments, sorted runs, their manifest, and compaction."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshot import last_records


def roll(log: DataFrame, order: Sequence[str], size: Column, limit: int, within: Sequence[str] = ()) -> DataFrame:
    """log with the segment of each record: a new one begins when the records before add up to another `limit`.

    `within` gives independent logs. One log of very many records is summed in two steps by rolled_sizes() instead.
    """
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("segment", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / limit).cast("long"))


def rolled_sizes(log: DataFrame, seq: str, size: Column, limit: int, cell: int | None = None) -> DataFrame:
    """roll() of one log: running sums within cells of `cell` positions, and over one row for each cell.

    By default a cell is as long as there are cells, so that neither window has more than the root of the log's length.
    """
    if cell is None:
        cell = math.isqrt((log.agg(F.max(seq)).first()[0] or 0) + 1) + 1
    log = log.withColumn("_size", size).withColumn("_cell", F.floor(F.col(seq) / cell))
    cells = log.groupBy("_cell").agg(F.sum("_size").alias("_n"))
    cells = cells.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_cell").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = log.withColumn("_before", before).join(cells, "_cell")
    return out.withColumn("segment", F.floor((F.col("_start") + F.col("_before")) / limit).cast("long")).drop("_size", "_cell", "_before", "_start")


def entry_segment(seq: Column, entries: int = 64) -> Column:
    """The virtual file of an entry log's position."""
    return F.floor(seq / entries).cast("long")


def in_segments(seq: Column, first: int, last: int, entries: int = 64) -> Column:
    """Whether a position lies in the segments first to last: a plain range, so that it reaches the scan."""
    return seq.between(F.lit(first * entries), F.lit((last + 1) * entries - 1))


def manifest(records: DataFrame, run: Sequence[str], key: str, size: Column) -> DataFrame:
    """One row for each run: its key range, records and bytes."""
    return records.groupBy(*run).agg(F.min(key).alias("key_min"), F.max(key).alias("key_max"), F.count("*").alias("n_records"), F.sum(size).cast("long").alias("size_bytes"))


def merge_runs(records: DataFrame, target: Column, key: str, order: Sequence[str]) -> DataFrame:
    """Records of runs merged into `target` runs: a key's record of the newest input wins. Deletions are kept: an older run below may hold the key."""
    return last_records(records.withColumn("target", target), ["target", key], order)


def level_lookup(candidates: DataFrame, key: str, level: str, file_ord: str) -> DataFrame:
    """For each key the record of the lowest level, and there of the newest run."""
    rest = [c for c in candidates.columns if c not in (key, level, file_ord)]
    first = F.min(F.struct(F.col(level), (-F.col(file_ord)).alias("_o"), *rest)).alias("_r")
    return candidates.groupBy(key).agg(first).select(key, F.col(f"_r.{level}").alias(level), (-F.col("_r._o")).alias(file_ord), *[F.col(f"_r.{c}").alias(c) for c in rest])


def level_scores(runs: DataFrame, targets: dict[int, int]) -> DataFrame:
    """(level, n_files, size_bytes, score): how full each level is against its target size."""
    target = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in sorted(targets.items())])
    sums = runs.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("size_bytes").cast("long").alias("size_bytes"))
    return sums.withColumn("score", F.col("size_bytes") / target)


def pick_compaction(runs: DataFrame, targets: dict[int, int], last: int, last_files: int = 4, log_files: int = 2) -> DataFrame:
    """(level, priority) of what to compact, most urgent first: the log (level 0) with `log_files` sealed segments or more,
    then levels above their size, then the last level with more than `last_files` runs."""
    state = level_scores(runs, targets)
    need = (
        F.when((F.col("level") == 0) & (F.col("n_files") >= log_files), 0)
        .when((F.col("level") > 0) & (F.col("level") < last) & (F.col("score") > 1), F.col("level"))
        .when((F.col("level") == last) & (F.col("n_files") > last_files), F.lit(last))
    )
    return state.select("level", "n_files", "size_bytes", need.cast("int").alias("priority")).where("priority IS NOT NULL")


def compaction_inputs(runs: DataFrame, n: int = 2) -> DataFrame:
    """The n oldest runs of each level."""
    w = Window.partitionBy("level").orderBy("file_ord")
    return runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def adjacent_inputs(runs: DataFrame, version: str) -> DataFrame:
    """In each level the oldest pair of neighbours with the same version: (level, first_ord, second_ord, next_version)."""
    w = Window.partitionBy("level").orderBy("file_ord")
    pairs = runs.withColumn("_v", F.lead(version).over(w)).withColumn("_o", F.lead("file_ord").over(w)).where(F.col(version) == F.col("_v"))
    first = pairs.groupBy("level").agg(F.min(F.struct("file_ord", "_o", version)).alias("p"))
    return first.select("level", F.col("p.file_ord").alias("first_ord"), F.col("p._o").alias("second_ord"), (F.col(f"p.{version}") + 1).alias("next_version"))


def write_run(records: DataFrame, path: str, key: str, files: int = 1, bloom: bool = True, expected_keys: int = 1_000_000) -> None:
    """Records as sorted files: key ranges don't overlap, so that a key's condition skips files and row groups."""
    out = records.repartitionByRange(files, key) if files > 1 else records.coalesce(1)
    writer = out.sortWithinPartitions(key).write.mode("errorifexists")
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(expected_keys))
    writer.parquet(path)


def output_files(size_bytes: int, file_limit: int) -> int:
    """Files of a merge's output: as many as the limit asks for, with ranges of keys that don't overlap."""
    return max(1, -(-size_bytes // file_limit))
