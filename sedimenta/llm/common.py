"""What the operators share: words, row keys, written intermediate tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, and the words between.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sedimenta-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: With this on, Spark deletes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, lost executors cost no recomputation, and its shuffles are deleted."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sedimenta-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of written() that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those put into the list; nothing returned may read the others."""
    kept: list[DataFrame] = []
    first = len(_written)
    yield kept
    paths = {df.written_path for df in kept}
    for _, path in [x for x in _written[first:] if x[1] not in paths]:
        dropped(spark, path)
    _written[first:] = [x for x in _written[first:] if x[1] in paths]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            dropped(spark, path)
        except Exception:  # the session may have ended before; its folder is then the cluster's to clear
            return


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the runs of rows with equal `by`."""
    now: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if now and last != keys[a]:
                yield pa.Table.from_batches(now)
                now = []
            last = keys[a]
            now.append(batch.slice(a, b - a))
    if now:
        yield pa.Table.from_batches(now)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, root): for each end of an edge the least id that it is connected with.

    Alternating large-star and small-star steps: a hub's edges are aggregated map-side and joined to one row per
    node, so no component, however large, meets in one task. Each round is written to the shared folder.
    """

    def put(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df, written, and what tells it from another set of edges."""
        seen, sums = Observation(), (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        out = written(df.observe(seen, *sums))
        got = seen.get or out.agg(*sums).first().asDict()  # a plan that is found to be empty may not report
        return out, (got["n"], got["sum"])

    spark = edges.sparkSession
    now, state = put(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join has a plain exchange on either side and a hub's edges can be split.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, last = now, state
        now, state = put(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        for done in (before, low):
            dropped(spark, done.written_path)
        if state == last:
            break
    else:
        raise RuntimeError(f"components aren't found in {rounds} rounds")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
