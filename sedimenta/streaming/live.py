"""The same states kept up to date as a log grows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.snapshot import last_records


def read_log(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """A growing folder of Parquet files; `files` at most in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest(log: DataFrame, key: Sequence[str], seq: Sequence[str], deleted: Column) -> DataFrame:
    """The live keys. The state holds a record for each key ever written, deletions too: an older record may still come."""
    return last_records(log, key, seq).where(~deleted)


def downsampled(points: DataFrame, by: Sequence[str], ts: str, every: str, late: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of each group and window; points that are later than `late` are dropped, and finished windows leave the state."""
    kind = points.schema[ts].dataType.simpleString()  # event time needs a zone; the session's is taken off again
    timed = points.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(*by, F.window(ts, every).alias("_w")).agg(*aggregates)
    return out.select(*by, F.col("_w.start").cast(kind).alias("bucket"), *[c for c in out.columns if c not in (*by, "_w")])


def dead_tasks(beats: DataFrame, task: str, ts: str, status: str, seconds: int) -> DataFrame:
    """(task, last_beat_ms) of a task once event time has passed its last sign of life by `seconds` and it isn't finished."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"task": [key[0]], "last_beat_ms": [last]})
            return
        last, done = state.get[0] if state.exists else 0, False
        for pdf in batches:
            last = max(last, int(pdf[ts].astype("datetime64[ms]").astype("int64").max()))
            done |= bool(pdf[status].isin(["COMPLETE", "DEAD"]).any())
        if done:
            if state.exists:
                state.remove()
            return
        state.update((last,))
        state.setTimeoutTimestamp(last + seconds * 1000)

    kind = beats.schema[task].dataType.simpleString()
    grouped = beats.withWatermark(ts, "0 seconds").groupBy(task)
    return grouped.applyInPandasWithState(step, f"task {kind}, last_beat_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def follow(stream: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Records of the probes' keys as they appear: a read that waits for its key."""
    return stream.join(probes.select(key).distinct(), key, "left_semi")


def run_once(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """What a stream gives over all there is now, as a table under a shared folder.

    In complete mode a batch replaces the table, otherwise each batch is a part of it; a batch that is run again after a
    failure replaces its own part.
    """
    folder = folder.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").select(*df.columns)


def persist(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "100 milliseconds"):
    """Each batch of changed rows to `write(batch, number)`; a batch that is written again after a failure has the same number."""
    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Listener(StreamingQueryListener):
    """Tells of a stream's start, batches and end: spark.streams.addListener(Listener(print))."""

    def __init__(self, tell: Callable[[str, dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_sec": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        self.tell("idle", {"id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.tell("ended", {"id": str(event.id), "error": event.exception})
