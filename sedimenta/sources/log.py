"""An append-only record log as Parquet: one append is one segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import DELETION, RECORD, VALUE


class SealedError(RuntimeError):
    """The log takes no more records."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def create_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.mkdirs(p)


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Write a small file whole: under another name first, then by a rename. False if the name is taken."""
    fs, p = _fs(spark, path)
    if fs.exists(p) and not overwrite:
        return False
    part = p.suffix(".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if overwrite:
        fs.delete(p, False)
    return fs.rename(part, p)


def parts(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers N of the folders `name=N` under a path that were written whole, ascending."""
    fs, p = _fs(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(f"{name}=")) for n in found if n.startswith(f"{name}=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def newest(spark: SparkSession, path: str, name: str) -> tuple[int, int] | None:
    """(number, greatest seq) of the newest folder that has records. Seqs ascend over folders, so older ones aren't read."""
    for n in reversed(parts(spark, path, name)):
        last = spark.read.schema("seq long").parquet(f"{path}/{name}={n}").agg(F.max("seq")).first()[0]
        if last is not None:
            return n, last
    return None


def recover(spark: SparkSession, path: str, name: str) -> list[int]:
    """Remove the folders that a writer left when it ended in the middle; until then an append is refused. Their numbers."""
    fs, p = _fs(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    left = [int(n.removeprefix(f"{name}=")) for n in found if n.startswith(f"{name}=") and not exists(spark, f"{path}/{n}/_SUCCESS")]
    for n in left:
        remove(spark, f"{path}/{name}={n}")
    return sorted(left)


#: Bits of a row's place within its partition in what monotonically_increasing_id() gives.
_PLACE_BITS = 33


class RecordLog:
    """Segments `segment=N` of records (key, value, type, seq) under a path, for one writer at a time and any readers.

    seq ascends over all segments. A segment is committed whole by Spark's writer; a log that is sealed refuses
    appends. Keys come in by their own column names; `type` 0 deletes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _segments(self) -> list[int]:
        return parts(self.spark, self.path, "segment")

    def tail(self) -> int:
        """The next seq."""
        last = newest(self.spark, self.path, "segment")
        return last[1] + 1 if last else 0

    def append(self, rows: DataFrame, order: list[str] | None = None, dense: bool = False) -> int:
        """Append rows (key, value[, type]); their seqs follow `order` if given. Returns the segment's number.

        Seqs ascend with gaps between the tasks that write. With `dense` they are consecutive: the rows are staged
        first, only the tasks' counts meet, and the staged rows are written again with their numbers.
        """
        if exists(self.spark, f"{self.path}/SEALED"):
            raise SealedError(self.path)
        segments = self._segments()
        start, number = self.tail(), (segments[-1] + 1 if segments else 1)
        rows = rows if "type" in rows.columns else rows.withColumn("type", F.lit(VALUE).cast("byte"))
        rows = rows.orderBy(*order) if order else rows
        rows = rows.select(F.col("key"), F.col("value"), F.col("type").cast("byte").alias("type"), (F.monotonically_increasing_id() + (0 if dense else start)).alias("seq"))
        if not dense:
            rows.write.mode("error").parquet(f"{self.path}/segment={number}")
            return number
        staging = f"{self.path}/_staging={number}"
        rows.write.mode("overwrite").parquet(staging)
        staged = self.spark.read.schema(RECORD).parquet(staging).withColumn("_part", F.shiftright("seq", _PLACE_BITS))
        counts = staged.groupBy("_part").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
        numbered = staged.join(counts.select("_part", before.alias("_before")), "_part")
        seq = F.lit(start) + F.col("_before") + F.col("seq").bitwiseAND((1 << _PLACE_BITS) - 1)
        numbered.select("key", "value", "type", seq.alias("seq")).write.mode("error").parquet(f"{self.path}/segment={number}")
        remove(self.spark, staging)
        return number

    def put(self, rows: DataFrame) -> int:
        return self.append(rows.select("key", "value"))

    def delete(self, keys: DataFrame) -> int:
        """Deletions for keys, whether they are there or not."""
        return self.append(keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(DELETION).cast("byte").alias("type")))

    def records(self) -> DataFrame:
        """All records with their segment; a condition on segment skips folders, one on seq row groups."""
        if not self._segments():
            return self.spark.createDataFrame([], RECORD).withColumn("segment", F.lit(0))
        return self.spark.read.schema(RECORD).option("basePath", self.path).parquet(*[f"{self.path}/segment={n}" for n in self._segments()])

    def read(self, start: int, end: int) -> DataFrame:
        """Records with start <= seq < end."""
        return self.records().where((F.col("seq") >= start) & (F.col("seq") < end))

    def read_segment(self, number: int) -> DataFrame:
        return self.records().where(F.col("segment") == number)

    def sizes(self) -> DataFrame:
        """(segment, n_files, size_bytes, n_records)"""
        rows = self.records().select("segment", "_metadata.file_path", "_metadata.file_size")
        files = rows.groupBy("segment", "file_path", "file_size").agg(F.count("*").alias("n"))
        return files.groupBy("segment").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("size_bytes"), F.sum("n").alias("n_records"))

    def seal(self) -> None:
        put_text(self.spark, f"{self.path}/SEALED", "", overwrite=True)

    def is_sealed(self) -> bool:
        return exists(self.spark, f"{self.path}/SEALED")
