"""Result logs as text: reading their lines, and writing measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words around the numbers of status lines and the names of merge lines.
SEC, OPERATIONS, RATE, COMPACTING, INTO = " sec: ", " operations; ", " current ops/sec;", ":Compacting ", " into:"
STAMP = len("2024-01-31 23:59:59:999")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def _parts(text: Column, *marks: str) -> Column:
    """What stands between the marks of a line, which is cut once."""
    return F.split(text, "|".join(marks))


def _stamp(text: Column) -> Column:
    """The time that a line begins with, whose milliseconds follow a colon; null if it doesn't."""
    text = F.substring(text, 1, STAMP)
    return F.concat(F.substring(text, 1, STAMP - 4), F.lit("."), F.substring(text, STAMP - 2, 3)).try_cast("timestamp_ntz")


def _typed(lines: DataFrame, line: str, cut: Column, least: int, parts: dict[str, Column]) -> DataFrame:
    """The lines that are cut into `least` parts or more, and have those that are named, in place of the line."""
    out = lines.withColumn("_p", cut).where(F.size("_p") >= least)
    out = out.select(*[c for c in lines.columns if c != line], *[v.alias(k) for k, v in parts.items()])
    return out.dropna(subset=list(parts))


def metrics(lines: DataFrame, line: str = "line") -> DataFrame:
    """(..., op, metric, value) of the lines `[OP], Metric, value` whose value is a number."""
    p = F.col("_p")
    op = F.when(p[0].startswith("[") & p[0].endswith("]"), F.substring(p[0], F.lit(2), F.length(p[0]) - 2))
    return _typed(lines, line, F.split(F.col(line), ", ", 3), 3, {"op": op, "metric": p[1], "value": p[2].try_cast("double")})


def statuses(lines: DataFrame, line: str = "line") -> DataFrame:
    """(..., at, sec, operations, ops_per_sec) of the periodic status lines."""
    p = F.col("_p")
    sec = F.substring(p[0], F.lit(STAMP + 2), F.length(p[0]))
    return _typed(lines, line, _parts(F.col(line), SEC, OPERATIONS, RATE), 4, {
        "at": _stamp(p[0]), "sec": sec.try_cast("long"), "operations": p[1].try_cast("long"), "ops_per_sec": p[2].try_cast("double"),
    })


def events(lines: DataFrame, line: str = "line") -> DataFrame:
    """(..., at, event) of lines `time - Event started: ...`."""
    p = F.col("_p")
    return _typed(lines, line, _parts(F.col(line), " - ", ": "), 3, {"at": _stamp(p[0]), "event": F.when(F.length(p[0]) == STAMP, p[1])})


def compactions(lines: DataFrame, line: str = "line") -> DataFrame:
    """(..., worker, inputs, output) of lines `worker:Compacting a b into:c`."""
    p = F.col("_p")
    worker = F.when(p[0].try_cast("long").isNotNull(), p[0])
    return _typed(lines, line, _parts(F.col(line), COMPACTING, INTO), 3, {"worker": worker, "inputs": F.split(p[1], " "), "output": p[2]})


def run_of(file: Column) -> dict[str, Column]:
    """Workload and system of a result file `size-records-workload-system_tN.result`."""
    return {"workload": F.regexp_extract(file, r"([^-]*)-[^-]*$", 1), "system": F.regexp_extract(file, r"([^-.]*)(\.[^-]*)?$", 1)}


def as_lines(measured: DataFrame) -> DataFrame:
    """(value): a line `[OP], Metric, value` for each of measured(op, metric, value)."""
    return measured.select(F.concat(F.lit("["), "op", F.lit("], "), "metric", F.lit(", "), F.col("value").cast("string")).alias("value"))


def export(measured: DataFrame, path: str, kind: str = "text") -> None:
    """Measurements as lines of text, JSON objects, or one JSON array for each operation."""
    if kind == "text":
        as_lines(measured).write.text(path)
    elif kind == "json":
        measured.select("op", "metric", "value").write.json(path)
    elif kind == "jsonarray":
        rows = measured.groupBy("op").agg(F.to_json(F.sort_array(F.collect_list(F.struct("op", "metric", "value")))).alias("value"))
        rows.select("value").write.text(path)
    else:
        raise ValueError(f"not a kind of export: {kind}")


def read_histogram(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(block size, counts) of a small file: `BlockSize n`, then lines of a place and a count."""
    rows = spark.read.csv(path, sep="\t").collect()
    block = next((int(r[1]) for r in rows if r[0] == "BlockSize"), 1)
    places = {int(r[0]): int(r[1]) for r in rows if r[0] != "BlockSize"}
    return block, [places.get(i, 0) for i in range(max(places, default=-1) + 1)]


def numbered_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(place, line): the trimmed lines of a file, or of a folder's files by name, counted from 0; the first `limit` of them.

    Lines are numbered within the blocks that tasks read, and only the blocks' counts meet in one window.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    rows = lines.withColumn("within", within).join(blocks, ["file", "block"]).select((F.col("before") + F.col("within")).alias("place"), F.regexp_replace("value", r"^[\x00-\x20]+|[\x00-\x20]+$", "").alias("line"))
    return rows if limit is None else rows.where(F.col("place") < limit)
