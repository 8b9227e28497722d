"""Named queries over the tables of a folder, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Microseconds since the epoch of a timestamp without a zone, whatever the session's zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The change log that events stand for: key user_id, position event_id, an error deletes."""
    return table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")


def deleted() -> Column:
    return F.col("event_type") == "error"


def micros(df: DataFrame) -> DataFrame:
    return df.withColumn("us", F.expr(MICROS))
