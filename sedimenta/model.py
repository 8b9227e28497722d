"""Schemas of the tables that the engine reads and writes.

A record log is the single source of truth. The state of a key is its record with the greatest log position (`seq`),
unless that record is a deletion. Spark has no physical row order, so the position is always a column.
"""

from pyspark.sql import types as T

DELETION, VALUE = 0, 1
OK, NOT_FOUND, DELETED = "OK", "NOT_FOUND", "DELETED"

RECORD = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("type", T.ByteType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
#: One row for each sorted run: its level, its place in the level (oldest least), key range and size.
MANIFEST = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("file_ord", T.LongType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("key_min", T.StringType()),
        T.StructField("key_max", T.StringType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("seq_max", T.LongType()),
    ]
)
OPERATION = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("in_last_level", T.BooleanType()),
        T.StructField("inputs", T.ArrayType(T.StringType())),
        T.StructField("outputs", T.ArrayType(T.StringType())),
        T.StructField("key_start", T.ArrayType(T.StringType())),
        T.StructField("key_end", T.ArrayType(T.StringType())),
    ]
)
TASK = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.LongType()),
        T.StructField("input_files", T.ArrayType(T.StringType()), False),
        T.StructField("destination_level", T.IntegerType()),
        T.StructField("into_next_level", T.BooleanType()),
        T.StructField("owner", T.StringType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("status", T.StringType(), False),
    ]
)
POINT = T.StructType(
    [
        T.StructField("metric", T.StringType(), False),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.LongType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)
MEASUREMENT = T.StructType(
    [
        T.StructField("op", T.StringType(), False),
        T.StructField("ts", T.TimestampType()),
        T.StructField("latency_us", T.LongType(), False),
        T.StructField("status", T.StringType()),
    ]
)
