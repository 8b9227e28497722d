"""Rows of named fields over a log: read, scan, insert, update and delete, for sets of rows at a time."""

from __future__ import annotations

import shlex
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NOT_FOUND, OK
from ..operators import scan as S
from ..operators import snapshot as N
from ..sources import log as L

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"
ERROR = "ERROR"
SCHEMA = "table string, key string, op string, fields map<string,string>, seq long"


class Rows:
    """Tables of rows (key, fields: map of name to value) in one log of inserts, updates and deletes, a folder for each append.

    An insert or delete replaces the row, an update overwrites the fields it names. Writes are appended whatever the
    state is, and their status is worked out from it: an insert of a live key is ERROR unless upserts are allowed, an
    update or delete of a missing row is NOT_FOUND and isn't written.
    """

    def __init__(self, spark: SparkSession, path: str, upsert: bool = False):
        self.spark, self.path, self.upsert = spark, path.rstrip("/"), upsert

    def log(self) -> DataFrame:
        written = L.parts(self.spark, self.path, "append")
        if not written:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/append={n}" for n in written])

    def _append(self, rows: DataFrame, op: str) -> None:
        last, written = L.newest(self.spark, self.path, "append"), L.parts(self.spark, self.path, "append")
        start = last[1] + 1 if last else 1
        fields = F.col("fields") if "fields" in rows.columns else F.lit(None).cast("map<string,string>")
        rows = rows.select("table", "key", F.lit(op).alias("op"), fields.alias("fields"), (F.monotonically_increasing_id() + start).alias("seq"))
        rows.write.mode("error").parquet(f"{self.path}/append={written[-1] + 1 if written else 1}")

    def state(self, table: str | None = None) -> DataFrame:
        """(table, key, fields) of the live rows."""
        log = self.log() if table is None else self.log().where(F.col("table") == table)
        resets = log.where(F.col("op") != UPDATE)
        last = N.last_records(resets.select("table", "key", "op", "seq"), ["table", "key"], ["seq"])
        live = last.where(F.col("op") == INSERT).select("table", "key", F.col("seq").alias("since"))
        writes = log.where(F.col("op") != DELETE).join(live, ["table", "key"]).where(F.col("seq") >= F.col("since"))
        each = writes.select("table", "key", "seq", F.explode_outer("fields").alias("field", "value"))
        newest = each.groupBy("table", "key", "field").agg(F.max_by("value", "seq").alias("value"))
        entries = F.array_sort(F.filter(F.collect_list(F.struct("field", "value")), lambda e: e.field.isNotNull()))
        return newest.groupBy("table", "key").agg(F.map_from_entries(entries).alias("fields"))

    def _split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows whose key is live, the others)"""
        live = self.state().select("table", "key")
        return rows.join(live, ["table", "key"], "left_semi"), rows.join(live, ["table", "key"], "left_anti")

    def insert(self, rows: DataFrame) -> dict[str, int]:
        """Insert rows (table, key, fields). How many got which status."""
        if self.upsert:
            n = rows.count()
            self._append(rows, INSERT)
            return {OK: n}
        there, new = self._split(rows)
        counts = {OK: new.count(), ERROR: there.count()}
        self._append(new, INSERT)
        return {k: v for k, v in counts.items() if v}

    def update(self, rows: DataFrame) -> dict[str, int]:
        """Overwrite the fields that rows (table, key, fields) name."""
        there, missing = self._split(rows)
        counts = {OK: there.count(), NOT_FOUND: missing.count()}
        if self.upsert and counts[NOT_FOUND]:
            self._append(missing, INSERT)
            counts = {OK: counts[OK] + counts[NOT_FOUND]}
        if counts[OK]:
            self._append(there, UPDATE)
        return {k: v for k, v in counts.items() if v}

    def delete(self, keys: DataFrame) -> dict[str, int]:
        there, missing = self._split(keys.select("table", "key"))
        counts = {OK: there.count(), NOT_FOUND: missing.count()}
        if counts[OK]:
            self._append(there, DELETE)
        return {k: v for k, v in counts.items() if v}

    def read(self, table: str, key: str, fields: Sequence[str] | None = None) -> tuple[str, dict[str, str] | None]:
        """(status, fields), all of them for None; the key's condition reaches the scan."""
        row = self.state(table).where(F.col("key") == key).first()
        if row is None:
            return NOT_FOUND, None
        return OK, row.fields if fields is None else {k: v for k, v in row.fields.items() if k in fields}

    def scan(self, table: str, start: str, n: int, fields: Sequence[str] | None = None) -> DataFrame:
        """The first n rows from a key on; no rows, not an error, if there are none."""
        rows = self.state(table)
        if fields is not None:
            rows = rows.withColumn("fields", N.project_map(F.col("fields"), fields))
        return S.scan(rows, "key", start, n)


def wide(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A column for each known field instead of a map."""
    return rows.select("key", *[F.col("fields").getItem(f).alias(f) for f in fields])


def shell(rows: Rows, lines: Iterable[str], say: Callable[[str], None] = print) -> None:
    """Commands, one a line: table [name], read key [fields], scan key n [fields], insert key f=v.., update key f=v.., delete key, quit."""
    table = "usertable"
    for line in lines:
        words = shlex.split(line)
        if not words:
            continue
        command, *rest = words
        try:
            if command == "quit":
                return
            if command == "table":
                table = rest[0] if rest else table
                say(f"table {table}")
            elif command == "read":
                status, fields = rows.read(table, rest[0], rest[1:] or None)
                say(f"{status} {fields or {}}")
            elif command == "scan":
                for r in rows.scan(table, rest[0], int(rest[1]), rest[2:] or None).collect():
                    say(f"{r.key} {r.fields}")
            elif command in ("insert", "update"):
                fields = dict(x.split("=", 1) for x in rest[1:])
                df = rows.spark.createDataFrame([(table, rest[0], fields)], "table string, key string, fields map<string,string>")
                say(", ".join((rows.insert if command == "insert" else rows.update)(df)))
            elif command == "delete":
                say(", ".join(rows.delete(rows.spark.createDataFrame([(table, rest[0])], "table string, key string"))))
            else:
                say(f"not a command: {command}")
        except (IndexError, ValueError) as e:
            say(f"{ERROR} {e}")

