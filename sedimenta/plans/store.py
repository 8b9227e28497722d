"""A key-value store over a shared folder: a record log, sorted runs in levels, and a manifest of versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DELETION
from ..operators import runs as R
from ..operators import scan as S
from ..operators import snapshot as N
from ..sources import log as L


@dataclass
class Config:
    """level_size: bytes of each level before it is merged down; file_size: of a run in the last level."""

    max_level: int = 2
    level_size: list[int] = field(default_factory=lambda: [256 << 20, 1 << 30])
    file_size: list[int] = field(default_factory=lambda: [64 << 20, 256 << 20])
    log_files: int = 2
    last_files: int = 4

    def of(self, sizes: list[int], level: int) -> int:
        """A level's size; levels below those listed are each four times as large as the one above."""
        return sizes[level - 1] if level <= len(sizes) else sizes[-1] * 4 ** (level - len(sizes))

    @classmethod
    def read(cls, text: str) -> Config:
        """From the flat JSON of a deployment; names in any case."""
        raw = {k.lower(): v for k, v in json.loads(text).items()}
        own = cls(max_level=int(raw.get("max_level", 2)))
        if own.max_level < 2:
            raise ValueError("a store has two levels or more")
        own.level_size = [int(x) for x in raw.get("level_size", own.level_size)]
        own.file_size = [int(x) for x in raw.get("level_file_size_limit", own.file_size)]
        own.log_files = int(raw.get("log_file_number_limit", own.log_files))
        return own


class Store:
    """put, remove, get, scan, and compaction as an explicit call.

    The state is what the log says: a key's record with the greatest seq counts, in whatever segment or run it lies. A
    manifest version lists the live segments and runs; a new one is written whole and renamed, so readers keep the view
    they began with. For one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, listener: Callable[[str, dict], None] | None = None):
        """listener is told of "new_tail", "compaction_started", "compaction_completed" and "view_updated"."""
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.tell = listener or (lambda event, what: None)
        self.log = L.RecordLog(spark, f"{self.path}/log")

    def manifest(self) -> dict:
        """{"version", "compacted": segments that runs hold, "runs": [{level, ord, path, key_min, key_max, n, bytes}]}"""
        fs, p = L._fs(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        versions = sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))
        if not versions:
            return {"version": 0, "compacted": [], "runs": []}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{versions[-1]}.json").collect()))

    def _commit(self, m: dict) -> None:
        m = m | {"version": m["version"] + 1}
        if not L.put_text(self.spark, f"{self.path}/manifest/{m['version']}.json", json.dumps(m)):
            raise RuntimeError("another writer has committed this version")
        self.tell("view_updated", {"version": m["version"]})

    def put(self, rows: DataFrame) -> None:
        self.tell("new_tail", {"segment": self.log.put(rows)})

    def remove(self, keys: DataFrame) -> None:
        self.tell("new_tail", {"segment": self.log.delete(keys)})

    def layers(self, key: str | None = None) -> list[DataFrame]:
        """Newest first: the segments that no run holds, then the runs of each level; `key` skips runs by their range."""
        m = self.manifest()
        log = self.log.records().where(~F.col("segment").isin(m["compacted"]) if m["compacted"] else F.lit(True)).drop("segment")
        out = [log]
        for level in range(1, self.config.max_level + 1):
            paths = [r["path"] for r in m["runs"] if r["level"] == level and (key is None or r["key_min"] <= key <= r["key_max"])]
            if paths:
                out.append(self.spark.read.parquet(*paths))
        return out

    def records(self, key: str | None = None) -> DataFrame:
        first, *rest = self.layers(key)
        for layer in rest:
            first = first.unionByName(layer)
        return first

    def state(self) -> DataFrame:
        return N.snapshot(self.records(), ["key"], ["seq"], F.col("type") == DELETION).select("key", "value")

    def get(self, key: str) -> str | None:
        row = N.get(self.records(key), "key", ["seq"], F.col("type") == DELETION, key).first()
        return row.value if row else None

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return N.multi_get(probes.select(F.col("key").alias("probe")), "probe", self.records(), "key", ["seq"], F.col("type") == DELETION, ["value"])

    def scan(self, start: str, n: int) -> DataFrame:
        return S.scan(self.state(), "key", start, n)

    def _write(self, rows: DataFrame, level: int, size: int) -> list[dict]:
        """A run of the level. Above the last level a merge has one output; there it is split by size."""
        files = R.output_files(size, self.config.of(self.config.file_size, level)) if level == self.config.max_level else 1
        path = f"{self.path}/sstable{level}/{uuid.uuid4().hex}"
        R.write_run(rows.select("key", "value", "type", "seq"), path, "key", files)
        written = self.spark.read.parquet(path).select("key", "_metadata.file_path", "_metadata.file_size")
        ends = written.groupBy("file_path").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n"), F.max("file_size").alias("size"))
        return [{"level": level, "path": r.file_path, "key_min": r.a, "key_max": r.b, "n": r.n, "bytes": r["size"]} for r in ends.orderBy("a").collect()]

    def compact(self) -> bool:
        """One merge, the most urgent: the two oldest segments or runs of a level go into the next. False if none is due.

        Deletions stay: a run below may hold the key.
        """
        m, c = self.manifest(), self.config
        segments = [s for s in self.log._segments() if s not in m["compacted"]]
        if len(segments) > c.log_files:
            taken = segments[:2]
            self.tell("compaction_started", {"level": 0, "inputs": taken})
            rows = self.log.records().where(F.col("segment").isin(taken)).drop("segment")
            size = self.log.sizes().where(F.col("segment").isin(taken)).agg(F.sum("size_bytes")).first()[0] or 0  # segments without records have no files to count
            new = self._write(N.last_records(rows, ["key"], ["seq"]), 1, size)
            self._commit(m | {"compacted": m["compacted"] + taken, "runs": m["runs"] + new})
            self.tell("compaction_completed", {"level": 1, "outputs": [r["path"] for r in new]})
            return True
        for level in range(1, c.max_level + 1):
            own = [r for r in m["runs"] if r["level"] == level]
            last = level == c.max_level
            if len(own) > c.last_files if last else len(own) > 1 and sum(r["bytes"] for r in own) > c.of(c.level_size, level):
                taken = own[:2]
                self.tell("compaction_started", {"level": level, "inputs": [r["path"] for r in taken]})
                rows = self.spark.read.parquet(*[r["path"] for r in taken])
                new = self._write(N.last_records(rows, ["key"], ["seq"]), level if last else level + 1, sum(r["bytes"] for r in taken))
                runs = list(m["runs"])
                place = runs.index(taken[0]) if last else None
                runs = [r for r in runs if r not in taken]
                runs[place if last else len(runs) : place if last else len(runs)] = new
                self._commit(m | {"runs": runs})
                self.tell("compaction_completed", {"level": new[0]["level"] if new else level, "outputs": [r["path"] for r in new]})
                return True
        return False

    def vacuum(self) -> int:
        """Delete the segments that runs hold and older manifest versions; readers of an old view are gone by then.

        The newest segment that has records stays, compacted or not: the log's numbers go on from it.
        """
        m, n = self.manifest(), 0
        last = L.newest(self.spark, self.log.path, "segment")
        gone = [s for s in m["compacted"] if last and s < last[0]]
        for s in gone:
            n += L.remove(self.spark, f"{self.log.path}/segment={s}")
        if gone:
            self._commit(m | {"compacted": [s for s in m["compacted"] if s not in gone]})
            m = self.manifest()
        for v in range(1, m["version"]):
            L.remove(self.spark, f"{self.path}/manifest/{v}.json")
        return n


__all__ = ["Config", "Store"]
