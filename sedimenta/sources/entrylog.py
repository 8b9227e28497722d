"""A log of numbered entries as a Spark data source, to read in a batch or to follow."""

from __future__ import annotations

import base64
import fcntl
import json
import os
import struct
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, key string, value string, type int"


class EntryLog:
    """Entries as lines of a file that all processes see. Appends take numbers in order; a reader sees whole lines only.

    An index beside the file has 8 bytes for each entry, where its line begins; so the tail is its length, and a range
    is read from its first line on. Appends hold a lock on it.
    """

    def __init__(self, path: str):
        self.path, self.index = path, path + ".idx"

    def append(self, entries: list[tuple[str, str | None, int]]) -> int:
        """Append (key, value, type) entries; returns the new tail."""
        lines = [(json.dumps([base64.b64encode(k.encode()).decode(), v, t]) + "\n").encode() for k, v, t in entries]
        with open(self.index, "ab") as index, open(self.path, "ab") as data:
            fcntl.flock(index, fcntl.LOCK_EX)
            at = os.fstat(data.fileno()).st_size
            data.write(b"".join(lines))
            data.flush()
            index.write(b"".join(struct.pack("<q", at + n) for n in accumulate(map(len, lines[:-1]), initial=0)) if lines else b"")
            index.flush()
            return os.fstat(index.fileno()).st_size // 8

    def tail(self) -> int:
        """The number of the next entry."""
        return os.path.getsize(self.index) // 8 if os.path.exists(self.index) else 0

    def read(self, start: int, end: int | None) -> Iterator[tuple[int, str, str | None, int]]:
        end = min(self.tail(), self.tail() if end is None else end)
        if start >= end:
            return
        with open(self.index, "rb") as index, open(self.path, "rb") as data:
            index.seek(8 * start)
            data.seek(struct.unpack("<q", index.read(8))[0])
            for i in range(start, end):
                k, v, t = json.loads(data.readline())
                yield i, base64.b64decode(k).decode(), v, t


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = EntryLog(options["path"])
        self.start = int(options.get("start", 0))
        self.end = int(options["end"]) if "end" in options else None
        self.entries = int(options.get("entries", 64))

    def partitions(self) -> list[InputPartition]:
        end = self.log.tail() if self.end is None else self.end
        return [_Range(a, min(a + self.entries, end)) for a in range(self.start, end, self.entries)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.log.read(partition.start, partition.end)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log = EntryLog(options["path"])
        self.entries = int(options.get("entries", 64))

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        return {"seq": self.log.tail()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(a, min(a + self.entries, end["seq"])) for a in range(start["seq"], end["seq"], self.entries)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.log.read(partition.start, partition.end)


class EntryLogSource(DataSource):
    """spark.dataSource.register(EntryLogSource), then format("entrylog") with path and, for a batch, start and end."""

    @classmethod
    def name(cls) -> str:
        return "entrylog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
