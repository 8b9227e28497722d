"""The control logs: which files are live, who works on a task, which workers are dead."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_number(name: Column) -> Column:
    """The whole number that a file name ends with."""
    return F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).cast("long")


def name_parts(name: Column) -> dict[str, Column]:
    """What a file name says: prefix, suffix, level of a sorted run, entry range a:b and version before the underscore."""
    suffix = F.regexp_extract(name, r"^[^/]*/(.*)$", 1)
    return {
        "prefix": F.regexp_extract(name, r"^([^/]*)/", 1),
        "suffix": suffix,
        "level": F.nullif(F.regexp_extract(name, r"^sstable(\d+)/", 1), F.lit("")).cast("int"),
        "start_offset": F.nullif(F.regexp_extract(suffix, r"^(\d+):\d+$", 1), F.lit("")).cast("long"),
        "end_offset": F.nullif(F.regexp_extract(suffix, r"^\d+:(\d+)$", 1), F.lit("")).cast("long"),
        "version": F.nullif(F.regexp_extract(suffix, r"^(\d+)_", 1), F.lit("")).cast("long"),
    }


def live_files(operations: DataFrame) -> DataFrame:
    """(file, seq, key_start, key_end) of files that some operation put out and none took in. For well-formed logs."""
    zipped = F.arrays_zip("outputs", F.coalesce("key_start", F.array().cast("array<string>")).alias("key_start"), F.coalesce("key_end", F.array().cast("array<string>")).alias("key_end"))
    made = operations.select("seq", F.explode(zipped).alias("o")).select(F.col("o.outputs").alias("file"), "seq", "o.key_start", "o.key_end")
    taken = operations.where("op = 'COMPACT'").select(F.explode("inputs").alias("file"))
    return made.where("file IS NOT NULL").join(taken, "file", "left_anti")


def chain_end(numbers: DataFrame, number: str) -> DataFrame:
    """(tail): the last number of the unbroken chain 1, 2, 3, ... ; later ones wait for what is missing.

    The first gap is found from neighbours: `numbers` are distinct and a window over cells isn't needed.
    """
    have = numbers.select(F.col(number).cast("long").alias("n")).where("n >= 1").distinct()
    after = have.select((F.col("n") + 1).alias("n")).union(have.sparkSession.range(1, 2).select(F.col("id").alias("n"))).distinct()
    return after.join(have, "n", "left_anti").agg((F.min("n") - 1).alias("tail"))


def acknowledged(ids: DataFrame, column: str, base: int = 0) -> DataFrame:
    """(limit): the greatest id such that all from `base` to it are acknowledged; base - 1 if none."""
    return chain_end(ids.select((F.col(column) - base + 1).alias("n")), "n").select((F.col("tail") + base - 1).alias("limit"))


def view(operations: DataFrame, log_prefix: str = "sharedlog", by: str | None = None) -> DataFrame:
    """The exact fold of an operation log, out-of-order records and all: (prefix, file_ord, file, key_start, key_end, is_tail).

    LOGCREATE input -> output is applied when input is the tail (or there is none) and otherwise waits; one that the
    chain has passed is dropped. COMPACT is applied when its first input is the oldest file of its level, or (in the
    last level, where outputs take the inputs' place) when all inputs are there; otherwise it waits. A control log has a
    record for each segment and merge, not for each write; `by` folds many logs at once, a task each.
    """
    key = by or "_log"
    rows = operations if by else operations.withColumn("_log", F.lit(0))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        levels: dict[str, list[str]] = {}
        ranges: dict[str, tuple] = {}
        tail, waiting = None, []
        prefix = lambda f: f.split("/", 1)[0] if "/" in f else log_prefix

        def apply(r: dict) -> bool | None:
            nonlocal tail
            inputs, outputs = list(r["inputs"] if r["inputs"] is not None else []), list(r["outputs"])
            if r["op"] == "LOGCREATE":
                source = inputs[0] if inputs else ""
                if tail is None or source == tail:
                    levels.setdefault(prefix(outputs[0]), []).append(outputs[0])
                    tail = outputs[0]
                    return True
                return None if outputs[0] in levels.get(prefix(outputs[0]), []) else False
            files = levels.setdefault(prefix(inputs[0]), [])
            if not all(f in files for f in inputs):
                return False
            place = files.index(inputs[0])
            if not r["in_last_level"] and place:
                return False
            for f in inputs:
                files.remove(f)
            target = levels.setdefault(prefix(outputs[0]), []) if outputs else files
            if r["in_last_level"] and target is files:
                target[place:place] = outputs
            else:
                target.extend(outputs)
            starts, ends = r["key_start"], r["key_end"]
            for i, f in enumerate(outputs):
                ranges[f] = (starts[i] if starts is not None and i < len(starts) else None, ends[i] if ends is not None and i < len(ends) else None)
            return True

        for r in pdf.sort_values("seq").to_dict("records"):
            waiting.append(r)
            again = True
            while again:
                again = False
                for w in list(waiting):
                    done = apply(w)
                    if done is not False:
                        waiting.remove(w)
                        again |= bool(done)
        out = [
            (pdf[key].iloc[0], p, i, f, *ranges.get(f, (None, None)), f == tail)
            for p, files in sorted(levels.items()) for i, f in enumerate(files)
        ]
        return pd.DataFrame(out, columns=[key, "prefix", "file_ord", "file", "key_start", "key_end", "is_tail"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.groupBy(key).applyInPandas(fold, f"{key} {kind}, prefix string, file_ord long, file string, key_start string, key_end string, is_tail boolean")
    return out if by else out.drop(key)


def task_owners(tasks: DataFrame, task: str, generation: str, owner: str, seq: str) -> DataFrame:
    """Who works on each task: the first to claim its latest generation. (task, generation, owner, seq, n_claims)"""
    first = tasks.groupBy(task, generation).agg(F.min(F.struct(seq, owner)).alias("c"), F.count("*").alias("n_claims"))
    newest = first.groupBy(task).agg(F.max(F.struct(generation, "c", "n_claims")).alias("r"))
    return newest.select(task, f"r.{generation}", F.col(f"r.c.{owner}").alias(owner), F.col(f"r.c.{seq}").alias(seq), F.col("r.n_claims").alias("n_claims"))


def dead_tasks(tasks: DataFrame, task: str, ts: str, status: str, now: Column, timeout: Column) -> DataFrame:
    """Tasks whose last sign of life is `timeout` or more before now and that aren't finished. (task, ts, status)"""
    last = tasks.groupBy(task).agg(F.max(F.struct(ts, status)).alias("r")).select(task, f"r.{ts}", f"r.{status}")
    return last.where(~F.col(status).isin("COMPLETE", "DEAD") & (now - F.col(ts) >= timeout))


def reclaims(tasks: DataFrame, dead: DataFrame, task: str, generation: str) -> DataFrame:
    """The claims to make for dead tasks: (task, generation), one above the last."""
    return tasks.join(dead.select(task), task, "left_semi").groupBy(task).agg((F.max(generation) + 1).alias(generation))


def intervals(events: DataFrame, key: str, at: str, kind: str, begin: str, end: str) -> DataFrame:
    """The n-th `begin` of each key with its n-th `end`: (key, place, begin_at, end_at)."""
    w = Window.partitionBy(key, kind).orderBy(at)
    placed = events.where(F.col(kind).isin(begin, end)).withColumn("place", F.row_number().over(w))
    both = placed.groupBy(key, "place").agg(F.max(F.when(F.col(kind) == begin, F.col(at))).alias("begin_at"), F.max(F.when(F.col(kind) == end, F.col(at))).alias("end_at"))
    return both.where("begin_at IS NOT NULL AND end_at IS NOT NULL")
