"""Time series: queries by tag and time, grouping, downsampling, deletes."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reserved names of time, grouping and downsampling among a query's parts.
TIME, GROUP, DOWNSAMPLE = "YCSBTS", "YCSBGB", "YCSBDS"
FUNCTIONS = {"SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "MAX": F.max, "MIN": F.min}
OK, BAD_REQUEST, NOT_IMPLEMENTED = "OK", "BAD_REQUEST", "NOT_IMPLEMENTED"


@dataclass
class TimeQuery:
    """tags: values wanted for each tag (any of them; all tags). group: tags to group by. every: seconds of a bucket."""

    start: int | None = None
    end: int | None = None
    at: int | None = None
    tags: dict[str, list[str]] = field(default_factory=dict)
    group: list[str] = field(default_factory=list)
    group_by: str = "NONE"
    downsample: str = "NONE"
    every: int = 0


def parse(parts: list[str], ts: str = TIME, group: str = GROUP, downsample: str = DOWNSAMPLE, pair: str = "=", range_: str = ",") -> TimeQuery:
    """A query from its parts: `TIME=a,b` or `TIME=a`, `tag=value`, a bare tag to group by, `GROUP=FUNC`, `DOWNSAMPLE=FUNC60` or `FUNC=60`."""
    q = TimeQuery()
    for part in parts:
        name, sep, value = part.partition(pair)
        if not sep:
            q.group.append(name)
        elif name == ts:
            ends = [int(x) for x in value.split(range_)]
            q.at, (q.start, q.end) = (ends[0], (None, None)) if len(ends) == 1 else (None, ends)
        elif name == group:
            q.group_by = value.upper()
        elif name == downsample:
            m = re.fullmatch(r"([A-Za-z]+)=?(\d+)", value)
            if not m:
                raise ValueError(f"not a downsampling: {value}")
            q.downsample, q.every = m[1].upper(), int(m[2])
        else:
            q.tags.setdefault(name, []).append(value)
    return q


def _status(q: TimeQuery, read: bool) -> str:
    if read:
        return OK if q.at is not None else BAD_REQUEST
    return OK if q.start is not None else NOT_IMPLEMENTED if q.at is not None else BAD_REQUEST


def _matches(q: TimeQuery) -> Column | None:
    out = None
    for tag, values in q.tags.items():
        one = F.col(tag).isin(*values)
        out = one if out is None else out & one
    return out


def within(q: TimeQuery, ts: str = "ts") -> Column:
    """The query's times, in seconds since the epoch, as a condition on a timestamp without a zone; it reaches the scan."""
    at = lambda s: F.expr(f"TIMESTAMP_NTZ'{datetime(1970, 1, 1) + timedelta(seconds=s)}'")
    first, last = (q.at, q.at) if q.at is not None else (q.start, q.end)
    return F.lit(True) if first is None else (F.col(ts) >= at(first)) & (F.col(ts) < at(last + 1))


def typed(points: DataFrame, value: str) -> DataFrame:
    """points to insert, with value_long or value_double in place of a number as text: a point, an exponent or a name makes it double."""
    text = F.trim(F.col(value))
    whole = text.rlike(r"^[+-]?[0-9]+$")
    return points.withColumns({"value_long": F.when(whole, text.try_cast("long")), "value_double": F.when(~whole, text.try_cast("double"))}).drop(value)


def random_span(start: Column, u: Column, span: int, interval: int) -> Column:
    """The end of a query's time range: a random number of intervals, below the whole span, after its start."""
    return (start + interval * F.floor(u * (span // interval))).cast("long")


def read(points: DataFrame, metric: Column | None, q: TimeQuery, ts: str = "ts") -> tuple[str, DataFrame | None]:
    """The points at one time. A range, or no time, is a bad request. (status, rows)"""
    if (status := _status(q, True)) != OK:
        return status, None
    rows = points.where(F.col(ts) == F.lit(q.at)) if metric is None else points.where(metric & (F.col(ts) == F.lit(q.at)))
    return OK, rows if (m := _matches(q)) is None else rows.where(m)


def scan(points: DataFrame, metric: Column | None, q: TimeQuery, ts: str = "ts", value: str = "value") -> tuple[str, DataFrame | None]:
    """The points of a time range, both ends included, filtered, grouped and downsampled. (status, rows)"""
    if (status := _status(q, False)) != OK:
        return status, None
    rows = points.where(F.col(ts).between(F.lit(q.start), F.lit(q.end)))
    rows = rows if metric is None else rows.where(metric)
    rows = rows if (m := _matches(q)) is None else rows.where(m)
    if q.group_by != "NONE":
        rows = grouped(rows, [*q.group, ts], q.group_by, value)
    if q.downsample != "NONE":
        keep = q.group if q.group_by != "NONE" else [c for c in rows.columns if c not in (ts, value)]
        rows = grouped(rows.withColumn(ts, bucket(F.col(ts), q.every)), [*keep, ts], q.downsample, value)
    return OK, rows


def bucket(ts: Column, every: int) -> Column:
    """The start of the bucket of `every` units, counted from 0, that an integer time lies in."""
    return (F.floor(ts / every) * every).cast("long")


def grouped(points: DataFrame, by: list[str], function: str, value: str = "value") -> DataFrame:
    """One of SUM, AVERAGE, COUNT, MAX, MIN of the values of each group."""
    return points.groupBy(*by).agg(FUNCTIONS[function](value).alias(value))


def downsample(points: DataFrame, by: list[str], ts: str, every: str, function: str, value: str = "value", name: str = "bucket") -> DataFrame:
    """The same for each group and each window of time (windows begin at the epoch)."""
    out = points.groupBy(*by, F.window(ts, every).alias("_w")).agg(FUNCTIONS[function](value).alias(value))
    return out.select(*by, F.col("_w.start").alias(name), value)


def parse_delete(text: str, ts: str = TIME, delimiter: str = ":", pair: str = "=") -> tuple[str, TimeQuery]:
    """(metric, query) from `key:tag=value:tag:TIME=a,b`; a bare tag stands for any value."""
    metric, *parts = text.split(delimiter)
    q = parse(parts, ts=ts, pair=pair)
    q.group = []
    return metric, q


def delete(points: DataFrame, metric: Column | None, q: TimeQuery, ts: str = "ts") -> DataFrame:
    """The points that the query doesn't name."""
    gone = metric if metric is not None else F.lit(True)
    if q.at is not None:
        gone = gone & (F.col(ts) == F.lit(q.at))
    elif q.start is not None:
        gone = gone & F.col(ts).between(F.lit(q.start), F.lit(q.end))
    m = _matches(q)
    gone = gone if m is None else gone & m
    return points.where(~F.coalesce(gone, F.lit(False)))


def overwrite(points: DataFrame, series: list[str], ts: str, seq: str) -> DataFrame:
    """The last write of each point: an update is a write at an earlier time."""
    from .snapshot import last_records

    return last_records(points, [*series, ts], [seq])


def delayed(ts: Column, index: Column, total: int, share: float, intervals: int, step: int) -> Column:
    """When the point of a late series is written for: the first `share` of series lag by index modulo `intervals` steps."""
    return F.when(index / F.lit(total) < share, ts - step * F.pmod(index, F.lit(intervals))).otherwise(ts)
