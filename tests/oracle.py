"""Spark's rows against DuckDB's for a query and its SQL."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in data], key=repr)


def differences(spark, query, sql: str, folder: str) -> str:
    got = query(spark, folder)
    cursor = duck(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    a, b = rows(got.columns, got.collect()), rows(names, cursor.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows, as {str(wrong[0])[:1500]}" if wrong else ""
