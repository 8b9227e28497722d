import struct
from pathlib import Path

from oracle import differences
from pyspark.sql import functions as F
from sedimenta.functions import generators as G
from sedimenta.functions import scalar as Z
from sedimenta.operators.measure import log_bounds, log_bucket
from sedimenta.plans.catalog import QUERIES, SQL


def test_hashes_of_edges(spark):
    def fnv(v):
        h = Z.FNV_BASIS
        for _ in range(8):
            h = ((h ^ (v & 255)) * Z.FNV_PRIME) % 2**64
            v >>= 8
        return abs(h - 2**64 if h >> 63 else h)

    df = spark.createDataFrame([(x,) for x in [0, 1, -1, 255, 2**62, -(2**63), 123456789]], "v long")
    assert all(r.h == fnv(r.v) for r in df.select("v", Z.fnv64(F.col("v")).alias("h")).collect())
    texts = spark.createDataFrame([("",), ("abc",), ("hello world",), ("a\U0001f642b",)], "t string")
    assert [r.h for r in texts.select(Z.java_hash(F.col("t")).alias("h")).collect()][:3] == [0, 96354, 1794106052]


def test_codecs_refuse_what_is_cut_short(spark):
    one = spark.range(1).select(Z.encode_message(F.lit(b"k"), F.lit(b"v" * 300), F.lit(1)).alias("m"))
    two = one.select(Z.decode_messages(F.concat("m", "m")).alias("r")).select("r.ok", F.size("r.records").alias("n")).first()
    assert (two.ok, two.n) == (True, 2)
    cut = one.select(Z.decode_messages(F.substring("m", 1, 100)).alias("r")).select("r.ok", F.size("r.records").alias("n")).first()
    assert (cut.ok, cut.n) == (False, 0)
    empty = spark.range(1).select(Z.decode_messages(F.lit(b"")).alias("r")).select("r.ok", F.size("r.records").alias("n")).first()
    assert (empty.ok, empty.n) == (True, 0)


def test_row_bytes_are_as_documented(spark):
    blob = spark.range(1).select(Z.encode_row(F.create_map(F.lit("f"), F.lit(b"xy"))).alias("b")).first().b
    assert bytes(blob) == struct.pack(">i", 1) + b"f" + struct.pack(">i", 2) + b"xy"


def test_bytes_of_zeros_and_powers_are_those_of_sql(spark, tmp_path):
    for p in Path("/root/testdata/sf0.001").iterdir():
        if p.name != "customer.parquet":
            (tmp_path / p.name).symlink_to(p)
    values = [0.0, -0.0, None, 0.01, -0.01, *[s * 2.0**e for s in (1, -1) for e in range(-3, 14)], 8191.99, -999.99]
    rows = [(749 + i, v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert not differences(spark, QUERIES["bytes_roundtrip"], SQL["bytes_roundtrip"], str(tmp_path))
    got = {r.c_custkey: r for r in QUERIES["bytes_roundtrip"](spark, str(tmp_path)).collect()}
    assert struct.pack(">d", got[750].value) == struct.pack(">d", -0.0) and got[750].double_bytes == got[749].double_bytes == "0" * 16
    assert bytes(spark.range(1).select(Z.double_to_bytes(F.lit(-0.0)).alias("b")).first().b) == struct.pack(">d", -0.0)


def test_index_keys(spark):
    df = spark.createDataFrame([(b"abcdef", b"abzz"), (b"abc", b"abd"), (b"ab", b"abc")], "a binary, b binary")
    assert [bytes(r.s) for r in df.select(Z.separator("a", "b").alias("s")).collect()] == [b"abd", b"abc", b"ab"]
    keys = spark.createDataFrame([(b"abc",), (b"\xff\xffa",), (b"\xff",)], "k binary")
    assert [bytes(r.s) for r in keys.select(Z.successor("k").alias("s")).collect()] == [b"b", b"\xff\xffb", b"\xff"]


def test_field_values_start_with_their_names(spark):
    v = spark.range(1).select(Z.field_value(F.lit("user1"), F.lit("field0"), F.lit(40)).alias("v")).first().v
    assert len(v) == 40 and v.startswith("user1:field0:")


def test_zipfian_shares_follow_the_law(spark):
    u = G.unit(F.col("id"))
    counts = {r.i: r.n for r in spark.range(20000).select(G.zipfian(u, 100).alias("i")).groupBy("i").agg(F.count("*").alias("n")).collect()}
    assert max(counts) < 100 and abs(counts[0] / 20000 - 1 / G.zeta(100)) < 0.02
    assert abs(G.zeta(2_000_000) - sum(1 / i**0.99 for i in range(1, 2_000_001))) < 1e-6


def test_histogram_bounds_by_rule():
    b = log_bounds()
    assert len(b) == 154 and b[:12] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14] and b[-2:] == [9e9, 1e200] and b == sorted(b)


def test_buckets_are_the_first_bound_above(spark):
    bounds = log_bounds()
    values = [-1.0, 0.0, 0.5, 1e12, 8.9e9] + bounds[:-1] + [b - 1e-6 * b for b in bounds[:-1]] + [b * 1.01 for b in bounds[:-1]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", log_bucket(F.col("v")).alias("b")).collect()
    assert all(r.b == sum(b <= r.v for b in bounds[:-1]) for r in got)
