import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sedimenta.model import RECORD
from sedimenta.operators import runs as R
from sedimenta.operators import snapshot as N



def gone():
    return F.col("type") == 0


def log(spark, rows):
    return spark.createDataFrame([(k, v, t, i) for i, (k, v, t) in enumerate(rows)], RECORD)


def state(df):
    return {r.key: r.value for r in df.collect()}


def replay(rows):
    out = {}
    for k, v, t in rows:
        out.pop(k, None)
        if t:
            out[k] = v
    return out


def test_overwrites_deletes_and_absent_keys(spark):
    rows = [(f"key{i}", f"value{i}", 1) for i in range(100)] + [(f"key{i}", f"value_new{i // 10}", 1) for i in range(0, 100, 10)] + [("key5", None, 0)]
    df = log(spark, rows)
    assert state(N.snapshot(df, ["key"], ["seq"], gone())) == replay(rows)
    assert N.get(df, "key", ["seq"], gone(), "key20").first().value == "value_new2"
    assert N.get(df, "key", ["seq"], gone(), "key5").first() is None and N.get(df, "key", ["seq"], gone(), "key100").first() is None
    probes = spark.createDataFrame([("key1",), ("key5",), ("key100",)], "probe string")
    got = {r.probe: (r.status, r.value) for r in N.multi_get(probes, "probe", df, "key", ["seq"], gone(), ["value"]).collect()}
    assert got == {"key1": ("OK", "value1"), "key5": ("DELETED", None), "key100": ("NOT_FOUND", None)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.text("xyz", max_size=2), st.integers(0, 1)), min_size=1, max_size=40), st.integers(1, 7))
def test_compaction_never_changes_the_state(spark, rows, size):
    df = log(spark, rows).withColumn("run", F.floor(F.col("seq") / size))
    merged = R.merge_runs(df, F.floor(F.col("run") / 2), "key", ["run", "seq"])
    assert state(N.snapshot(merged, ["key"], ["seq"], gone())) == replay(rows)


def test_a_condition_on_values_comes_after_the_reduction(spark):
    df = log(spark, [("a", "1", 1), ("a", None, 0)])
    assert not N.snapshot(df, ["key"], ["seq"], gone()).collect()


def test_field_merge_with_resets(spark):
    writes = spark.createDataFrame([("r", 1, "a", "1"), ("r", 2, "b", "2"), ("r", 5, "b", "3"), ("s", 1, "a", "9")], "key string, seq long, field string, value string")
    resets = spark.createDataFrame([("r", 3, False), ("s", 4, True)], "key string, seq long, deleted boolean")
    got = {r.key: r.fields for r in N.merge_fields(writes, ["key"], "seq", "field", "value", resets).collect()}
    assert got == {"r": {"b": "3"}}


def test_layers_hide_what_is_older(spark):
    new, old = log(spark, [("a", None, 0), ("b", "2", 1)]), log(spark, [("a", "old", 1), ("c", "3", 1)])
    probes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert state(N.layered_get(probes, "k", [new, old], "key", ["seq"], gone())) == {"b": "2", "c": "3"}


def test_rolled_sizes_equal_a_running_sum(spark):
    r = random.Random(3)
    sizes = [r.randint(1, 50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "seq long, n long")
    one = {x.seq: x.segment for x in R.roll(df, ["seq"], F.col("n"), 100).collect()}
    two = {x.seq: x.segment for x in R.rolled_sizes(df, "seq", F.col("n"), 100, 64).collect()}
    total, want = 0, {}
    for i, n in enumerate(sizes):
        want[i] = total // 100
        total += n
    assert one == two == want
