import pytest
from pyspark.sql import functions as F
from sedimenta.operators.bloom import filter_slot, may_hold
from sedimenta.plans import workloads as W
from sedimenta.plans.rows import Rows, shell, wide
from sedimenta.sources import text as T

SCHEMA = "table string, key string, fields map<string,string>"


def test_insert_read_update_scan_delete(spark, tmp_path):
    rows = Rows(spark, str(tmp_path / "r"))
    df = lambda *r: spark.createDataFrame([("t", *x) for x in r], SCHEMA)
    assert rows.insert(df(*[(f"user{i}", {"field0": f"v{i}", "field1": "x"}) for i in range(5)])) == {"OK": 5}
    assert rows.insert(df(("user1", {"field0": "again"}), ("user9", {"field0": "new"}))) == {"OK": 1, "ERROR": 1}
    assert rows.update(df(("user1", {"field0": "newvalue"}), ("nobody", {"field0": "x"}))) == {"OK": 1, "NOT_FOUND": 1}
    assert rows.read("t", "user1") == ("OK", {"field0": "newvalue", "field1": "x"})
    assert rows.read("t", "user1", ["field1"]) == ("OK", {"field1": "x"}) and rows.read("t", "nobody") == ("NOT_FOUND", None)
    assert rows.read("other", "user1") == ("NOT_FOUND", None)
    assert rows.delete(df(("user2", None), ("nobody", None))) == {"OK": 1, "NOT_FOUND": 1}
    assert [r.key for r in rows.scan("t", "user1", 3, ["field0"]).collect()] == ["user1", "user3", "user4"]
    assert rows.scan("t", "zzz", 3).count() == 0
    assert rows.insert(df(("user2", {"field1": "back"}))) == {"OK": 1}
    assert rows.read("t", "user2") == ("OK", {"field1": "back"})
    assert wide(rows.state("t"), ["field0"]).where("key = 'user2'").first().field0 is None


def test_shell(spark, tmp_path):
    said = []
    lines = ["insert k a=1 b=2", "update k b=3", "read k b", "scan a 5", "delete k", "read k", "table u", "read", "what", "", "quit", "read k"]
    shell(Rows(spark, str(tmp_path / "r")), lines, said.append)
    assert said[:3] == ["OK", "OK", "OK {'b': '3'}"] and said[3].startswith("k {") and said[4:7] == ["OK", "NOT_FOUND {}", "table u"]
    assert said[7].startswith("ERROR") and said[8] == "not a command: what" and len(said) == 9


def test_a_filter_misses_no_member(spark):
    keys = spark.range(0, 2000, 2).select(F.concat(F.lit("key"), F.col("id")).alias("k"))
    probes = spark.range(0, 2000).select(F.concat(F.lit("key"), F.col("id")).alias("p"), "id")
    got = may_hold(probes, "p", keys, "k").collect()
    assert all(r.may_hold for r in got if r.id % 2 == 0) and sum(r.may_hold for r in got if r.id % 2) < 50
    assert may_hold(probes, "p", keys.limit(0), "k").where("may_hold").count() == 0
    assert [filter_slot(x) for x in (0, 2000, 3100, 9000)] == [0, 0, 1, 4]


def test_settings():
    assert W.occupancy_records(10**9, 0.5) == 500_000
    assert W.templated("a=1\nrecordcount=5\noperationcount=6", 10, 20) == "a=1\nrecordcount=10\noperationcount=20"


def test_lines_of_many_blocks_and_files_are_numbered_in_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).write_text("".join(f" /{name}/{i}\t\n" for i in range(500)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = T.numbered_lines(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}").select("_metadata.file_block_start").distinct().count() > 2
        assert [tuple(r) for r in rows.orderBy("place").collect()] == [(i, f"/{'ab'[i // 500]}/{i % 500}") for i in range(1000)]
        assert [r.line for r in T.numbered_lines(spark, f"file://{tmp_path}", 2).orderBy("place").collect()] == ["/a/0", "/a/1"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_operations_beyond_a_trace_have_no_address(spark, tmp_path):
    (tmp_path / "reads").write_text("/x\n/y\n")
    w = W.Trace({"READ": f"file://{tmp_path}/reads"}, 300, {"READ": 1.0, "SCAN": 1.0, "DELETE": 1.0}, "exponential")
    got = [tuple(r) for r in W.traced(spark, w).orderBy("op_id").collect()]
    assert len(got) == 300 and {op for _, op, _, _ in got} == {"READ", "DELETE"}
    assert {a for _, op, a, _ in got if op == "READ"} == {"/x", "/y", None} and {a for _, op, a, _ in got if op == "DELETE"} == {None}
    with pytest.raises(ValueError):
        W.traced(spark, W.Trace(w.traces, 3, w.mix, "latest"))
