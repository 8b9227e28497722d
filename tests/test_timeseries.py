import pytest
from pyspark.sql import functions as F
from sedimenta.operators import timeseries as T
from sedimenta.plans import workloads as W


def test_series_follow_the_odometer(spark):
    got = W.series(spark, 2, [1, 2], 3).orderBy("point").collect()
    assert [(r.metric, r.tags["AA"], r.tags["AB"], r.ts) for r in got[:5]] == [
        ("AAAA", "AAAA", "AAAA", 1451606400), ("AAAA", "AAAA", "AAAB", 1451606400), ("AAAB", "AAAA", "AAAA", 1451606400),
        ("AAAB", "AAAA", "AAAB", 1451606400), ("AAAA", "AAAA", "AAAA", 1451606460)]
    assert len(got) == 12


def test_requests_that_are_wrong(spark):
    points = spark.createDataFrame([(1, "a", 2.0)], "ts long, tag string, value double")
    assert T.read(points, None, T.parse(["YCSBTS=1,2"]))[0] == T.BAD_REQUEST
    assert T.read(points, None, T.parse(["tag=a"]))[0] == T.BAD_REQUEST
    assert T.scan(points, None, T.parse(["YCSBTS=1"]))[0] == T.NOT_IMPLEMENTED
    assert T.scan(points, None, T.parse(["tag=a"]))[0] == T.BAD_REQUEST
    with pytest.raises(ValueError):
        T.parse(["YCSBDS=60"])


def test_either_form_of_downsampling():
    assert T.parse(["YCSBDS=SUM60"]) == T.parse(["YCSBDS=SUM=60"])


def test_ranges_include_both_ends_and_deletes_spare_the_rest(spark):
    points = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(10)], "ts long, tag string, value double")
    assert T.scan(points, None, T.parse(["YCSBTS=2,5"]))[1].count() == 4
    metric, q = T.parse_delete("m:tag=a:YCSBTS=2,5")
    assert metric == "m" and sorted(r.ts for r in T.delete(points, None, q).collect()) == [0, 1, 3, 5, 6, 7, 8, 9]
    null = points.unionByName(spark.createDataFrame([(3, None, 1.0)], points.schema))
    assert T.delete(null, F.lit(True), q).count() == 9


def test_standard_workloads_ask_for_what_there_is(spark):
    for name, (mix, _) in W.MIXES.items():
        w = W.Core.standard(name, 1000, 500)
        ops = W.operations(spark, w).collect()
        assert {o.op for o in ops} <= set(mix) and all(0 <= o.keynum < 1500 for o in ops)
        assert all(1 <= o.length <= 100 for o in ops)
        assert W.operations(spark, w).collect() == ops
