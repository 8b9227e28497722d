"""Every query that has SQL against DuckDB on the smallest tables; the others must run."""

import pytest
from oracle import differences
from sedimenta.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_are_those_of_sql(spark, name):
    assert not differences(spark, catalog.QUERIES[name], catalog.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_point_reads_reach_the_scan(spark):
    plan = catalog.QUERIES["kv_point_get"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan
    plan = catalog.QUERIES["scan_range_limit"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "TakeOrderedAndProject" in plan


def test_times_and_segments_reach_the_scan(spark):
    plan = lambda name: catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,192)" in plan("log_segment_read") and "LessThanOrEqual(event_id,255)" in plan("log_segment_read")
    for name in ("ts_range", "ts_point"):
        assert "GreaterThanOrEqual(ts,2024" in plan(name) and "LessThan(ts,2024" in plan(name)


def test_reads_in_batch_have_one_exchange_of_the_log(spark):
    plan = catalog.QUERIES["kv_latest"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz" in plan
