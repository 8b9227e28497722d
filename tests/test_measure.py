"""Percentiles by cells, grammars of result logs, and the entry log's index."""

import math
import random
import threading

import pytest
from sedimenta.operators import measure as M
from sedimenta.operators import scan as S
from sedimenta.operators import snapshot as N
from sedimenta.plans.catalog import QUERIES
from sedimenta.sources import text as X
from sedimenta.sources.entrylog import EntryLog


def test_percentiles_are_those_of_sorting_whatever_the_values(spark):
    r = random.Random(1)
    groups = {"a": [r.randint(-50, 10**9) for _ in range(3000)], None: [0, 0, 5, -3], "b": [7]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v long")
    got = {(x.g, x.p): x.value for x in M.raw_percentiles(rows, ["g"], "v", [0.0, 0.01, 0.5, 0.999]).collect()}
    for g, vs in groups.items():
        for p in (0.0, 0.01, 0.5, 0.999):
            assert got[g, p] == sorted(vs)[int(len(vs) * p)]
    sums = {x.g: x for x in M.summary(rows, ["g"], "v").collect()}
    for g, vs in groups.items():
        assert sums[g].n == len(vs) and sums[g].p95 == sorted(vs)[math.ceil(len(vs) * 0.95) - 1]
    assert M.summary(rows.limit(0), ["g"], "v").count() == 0


def test_no_window_holds_a_whole_group(spark):
    rows = spark.range(1000).selectExpr("'one' AS g", "id * id AS v")
    plan = M.raw_percentiles(rows, ["g"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.split("\n") if "Window" in line and "_within" in line]
    assert sums and all("_cell" in line.split("],")[-2] + line for line in sums)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 300])
def test_cells_are_those_of_counting_the_cuts(spark, n):
    r = random.Random(n)
    cuts = sorted({r.randint(0, 500) for _ in range(n)})
    got = spark.range(-5, 510).select("id", S.cell_among(cuts, S.F.col("id"), "long").alias("c")).collect()
    assert all(x.c == sum(c <= x.id for c in cuts) for x in got)


def test_ranges_of_any_width_meet_their_probes(spark):
    r = random.Random(3)
    probes, ranges = [r.randint(0, 10**12) for _ in range(400)], [sorted((r.randint(0, 10**12), r.randint(0, 10**12))) for _ in range(50)]
    a = spark.createDataFrame([(x,) for x in probes], "p long")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(ranges)], "r int, low long, high long")
    got = sorted((x.p, x.r) for x in S.range_lookup(a, "p", b, "low", "high").collect())
    assert got == sorted((p, i) for p in probes for i, (lo, hi) in enumerate(ranges) if lo <= p <= hi)
    assert S.range_lookup(a.limit(0), "p", b, "low", "high").count() == 0


@pytest.mark.parametrize("bits, depth", [(1, 2), (2, 1), (4, 4)])
def test_totals_of_ranges_are_those_of_all_pairs(spark, bits, depth):
    r = random.Random(bits)
    number = lambda: r.choice([r.randint(0, 300), r.randint(0, 10**6), None])
    probes, ranges = [number() for _ in range(600)], [(r.randint(-50, 50), number(), number()) for _ in range(300)] + [(99, 0, 10**6), (0, None, 5), (0, 9, 3)]
    a, b = spark.createDataFrame([(x,) for x in probes], "p long"), spark.createDataFrame(ranges, "v int, low long, high long")
    want = {}
    for p, v in ((p, v) for p in probes for v, lo, hi in ranges if None not in (p, lo, hi) and lo <= p <= hi):
        n, least = want.get(p, (0, v))
        want[p] = n + 1, min(least, v)
    assert {x.p: (x.n, x.least) for x in S.range_totals(a, "p", b, "low", "high", "v", bits, depth).collect()} == want
    assert S.range_totals(a.limit(0), "p", b, "low", "high", "v").count() == S.range_totals(a, "p", b.limit(0), "low", "high", "v").count() == 0


def _most_rows(plan) -> int:
    """The rows that the largest node of a plan that has run made."""
    name, rows = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    below = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([rows.get().value() if rows.isDefined() else 0, *map(_most_rows, below)])


def test_wide_runs_cost_no_pairs(spark, tmp_path):
    """40 million pairs of a customer and a run, none of which is made."""
    spark.range(20_000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    i, last = S.F.col("id"), S.F.col("id") % 2
    run = (i - last) / 2
    orders = spark.range(4_000).select((run * 500 + last).cast("long").alias("o_orderkey"), (run % 100 + last * 19_800).cast("long").alias("o_custkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["run_prune"](spark, str(tmp_path))
    df._jdf.collectAsList()
    assert _most_rows(df._jdf.queryExecution().executedPlan()) < 500_000
    got = {r.c_custkey: (r.n_runs, r.first_run) for r in df.collect()}
    assert len(got) == 19_900 and got[0] == (20, 0) and got[19_899] == (20, 99) and got[50] == (1_020, 0) and got[19_850] == (1_000, 50)
    assert {got[c] for c in range(100, 19_800)} == {(2_000, 0)}


def test_maps_are_values_of_a_log(spark):
    log = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2}), (2, 1, {})], "k int, seq int, m map<string,int>")
    assert {x.k: x.m for x in N.last_records(log, ["k"], ["seq"]).collect()} == {1: {"b": 2}, 2: {}}


def test_lines_of_result_logs(spark):
    lines = ["[READ], AverageLatency(us), 12.5", "[READ], Return=OK, 7", "[READ, x, 1", "[A], m, none", "", "plain"]
    lines += ["2024-01-02 03:04:05:678 10 sec: 276 operations; 27.6 current ops/sec; est completion in 27 seconds [READ: Count=1]", "2024-01-02 03:04:05:678 x sec: 276 operations; 27.6 current ops/sec;"]
    lines += ["2024-01-02 03:04:05:678 - Loading started: now", "12:Compacting a b into:c", "w:Compacting a into:c", "12:Compacting a"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [tuple(r) for r in X.metrics(df).collect()] == [("READ", "AverageLatency(us)", 12.5), ("READ", "Return=OK", 7.0)]
    (s,) = X.statuses(df).collect()
    assert (str(s.at), s.sec, s.operations, s.ops_per_sec) == ("2024-01-02 03:04:05.678000", 10, 276, 27.6)
    assert [(str(r.at), r.event) for r in X.events(df).collect()] == [("2024-01-02 03:04:05.678000", "Loading started")]
    assert [tuple(r) for r in X.compactions(df).collect()] == [("12", ["a", "b"], "c")]


def test_many_writers_of_one_entry_log(tmp_path):
    path = str(tmp_path / "log")

    def write(w):
        for i in range(50):
            EntryLog(path).append([(f"k{w}", f"v{i}\n", 1), (f"k{w}", None, 0)])

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = EntryLog(path)
    rows = list(log.read(0, None))
    assert log.tail() == 400 and [r[0] for r in rows] == list(range(400))
    for w in range(4):
        assert [r[2] for r in rows if r[1] == f"k{w}" and r[3]] == [f"v{i}\n" for i in range(50)]
    assert list(log.read(100, 103)) == rows[100:103] and list(log.read(500, None)) == [] and EntryLog(path + "x").tail() == 0 and log.append([]) == 400


def test_a_wait_shows_in_the_intended_latency(spark):
    rows = spark.createDataFrame([("READ", 0, 30, 0), ("READ", 30, 35, 10)], "op string, a long, b long, i long")
    got = sorted((r.op, r.latency) for r in M.with_intended(rows, "op", "a", "b", "i").collect())
    assert got == [("Intended-READ", 25), ("Intended-READ", 30), ("READ", 5), ("READ", 30)]
    assert sorted(r.latency for r in M.with_intended(rows, "op", "a", "b", "i", "intended").collect()) == [25, 30]
