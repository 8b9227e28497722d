import random

import pytest
from sedimenta.llm import mixing

from .helpers import odd_documents, rows_of, table


def fill(sizes, weights, most=3):
    """Targets by sharing again and again."""
    total, capped, out = sum(sizes), set(), {}
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > most * sizes[i]]
        if not over:
            out = {i: rest * weights[i] / w for i in open_} | {i: float(most * sizes[i]) for i in capped}
            return [out[i] for i in range(len(sizes))]
        capped |= set(over)


def test_targets_are_those_of_sharing_again_and_again(spark):
    r = random.Random(2)
    for _ in range(4):
        sizes = [r.choice([1, 5, 50, 1000, 20000]) for _ in range(9)]
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
        got = {x.source: x.target for x in mixing.targets(df).collect()}
        want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(9)])
        assert all(got[f"s{i}"] == pytest.approx(want[i]) for i in range(9))


def test_a_mix_comes_near_its_targets_and_reruns_agree(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), f"s{r.choice([0, 0, 0, 1, 2])}", "en", 0) for i in range(3000)]
    docs = table(spark, rows)
    got = mixing.systematic_mix(docs).collect()
    taken, target = {}, {}
    for x in got:
        taken[x.source_size] = taken.get(x.source_size, 0) + x.taken
        target[x.source_size] = x.target
        assert 0 <= x.copies <= 3 and x.taken == x.copies * x.size
    assert all(taken[s] == pytest.approx(target[s], rel=0.02) for s in target)
    again = mixing.systematic_mix(docs.repartition(7)).collect()
    assert sorted(got) == sorted(again)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns and whole.count() == sum(x.copies for x in got)


def test_defined_results_for_odd_rows(spark):
    docs = odd_documents(spark)
    got = mixing.systematic_mix(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "copies", "taken"] and got.count() == docs.count()
    sizes = dict(rows_of(got, "doc_id", "size"))
    assert (sizes[3], sizes[4], sizes[5], sizes[6], sizes[8]) == (0, 0, 0, 30_000, 5)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.systematic_mix(docs.limit(0)).count() == 0
    none = mixing.systematic_mix(table(spark, [(1, None, "a", "en", 0), (2, "", None, "en", 0)])).collect()
    assert all(r.taken == 0 and r.target == 0 and r.copies == 0 for r in none)


def test_null_and_repeated_ids_are_dealt_by_their_texts(spark, monkeypatch):
    """3,000 rows without an id meet in many tasks, and the sample is that of any other dealing."""
    rows = [(None, f"text {i} " + "w " * (i % 7), "s", "en", 0) for i in range(3000)]
    got = mixing.systematic_mix(table(spark, rows))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    key = mixing.F.md5(mixing.F.concat(mixing.F.lit("7:null:"), mixing.F.md5("text")))
    salts = table(spark, rows).select((mixing.F.conv(mixing.F.substring(key, 1, 8), 16, 10).cast("long") % 64).alias("s")).distinct().count()
    assert salts == 64 and sum(r.taken for r in got.collect()) == pytest.approx(got.first().target, rel=0.01)


def test_many_sources_are_ranked_in_ranges(spark):
    names = [f"h{i:05d}" for i in range(2000)] + [None]
    random.Random(1).shuffle(names)
    got = mixing._ranked(spark.createDataFrame([(n, 1) for n in names], "source string, size long")).collect()
    order = sorted((n for n in names if n), key=str) + [None]
    assert {r.source: r.n for r in got} == {n: i for i, n in enumerate(order)}


def test_a_document_is_taken_at_its_rate_over_seeds(spark):
    """One random offset: over many seeds each document is taken as often as its rate says."""
    rows = [(i, "w " * (1 + i * i % 50), f"s{i % 3}", "en", 0) for i in range(30)]
    docs, total, rate = table(spark, rows), {}, {}
    for seed in range(16):
        for r in mixing.systematic_mix(docs, seed=seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
            rate[r.doc_id] = r.target / r.source_size
    assert all(abs(total[i] / 16 - rate[i]) < 0.5 for i in total) and sum(total.values()) / 16 == pytest.approx(sum(rate.values()), rel=0.05)
