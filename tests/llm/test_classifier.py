import math
import random

import numpy as np
from pyspark.sql import functions as F
from sedimenta.llm import quality_classifier as q

from .helpers import odd_documents, table


def test_held_out_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = labels.orderBy(F.xxhash64("doc_id")).limit(1500)
    held = labels.join(seen, "doc_id", "left_anti")
    got = q.classify(docs, seen, labelled=1500, unlabelled=1500).join(held, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0)) and n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def plain_logistic(x, y, penalty):
    """Newton steps with the whole matrix of second derivatives, to the end."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    shrink = np.append(np.full(x.shape[1] - 1, penalty), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-4)) @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def plain_cotrain(text, meta, label, rounds, sure=0.97, share=0.25, penalty=0.02):
    """Scores of all pages by the definition, page by page."""
    known = [i for i in range(len(label)) if label[i] >= 0]
    aside, own = known[::5], [i for n, i in enumerate(known) if n % 5]
    pool = [i for i in range(len(label)) if label[i] < 0]
    views = [text * 8.0, (meta - meta[own].mean(0)) / (meta[own].std(0) + 1e-3)]
    given = [{}, {}]

    def fit(v):
        rows = own + list(given[v])
        return plain_logistic(views[v][rows], np.array([label[i] for i in own] + list(given[v].values())), penalty * len(rows) / 100)

    margin = lambda v, w, i: float(views[v][i] @ w[:-1] + w[-1])
    w = [fit(0), fit(1)]
    rate = np.mean([label[i] for i in own])
    for _ in range(rounds):
        most = int(share * len(pool))
        for v in (0, 1):
            p = {i: 1 / (1 + math.exp(-margin(v, w[v], i))) for i in pool}
            for value, chance, quota in ((1, p, int(most * rate)), (0, {i: 1 - x for i, x in p.items()}, int(most * (1 - rate)))):
                given[1 - v].update({i: value for i in sorted(pool, key=lambda i: (-chance[i], i))[:quota] if chance[i] >= sure})
        w = [fit(0), fit(1)]
    both = np.array([[margin(0, w[0], i), margin(1, w[1], i)] for i in range(len(label))])
    platt = plain_logistic(both[aside], label[aside], 1e-2)
    return 1 / (1 + np.exp(-np.clip(both @ platt[:-1] + platt[-1], -30, 30))), [len(g) for g in given]


def weak_and_strong(seed, n=600, labelled=60):
    """Few labels; the text view is weak on them alone, the metadata tells the classes apart."""
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    text = r.normal(size=(n, 40)).astype(np.float32) * 0.3
    text[:, 0] += 0.4 * y
    meta = r.normal(size=(n, 5)).astype(np.float32)
    meta[:, 0] += 4 * y
    return text, meta, np.where(np.arange(n) < labelled, y, -1), y


def test_scores_are_those_of_the_definition():
    for seed, rounds in ((1, 0), (2, 1), (3, 3)):
        text, meta, label, _ = weak_and_strong(seed, 900, 400)
        meta[:, 0] /= 2  # not separable, so that the calibration is well defined
        got = q.cotrain(text, meta, label, rounds=rounds).scores(text, meta)[2]
        want, given = plain_cotrain(text, meta, label, rounds)
        assert np.abs(got - want).max() < 0.05 and np.abs(got - want).mean() < 0.003 and (rounds == 0 or min(given) > 0)


def test_views_teach_each_other():
    """Rounds raise the weak view on pages without labels."""
    gains = []
    for seed in range(5):
        text, meta, label, y = weak_and_strong(seed, 1200)
        right = lambda rounds: ((text[60:] @ (m := q.cotrain(text, meta, label, rounds=rounds)).text[:-1] + m.text[-1] > 0) == y[60:]).mean()  # noqa: E731, B023
        gains.append(right(3) - right(0))
    assert min(gains) > 0 and np.mean(gains) > 0.03


def test_the_fit_minimises_the_loss():
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 5))
    y = (x @ [1, -2, 0, 0, 0.5] + 0.3 + r.normal(size=500) > 0).astype(float)
    w = q.logistic(x, y, 1.0, 50)
    p = q._sigmoid(np.column_stack([x, np.ones(500)]) @ w)
    grad = np.column_stack([x, np.ones(500)]).T @ (p - y) + np.array([1.0] * 5 + [1e-6]) * w
    assert np.abs(grad).max() < 0.1


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int, kept boolean")
    for rows in ([], [(1, 1, 0, True), (2, 1, 0, True)], [(None, 1, 0, True), (5, None, 1, True)], [(1, 1, 0, True), (77, 0, 0, True)]):
        got = q.classify(docs, labels(rows)).collect()
        assert len(got) == docs.count() and all(r.score == 0.5 and r.kept for r in got)
    r = random.Random(1)
    rows = [(100 + i, " ".join(r.choice(["good", "fine", "nice"]) for _ in range(50)) if i % 2 else "$$$ %%% " * 30, "s", "en", 10) for i in range(60)]
    more = table(spark, rows).select(*[F.col(c) if c in ("doc_id", "text", "lang", "source", "n_chars") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    both = docs.unionByName(more)
    got = q.classify(both, labels([(100 + i, i % 2, 0, True) for i in range(60)]))
    assert got.columns == ["doc_id", "p_text", "p_meta", "score", "kept"] and got.count() == both.count()
    assert got.where("doc_id >= 100 AND kept = (doc_id % 2 = 1)").count() == 60
    equal = [x for x in got.where("doc_id = 1").collect()]
    assert equal[0] == equal[1] and q.classify(docs.limit(0), labels([])).count() == 0
    whole = q.classify(both, labels([(100 + i, i % 2, 0, True) for i in range(60)]), whole_rows=True).select("row.*")
    assert whole.columns == both.columns
