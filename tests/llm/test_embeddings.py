import math
import pickle

import numpy as np
from sedimenta.llm import embedding_dedup as e


def brute(v, floor):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T >= floor


def groups(seed=1, n=400, dim=32, copies=((40, 0.02), (6, 0.05), (2, 0.1))):
    r = np.random.default_rng(seed)
    parts = [r.normal(size=(n, dim))]
    for many, noise in copies:
        for _ in range(4):
            parts.append(r.normal(size=dim) + noise * r.normal(size=(many, dim)))
    return np.concatenate(parts)


def test_links_and_components_are_those_of_all_pairs(spark):
    v = groups()
    near = brute(v, 0.9)
    np.fill_diagonal(near, False)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {r.vec_id: r for r in e.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    recall = sum(got[i].n_links for i in range(len(v))) / near.sum()
    assert 0.999 <= recall <= 1 and all(got[i].n_links <= near[i].sum() for i in range(len(v)))
    up = list(range(len(v)))
    changed = True
    while changed:
        new = [min([up[i], *(up[j] for j in np.flatnonzero(near[i]))]) for i in range(len(v))]
        changed, up = new != up, new
    assert [got[i].component_id for i in range(len(v))] == up and all(got[i].kept == (up[i] == i) for i in range(len(v)))


def test_every_vector_finds_itself_in_a_graph_with_dense_groups():
    v = groups(2, 3000, 48, ((300, 0.01), (30, 0.02)))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    q, n = e.Graph(v).near(v, 32, 0.9)
    true = (v @ v.T >= 0.9).sum()
    assert len(q) == len(set(zip(q.tolist(), n.tolist(), strict=True))) and len(q) >= 0.999 * true


def test_a_search_visits_few_of_the_nodes():
    """Links come through the graph: a narrow beam looks at a small part of it, and finds most."""
    v = groups(3, 4000, 32, ((40, 0.05), (6, 0.08)))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph, looked = e.Graph(v), []
    graph.v = type("Counted", (np.ndarray,), {"__getitem__": lambda self, k: (looked.append(np.size(k)), np.asarray(self)[k])[1]})((len(v), 32), np.float32, v)
    q, _ = graph.near(v[::20], 32, 0.9)
    assert sum(looked) / len(v[::20]) < len(v) / 4 and len(q) >= 0.99 * (v[::20] @ v.T >= 0.9).sum()


def test_leaders_are_near_those_that_they_lead():
    v = groups(4, 1000, 24, ((200, 0.01), (30, 0.03)))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    lead = e.leaders(v)
    assert ((v * v[lead]).sum(1) >= e.LEADER - 1e-12).all() and (lead[lead] == lead).all() and len(np.unique(lead)) < 1300


def test_recall_and_components_over_searched_shards(spark):
    """5,000 vectors in two shards, questions of a shard in several tasks: recall against all pairs, and no false link."""
    v = groups(5, 4000, 48, ((150, 0.01), (60, 0.04), (30, 0.06), (10, 0.08)))
    near = brute(v, 0.9)
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in e.near_embeddings(df, questions=1500).collect()}
    links = np.array([got[i].n_links for i in range(len(v))])
    assert len(v) == 5000 and (links <= near.sum(1)).all() and links.sum() >= 0.999 * near.sum()


def test_an_audit_widens_a_beam_that_misses():
    v = groups(6, 3000, 16, ((20, 0.3),) * 20)
    shard = e.Shard(np.arange(len(v)), np.ones(len(v)), v, 0.9)
    links = shard.graph.layers[-1][1]
    links[np.random.default_rng(8).random(links.shape) < 0.7] = -1
    assert shard.audited(2, 0.9, 512) > 2

    again = pickle.loads(pickle.dumps(shard))
    for x, y in zip(shard.asked(shard.ids[:50], shard.unit[:50], 32), again.asked(shard.ids[:50], shard.unit[:50], 32), strict=True):
        assert (x == y).all()


def test_lengths_that_overflow_a_square_and_long_vectors(spark):
    long = np.random.default_rng(7).normal(size=4000).tolist()
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, long), (5, [2 * x for x in long])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
        (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (None, None), (10, [0.0, 1.0]), (11, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 5, False) for r in rows], "vec_id long, embedding array<double>, n_links long, kept boolean")
    out = e.near_embeddings(df)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=repr)
    want = [
        (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True),
        (9, 0, 9, True), (None, 3, 1, False), (None, 0, None, True), (10, 0, 10, True), (11, 0, 11, True),
    ]
    assert got == sorted(want, key=repr)
    assert e.near_embeddings(df.limit(0)).count() == 0
    floats = df.select("vec_id", df.embedding.cast("array<float>").alias("embedding"))
    assert e.near_embeddings(floats).where("vec_id = 1").first().n_links == 3


def test_many_equal_vectors_are_one_class(spark):
    df = spark.range(5000).selectExpr("id AS vec_id", "array(1.0D, CAST(id % 2 AS DOUBLE) * 3) AS embedding")
    got = e.near_embeddings(df).groupBy("component_id", "n_links").count().collect()
    assert sorted((r.component_id, r.n_links, r["count"]) for r in got) == [(0, 2499, 2500), (1, 2499, 2500)]
