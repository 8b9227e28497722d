import math
from collections import Counter

import numpy as np
import pytest
from sedimenta.llm import lm_scoring as lm

from .helpers import odd_documents, table


def brute(texts, least=2, backoff=0.4):
    docs = [(t or "").lower().split() for t in texts]
    c = [Counter(), Counter(), Counter()]
    for w in docs:
        for n in range(3):
            c[n].update(tuple(w[i : i + n + 1]) for i in range(len(w) - n))
    total, out = sum(c[0].values()), []
    for w in docs:
        s = 0.0
        for i in range(len(w)):
            if i > 1 and c[2][tuple(w[i - 2 : i + 1])] >= least:
                s += math.log(c[2][tuple(w[i - 2 : i + 1])] / c[1][tuple(w[i - 2 : i])])
            elif i > 0 and c[1][tuple(w[i - 1 : i + 1])] >= least:
                s += math.log(c[1][tuple(w[i - 1 : i + 1])] / c[0][(w[i - 1],)]) + (math.log(backoff) if i > 1 else 0)
            else:
                s += math.log(c[0][(w[i],)] / total) + min(i, 2) * math.log(backoff)
        out.append(s)
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_scores_are_those_of_the_definition_over_many_chunks_and_partitions(spark, least):
    texts = ["the cat sat on the mat", "The cat sat on the hat", "a dog", "", None, "the cat", "x", "on the mat the cat sat on the mat"] * 3 + ["rare words here"]
    docs = table(spark, [(i, t, "s", "en", 0) for i, t in enumerate(texts)]).repartition(3)
    assert len({r.chunk for r in docs.select("doc_id", "text").mapInArrow(lm._chunks(30), "chunk long, doc_ids array<long>, counts array<long>, vocabulary binary, sequence binary").collect()}) > 5
    got = {r.doc_id: r.log_score for r in lm.stupid_backoff(docs, least, chunk_bytes=30, part_grams=10).collect()}
    want = brute(texts, least)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(len(texts)))


def test_a_document_longer_than_a_chunk(spark):
    texts = [" ".join(f"w{i * i % 97}" for i in range(5000)), "w1 w4 w9", "w1 w4 w9 w16"]
    got = {r.doc_id: r.log_score for r in lm.stupid_backoff(table(spark, [(i, t, "s", "en", 0) for i, t in enumerate(texts)]), chunk_bytes=100).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(brute(texts), abs=1e-6)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = lm.stupid_backoff(docs)
    assert got.columns == ["doc_id", "n_words", "n_order3", "n_order2", "log_score"] and got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1] and by[6][0].n_words == 30_000 and by[3][0].log_score == 0 and by[3][0].n_words == 0
    assert lm.stupid_backoff(docs.limit(0)).count() == 0


def test_packing_of_numbers_is_exact():
    r = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([0]), np.array([2**63]), r.integers(0, 2**63, 1000), r.integers(0, 3, 5000)):
        assert (lm._unpacked(lm._packed(x.astype(np.uint64))) == x.astype(np.uint64)).all()
