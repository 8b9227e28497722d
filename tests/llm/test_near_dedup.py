import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sedimenta.llm import near_dedup as nd
from sedimenta.llm.textvec import buffers, word_hashes

from .helpers import odd_documents, rows_of, table


def weights(texts, strength=0.1, floor=2):
    """Weighted shingles of each text by the definition, with the true document frequencies."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        sets.append(Counter(grams))
    df = Counter(g for s in sets for g in s)
    n = sum(map(bool, sets))
    idf = lambda g: 1 + strength * np.log(n / max(df[g], floor)) / np.log(n / floor)
    return [{g: (1 + np.log(tf)) * idf(g) for g, tf in s.items()} for s in sets]


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1e-9, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)) if a and b else 0.0


def corpus(n=60, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(r.randint(60, 200))]
        texts.append(" ".join(base))
        for share in (0.0, 0.01, 0.03, 0.3):
            copy = [word() if r.random() < share else w for w in base]
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("strength", [0.1, 1.0])
def test_classes_are_those_of_all_pairs(spark, strength):
    texts = corpus()
    sets, up = weights(texts, strength), list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                up[root(i)] = root(j)
    docs = table(spark, [(i, t, "s", "en", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs, strength=strength).collect()}
    assert len({root(i) for i in range(len(texts))}) < 0.6 * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (root(i) == root(j)) == (got[i] == got[j]), (i, j)


@pytest.mark.parametrize("most", [1 << 20, 2000])
def test_idf_has_true_document_frequencies(spark, monkeypatch, most):
    texts = [*corpus(30), "", None, "two words"] + ["a b c d e f g h"] * 40
    monkeypatch.setattr(nd, "CELL_BITS", 17)
    docs = table(spark, [(i, t, "s", "en", 0) for i, t in enumerate(texts)]).repartition(5)
    got = nd.idf(docs, 0.5, most)
    pairs = sum(len(s) for s in weights(texts))
    assert got.texts == len(texts) - 2 and got.floor == max(2, -(-pairs // most)) and len(got.hashes) <= most
    want = weights(texts, 0.5, got.floor)
    data, off = buffers(pa.array(texts))
    hashes, w, ends = nd.weighted(data, off, got)
    for i, (x, y) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        assert sorted(w[x:y]) == pytest.approx(sorted(want[i].values()))


def test_defined_results_for_odd_rows(spark):
    got = {}
    out = nd.near_duplicates(odd_documents(spark))
    assert out.columns == ["doc_id", "class_id", "class_size", "kept"]
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.class_size, r.kept))
    assert got[1] == [(1, 4, True)] * 2 and got[2] == [(1, 4, False)] and got[10] == [(1, 4, False)]
    assert got[3] == [(3, 1, True)] and got[4] == [(4, 1, True)] and got[5] == [(5, 1, True)] and got[9] == [(9, 1, True)]
    assert got[11] == [(11, 2, True)] and got[12] == [(11, 2, False)]
    assert sorted(got[None]) == [(None, 1, True), (None, 1, True)]
    assert nd.near_duplicates(odd_documents(spark).limit(0)).count() == 0


def test_one_of_each_class_stays_whole(spark):
    docs = odd_documents(spark)
    left = nd.one_of_each(docs)
    assert left.columns == docs.columns
    assert rows_of(left, "doc_id") == sorted([(1,), (3,), (4,), (5,), (6,), (7,), (8,), (9,), (11,), (None,), (None,)], key=repr)


def test_a_large_group_of_near_copies_is_one_class(spark):
    """More copies than one task compares: they meet in blocks."""
    r = random.Random(5)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(3 * nd.MEMBERS):
        copy = list(base)
        copy[r.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(copy), "s", "en", 0))
    got = nd.near_duplicates(table(spark, rows))
    assert got.select("class_id").distinct().count() == 1 and got.where("kept").count() == 1


def test_samples_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(6)
    h = r.integers(0, 2**63, 400).astype(np.uint64)
    w = r.uniform(0.5, 3, 400)
    a, b = np.sort(h[:320]), np.sort(h[80:])
    of = dict(zip(h.tolist(), w.tolist(), strict=True))
    wa, wb = (np.array([of[x] for x in s.tolist()]) for s in (a, b))
    same = (nd.icws(a, wa, 2048) == nd.icws(b, wb, 2048)).mean()
    assert abs(same - nd.weighted_jaccard(a, wa, b, wb)) < 0.04


def test_word_hashes_tell_words_apart():
    texts = ["the cat", None, "", "cat the", " the\n\ncat ", "THE cat", "thecat", " x"]
    h, counts = word_hashes(*buffers(pa.array(texts)))
    assert counts.tolist() == [2, 0, 0, 2, 2, 2, 1, 1]
    assert h[0] == h[3] == h[4] == h[6] and h[1] == h[2] == h[5] == h[7] and len(set(h.tolist())) == 4


def planted(spark, rows, monkeypatch, **limits):
    """Roots of links() for texts (fp, bucket, words), with limits of blocks as given."""
    for name, value in limits.items():
        monkeypatch.setattr(nd, name, value)
    texts = nd.written(spark.createDataFrame([(fp, " ".join(w)) for fp, _, w in rows], "fp binary, text string"))
    members = nd.written(spark.createDataFrame([(b, fp) for fp, b, _ in rows], "bucket long, fp binary"))
    none = nd.Idf(0, 2, 0.1, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1 << nd.CELL_BITS, bool))
    roots = {bytes(r.fp): bytes(r.root) for r in nd.links(members, texts, spark.sparkContext.broadcast(none), 0.8).collect()}
    return {fp: roots.get(fp, fp) for fp, _, _ in rows}


def words_of(r, n=120):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def test_pairs_of_a_large_bucket_meet_across_blocks(spark, monkeypatch):
    r, rows = random.Random(7), []
    for i in range(12):
        base = words_of(r)
        rows += [(b"%04d a" % i, 1, base), (b"%04d b" % i, 1, base[:-1] + ["other"])]
    rows += [(b"%04d x" % i, 1, words_of(r)) for i in range(200)]
    got = planted(spark, rows, monkeypatch, MEMBERS=8)
    assert all(got[b"%04d b" % i] == b"%04d a" % i for i in range(12))
    assert len(set(got.values())) == 212


def test_texts_longer_than_a_block_meet(spark, monkeypatch):
    r, rows = random.Random(8), []
    for i in range(12):
        base = words_of(r)
        rows += [(b"%04d a" % i, i, base), (b"%04d b" % i, i, base[:-1] + ["other"])]
    got = planted(spark, rows, monkeypatch, BYTES=500)
    assert all(got[b"%04d b" % i] == b"%04d a" % i for i in range(12))


def test_links_of_other_texts_than_the_least_are_kept(spark, monkeypatch):
    """b is similar to a, but not to the least text of a's component."""
    r, rows = random.Random(9), []
    for i in range(20):
        base = words_of(r)
        head, last = ["h"] * 8 + base[8:], base[:-8] + ["l"] * 8
        rows += [(b"%04d 0" % i, 1, head), (b"%04d a" % i, 1, base), (b"%04d b" % i, 1, last)]
    rows += [(b"%04d x" % i, 1, words_of(r)) for i in range(100)]
    got = planted(spark, rows, monkeypatch, MEMBERS=32)
    for i in range(20):
        assert got[b"%04d a" % i] == got[b"%04d b" % i] == b"%04d 0" % i
    assert len(set(got.values())) == 120
