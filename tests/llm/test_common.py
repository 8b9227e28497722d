import random

import pyarrow as pa
from pyspark.sql import functions as F
from sedimenta.llm import common


def roots(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_components_of_stars_paths_and_random_graphs(spark):
    r = random.Random(1)
    edges = [(0, i) for i in range(1, 500)]  # a hub
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a path
    edges += [(2000 + r.randrange(300), 2000 + r.randrange(300)) for _ in range(200)] + [(5, 5), (7000, 7000)]
    got = {x.id: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    names = spark.createDataFrame([(b"b", b"a"), (b"c", b"b"), (b"y", b"x")], "a binary, b binary")
    assert {bytes(x.id): bytes(x.root) for x in common.components(names).collect()} == {b"a": b"a", b"b": b"a", b"c": b"a", b"x": b"x", b"y": b"x"}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_are_cut_at_ascii_white_space_only(spark):
    texts = ["a b", " a\tb\n", "", None, "\x0b\x0c\r\n", "a b   c", "x" * 10]
    got = [r.w for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(common.words(F.col("t")).alias("w")).collect()]
    assert got == [["a", "b"], ["a", "b"], [], [], [], ["a b", " ", "c"], ["x" * 10]]


def test_groups_run_over_batches():
    batch = lambda *k: pa.RecordBatch.from_arrays([pa.array(k), pa.array(range(len(k)))], names=["k", "v"])
    got = [(t.column("k")[0].as_py(), len(t)) for t in common.groups(iter([batch(1, 1, 2), batch(2), batch(), batch(2, 3)]), ["k"])]
    assert got == [(1, 2), (2, 3), (3, 1)]


def test_written_tables_lie_in_the_shared_folder(spark):
    df = common.written(spark.range(3))
    assert df.written_path.startswith(common.shared_dir(spark).rstrip("/")) and df.count() == 3
