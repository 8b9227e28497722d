from pyspark.sql import functions as F
from sedimenta.model import OPERATION
from sedimenta.operators import control as C


def view(spark, ops):
    rows = [(i, op, False, a, b, ks, ke) for i, (op, a, b, ks, ke) in enumerate(ops)]
    return [(r.prefix, r.file, r.key_start, r.key_end, r.is_tail) for r in C.view(spark.createDataFrame(rows, OPERATION)).orderBy("prefix", "file_ord").collect()]


def create(a, b):
    return ("LOGCREATE", [a], [b], None, None)


def test_creations_out_of_order(spark):
    got = view(spark, [create("", "log/1"), create("log/2", "log/3"), create("log/1", "log/2")])
    assert got == [("log", "log/1", None, None, False), ("log", "log/2", None, None, False), ("log", "log/3", None, None, True)]


def test_a_chain_and_two_compactions(spark):
    ops = [create("", "log/1")] + [create(f"log/{i}", f"log/{i + 1}") for i in range(1, 5)]
    ops += [("COMPACT", ["log/1", "log/2"], ["level1/1"], ["key0"], ["key9"]), ("COMPACT", ["log/3", "log/4"], ["level1/2"], ["key10"], ["key19"])]
    want = [("level1", "level1/1", "key0", "key9", False), ("level1", "level1/2", "key10", "key19", False), ("log", "log/5", None, None, True)]
    assert view(spark, ops) == want
    assert view(spark, ops[:5] + [ops[6], ops[5]]) == want  # the later merge waits for the earlier
    rows = [(i, op, False, a, b, ks, ke) for i, (op, a, b, ks, ke) in enumerate(ops)]
    assert {r.file for r in C.live_files(spark.createDataFrame(rows, OPERATION)).collect()} == {w[1] for w in want}


def test_chain_end_and_acknowledged(spark):
    n = spark.createDataFrame([(1,), (2,), (3,), (5,)], "n long")
    assert C.chain_end(n, "n").first().tail == 3 and C.chain_end(n.where("n > 1"), "n").first().tail == 0
    assert C.acknowledged(n, "n", 1).first().limit == 3 and C.acknowledged(n, "n", 0).first().limit == -1


def test_claims_and_dead_tasks(spark):
    rows = [("t1", 0, "a", 1, 10, "BEGIN"), ("t1", 0, "b", 2, 11, "BEGIN"), ("t1", 1, "c", 3, 40, "BEGIN"), ("t2", 0, "b", 4, 90, "IN_PROGRESS"), ("t3", 0, "d", 5, 1, "COMPLETE")]
    tasks = spark.createDataFrame(rows, "task string, generation int, owner string, seq long, ts long, status string")
    assert {r.task: (r.generation, r.owner) for r in C.task_owners(tasks, "task", "generation", "owner", "seq").collect()} == {"t1": (1, "c"), "t2": (0, "b"), "t3": (0, "d")}
    dead = C.dead_tasks(tasks, "task", "ts", "status", F.lit(100), F.lit(50))
    assert [r.task for r in dead.collect()] == ["t1"]
    assert [(r.task, r.generation) for r in C.reclaims(tasks, dead, "task", "generation").collect()] == [("t1", 2)]


def test_names(spark):
    df = spark.createDataFrame([("sharedlog/64:128",), ("sstable2/17_ab",), ("datalog/1234",)], "name string")
    got = df.select("name", *[c.alias(n) for n, c in C.name_parts(F.col("name")).items()], C.trailing_number(F.col("name")).alias("number")).collect()
    assert (got[0].start_offset, got[0].end_offset, got[1].level, got[1].version, got[2].number) == (64, 128, 2, 17, 1234)
