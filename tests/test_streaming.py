import datetime as dt

from pyspark.sql import functions as F
from sedimenta.operators.snapshot import snapshot
from sedimenta.sources.entrylog import EntryLog, EntryLogSource
from sedimenta.streaming import live


def test_a_stream_of_files_ends_where_a_batch_does(spark, tmp_path):
    schema = "key string, value string, type int, seq long"
    for i, rows in enumerate([[("a", "1", 1, 0), ("b", "1", 1, 1)], [("a", "2", 1, 2), ("b", None, 0, 3)], [("a", "old", 1, -1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    gone = F.col("type") == 0
    out = live.run_once(live.latest(live.read_log(spark, str(tmp_path / "in"), schema, 1), ["key"], ["seq"], gone), str(tmp_path / "c"), "complete")
    batch = snapshot(spark.read.schema(schema).parquet(str(tmp_path / "in")), ["key"], ["seq"], gone)
    assert sorted(out.collect()) == sorted(batch.collect()) == [("a", 2, "2", 1)]


def test_dead_tasks_are_told_once(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "task string, ts timestamp, status string"
    batches = [[("a", t(0), "BEGIN"), ("b", t(1), "BEGIN"), ("c", t(2), "BEGIN")], [("b", t(50), "IN_PROGRESS"), ("c", t(3), "COMPLETE")], [("b", t(95), "IN_PROGRESS")], [("d", t(96), "BEGIN")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = (
            live.dead_tasks(stream, "task", "ts", "status", 60).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        )
        q.awaitTermination()
        del n
    assert [r.task for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_entry_log_in_batch_and_followed(spark, tmp_path):
    log = EntryLog(str(tmp_path / "entries"))
    assert log.append([(f"key{i}", f"v{i}", 1) for i in range(150)]) == 150
    spark.dataSource.register(EntryLogSource)
    rows = spark.read.format("entrylog").option("path", log.path).option("start", 60).option("end", 70).load()
    assert [r.seq for r in rows.orderBy("seq").collect()] == list(range(60, 70))
    stream = spark.readStream.format("entrylog").option("path", log.path).load()
    out = live.run_once(live.latest(stream, ["key"], ["seq"], F.col("type") == 0), str(tmp_path / "c"), "complete")
    assert out.count() == 150
