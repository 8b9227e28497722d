"""Queries of operators that the other modules leave out: logs, filters, files, templates, streams, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import generators as G
from ..functions import scalar as Z
from ..operators import bloom as B
from ..operators import control as C
from ..operators import measure as M
from ..operators import runs as R
from ..operators import timeseries as T
from ..operators.snapshot import snapshot
from ..sources import entrylog, jdbc
from ..sources import log as L
from ..sources import text as X
from ..streaming import live
from . import workloads as W
from .gen_queries import LIVE, U, V, _folder, _once, _stream, _u
from .registry import deleted, log, micros, query, table
from .ts_queries import US, latencies


@query("SELECT CAST(event_id % 2 AS INT) + 1 AS segment, count(*) AS n_records, true AS sealed, true AS refused FROM events GROUP BY 1")
def log_seal(spark: SparkSession, d: str) -> DataFrame:
    """Two appends, a seal, and an append that is refused."""
    rows = log(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), "event_id")
    store, refused = L.RecordLog(spark, _folder(spark)), False
    for i in (0, 1):
        store.append(rows.where(F.col("event_id") % 2 == i), ["event_id"])
    store.seal()
    try:
        store.put(rows)
    except L.SealedError:
        refused = True
    return store.sizes().select("segment", "n_records", F.lit(store.is_sealed()).alias("sealed"), F.lit(refused).alias("refused"))


@query("SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, props AS value, CAST(event_type <> 'error' AS INT) AS type FROM events WHERE event_id >= 100 AND event_id < 400")
def entry_log_read(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 events appended, in three appends, to a numbered entry log; a range of it by the data source."""
    path = _folder(spark).removeprefix("file://")
    rows = log(spark, d).join(table(spark, d, "events").select("event_id", "props"), "event_id").where("event_id < 500").orderBy("event_id").collect()
    entries, file = [(str(r.user_id), r.props, int(r.event_type != "error")) for r in rows], entrylog.EntryLog(path)
    tails = [file.append(entries[a:b]) for a, b in ((0, 1), (1, 150), (150, 500))]
    if tails != [1, 150, 500]:
        raise RuntimeError(f"tails {tails}")
    spark.dataSource.register(entrylog.EntryLogSource)
    return spark.read.format("entrylog").options(path=path, start=100, end=400).load()


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey")


@query("SELECT 'member' AS kind, count(*) AS n, true AS as_it_should FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'other', count(*), true FROM customer WHERE c_custkey % 3 <> 0")
def bloom_may_hold(spark: SparkSession, d: str) -> DataFrame:
    """All members pass the filter, and of the others less than a twentieth."""
    got = B.may_hold(table(spark, d, "customer").select(F.col("c_custkey").alias("probe")), "probe", _members(spark, d), "c_custkey")
    kind = F.when(F.col("probe") % 3 == 0, "member").otherwise("other")
    sums = got.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("may_hold").cast("int")).alias("passed"))
    good = F.when(F.col("kind") == "member", F.col("passed") == F.col("n")).otherwise(F.col("passed") * 20 < F.col("n"))
    return sums.select("kind", "n", good.alias("as_it_should"))


@query("SELECT event_id // 100 AS run, (event_id % 100 * 300) >> 11 AS slot, count(*) AS n FROM events GROUP BY 1, 2")
def filter_slots(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 300 bytes of a run by the filter that covers them."""
    e = F.col("event_id")
    return log(spark, d).groupBy(R.entry_segment(e, 100).alias("run"), B.slot_of(e % 100 * 300).alias("slot")).agg(F.count("*").alias("n"))


@query("""SELECT 'read' AS statement, c_custkey, c_name FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'scan', * FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 30 ORDER BY c_custkey LIMIT 12)""")
def sql_templates(spark: SparkSession, d: str) -> DataFrame:
    """The statements that relational stores are sent, run by Spark."""
    table(spark, d, "customer").select("c_custkey", "c_name").createOrReplaceTempView("sedimenta_rows")
    one = spark.sql(jdbc.read("sedimenta_rows", key="c_custkey"), args=[7])
    some = spark.sql(jdbc.scan("sedimenta_rows", key="c_custkey"), args=[30, 12])
    return one.withColumn("statement", F.lit("read")).unionByName(some.withColumn("statement", F.lit("scan")))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def stream_follow(spark: SparkSession, d: str) -> DataFrame:
    """Records of wanted keys as a stream brings them."""
    wanted = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("user_id"))
    return _once(spark, live.follow(_stream(spark, d), wanted, "user_id").select("event_id", "user_id", "event_type"), "append")


@query(LIVE)
def stream_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A view that is refreshed every 100 ms: each batch's changed keys replace those of the batches before."""
    folder = _folder(spark)
    rows = live.latest(_stream(spark, d).select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"], F.lit(False))
    q = live.persist(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/view/batch={number}"), f"{folder}/checkpoint")
    q.processAllAvailable()
    q.stop()
    return snapshot(spark.read.schema(rows.schema).parquet(f"{folder}/view").select(*rows.columns), ["user_id"], ["event_id"], deleted())


#: The second batch has the later half of the small tables' events, and some of all times; the watermark after the first.
_TIMES = "(SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events WHERE NOT (event_id >= 5000 OR event_id % 50 = 0))"


@query(f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS bucket, event_id >= 5000 OR event_id % 50 = 0 AS second FROM events)
SELECT event_type, bucket, count(*) AS n FROM w WHERE NOT second OR bucket + INTERVAL 1 DAY > (SELECT mark FROM {_TIMES}) GROUP BY 1, 2""")
def stream_late_points(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two batches; points of the second one whose window had passed the watermark are dropped."""
    folder, events = _folder(spark), table(spark, d, "events").select("event_id", "event_type", "ts")
    second = (F.col("event_id") >= 5000) | (F.col("event_id") % 50 == 0)
    out = f"{folder}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    for part in (~second, second):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        windows = live.downsampled(rows, ["event_type"], "ts", "1 day", "1 hour", [F.count("*").alias("n")])
        q = windows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(out)
    return got.groupBy("event_type", "bucket").agg(F.max_by("n", "batch").alias("n"))


@query("""WITH c AS (SELECT c_custkey, c_name AS a, lead(c_name) OVER (ORDER BY c_custkey) AS b FROM customer),
i AS (SELECT *, list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])[1] AS i FROM c WHERE b IS NOT NULL)
SELECT c_custkey, CASE WHEN ascii(a[i]) + 1 < ascii(b[i]) THEN left(a, i - 1) || chr(ascii(a[i]) + 1) ELSE a END AS separator, chr(ascii(a[1]) + 1) AS successor FROM i""")
def index_keys(spark: SparkSession, d: str) -> DataFrame:
    """Short keys for an index between neighbours."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    after = rows.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("_b"))
    a, b = F.col("c_name").cast("binary"), F.col("_b").cast("binary")
    return rows.join(after, "c_custkey").select("c_custkey", Z.separator(a, b).cast("string").alias("separator"), Z.successor(a).cast("string").alias("successor"))


@query("""WITH e AS (SELECT event_id // 50 AS log, event_id % 50 AS i, count(*) OVER (PARTITION BY event_id // 50) AS n FROM events)
SELECT log, 'sharedlog' AS prefix, i - 2 AS file_ord, 'sharedlog/' || i AS file, NULL::VARCHAR AS key_start, i = n - 1 AS is_tail FROM e WHERE i >= 2
UNION ALL SELECT DISTINCT log, 'sstable1', 0, 'sstable1/1', 'a' || log, false FROM e WHERE n > 2""")
def metadata_fold(spark: SparkSession, d: str) -> DataFrame:
    """Operation logs whose records come out of order, but for the first: segments chained, and the two oldest merged."""
    e = F.col("event_id")
    name = lambda x: F.concat(F.lit("sharedlog/"), x.cast("string"))
    ops = log(spark, d).select(F.floor(e / 50).cast("long").alias("log"), (e % 50).alias("i"), F.when(e % 50 == 0, -1).otherwise(e * 7919 % 10007).alias("seq"))
    none = F.lit(None).cast("array<string>")
    made = ops.select("log", "seq", F.lit("LOGCREATE").alias("op"), F.lit(False).alias("in_last_level"), F.array(F.when(F.col("i") == 0, "").otherwise(name(F.col("i") - 1))).alias("inputs"), F.array(name(F.col("i"))).alias("outputs"), none.alias("key_start"), none.alias("key_end"))
    ends = F.array(F.concat(F.lit("a"), F.col("log").cast("string")))
    merged = ops.where("i = 2").select("log", (F.col("seq") % 977).alias("seq"), F.lit("COMPACT").alias("op"), F.lit(False).alias("in_last_level"), F.array(F.lit("sharedlog/0"), F.lit("sharedlog/1")).alias("inputs"), F.array(F.lit("sstable1/1")).alias("outputs"), ends.alias("key_start"), ends.alias("key_end"))
    return C.view(made.unionByName(merged), by="log").drop("key_end")


@query("""SELECT c_custkey, CAST(1704067200 + c_custkey * 60 AS BIGINT) AS ts FROM customer""")
def gen_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Times in a random order: each once."""
    n = table(spark, d, "customer").count()
    rows = G.shuffled_epochs(spark, n, 1704067200, 60, 3)
    return rows.orderBy("place").select(((F.col("ts") - 1704067200) / 60).cast("long").alias("c_custkey"), "ts")


@query(f"""WITH z AS (SELECT sum(1 / pow(range + 1, 0.99)) AS z FROM range(999)), e AS (SELECT z, (1 - pow(2.0 / 999, 0.01)) / (1 - (1 + pow(0.5, 0.99)) / z) AS eta FROM z)
SELECT c_custkey, 999 - CAST(CASE WHEN {U} * z < 1 THEN 0 WHEN {U} * z < 1 + pow(0.5, 0.99) THEN 1 ELSE floor(999 * pow(eta * {U} - eta + 1, 1 / (1 - 0.99))) END AS BIGINT) AS item FROM customer, e""")
def gen_latest(spark: SparkSession, d: str) -> DataFrame:
    return _u(spark, d).select("c_custkey", G.latest(F.col("u"), 999).cast("long").alias("item"))


@query(f"""WITH z AS (SELECT sum(1 / pow(range + 1, 0.99)) AS z FROM range(91)), e AS (SELECT z, (1 - pow(2.0 / 91, 0.01)) / (1 - (1 + pow(0.5, 0.99)) / z) AS eta FROM z)
SELECT c_custkey, 100 AS constant, CAST(10 + floor({U} * 91) AS BIGINT) AS uniform, 10 + CAST(CASE WHEN {U} * z < 1 THEN 0 WHEN {U} * z < 1 + pow(0.5, 0.99) THEN 1 ELSE floor(91 * pow(eta * {U} - eta + 1, 1 / (1 - 0.99))) END AS BIGINT) AS zipfian,
  CAST(CASE WHEN {U} < 0.25 THEN 1 WHEN {U} < 0.75 THEN 2 ELSE 3 END AS BIGINT) AS histogram FROM customer, e""")
def gen_field_lengths(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("u")
    kinds = {k: G.field_length(k, u, 100, 10, [1, 2, 1]).cast("long").alias(k) for k in ("uniform", "zipfian", "histogram")}
    return _u(spark, d).select("c_custkey", G.field_length("constant", u, 100).alias("constant"), *kinds.values())


@query(f"SELECT c_custkey, CAST(CASE WHEN {V} < 0.2 THEN 50 WHEN {V} < 0.5 THEN 100 ELSE 200 END AS BIGINT) AS length FROM customer")
def histogram_file(spark: SparkSession, d: str) -> DataFrame:
    """Lengths by a histogram that a file holds: places 0, 1 and 3 of blocks of 50."""
    path = f"{_folder(spark)}.hist"
    L.put_text(spark, path, "BlockSize\t50\n0\t2\n1\t3\n3\t5\n")
    block, counts = X.read_histogram(spark, path)
    return _u(spark, d).select("c_custkey", G.from_histogram(F.col("v"), counts, block).cast("long").alias("length"))


@query("""SELECT '[' || event_type || '], Operations, ' || count(*) AS value, '[' || string_agg(DISTINCT '{"op":"' || event_type || '","metric":"Operations","value":', '') || count(*) || '}]' AS json FROM events GROUP BY event_type""")
def export_lines(spark: SparkSession, d: str) -> DataFrame:
    """Measurements as lines of text and as JSON arrays, written and read again."""
    measured = table(spark, d, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("value")).select("op", F.lit("Operations").alias("metric"), "value")
    folder = _folder(spark)
    for kind in ("text", "jsonarray"):
        X.export(measured, f"{folder}/{kind}", kind)
    lines, arrays = (spark.read.text(f"{folder}/{kind}") for kind in ("text", "jsonarray"))
    op = F.regexp_extract("value", r"\[(\w+)\]", 1)
    arrays = arrays.select(F.get_json_object("value", "$[0].op").alias("op"), F.col("value").alias("json"))
    return lines.withColumn("op", op).join(arrays, "op").drop("op")


@query(f"""SELECT op, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 4) AS average, round(stddev_pop(v), 2) AS deviation FROM (SELECT event_type AS op, CAST({US} AS DOUBLE) AS v FROM events) GROUP BY op""")
def lat_hist_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of a histogram merged from four parts."""
    rows = latencies(spark, d).withColumn("part", F.col("user_id") % 4)
    merged = M.merge_statistics(M.log_statistics(rows, ["op", "part"], "latency_us"), ["op"])
    return merged.select("op", "n", "least", "most", F.round("average", 4).alias("average"), F.round("deviation", 2).alias("deviation"))


@query(f"""WITH c AS (SELECT op, bucket, count(*) AS n FROM (SELECT event_type AS op, CASE WHEN v < 10 THEN v ELSE 9 + 16 * (length(v::VARCHAR) - 2) + len(list_filter([10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90], lambda s: s * pow(10, length(v::VARCHAR) - 2) <= v)) END AS bucket
  FROM (SELECT event_type, {US} AS v FROM events)) GROUP BY 1, 2)
SELECT op, CAST(bucket AS INT) AS bucket, n, round(n * 100.0 / sum(n) OVER (PARTITION BY op), 6) AS percent, round(sum(n) OVER (PARTITION BY op ORDER BY bucket) * 100.0 / sum(n) OVER (PARTITION BY op), 6) AS cumulative FROM c""")
def lat_hist_report(spark: SparkSession, d: str) -> DataFrame:
    rows = M.log_report(M.log_histogram(latencies(spark, d), ["op"], "latency_us"), ["op"])
    return rows.select("op", "bucket", "n", F.round("percent", 6).alias("percent"), F.round("cumulative", 6).alias("cumulative"))


@query(f"""WITH e AS (SELECT event_type AS op, user_id, epoch_us(ts) AS started, epoch_us(ts) + {US} AS ended, min(epoch_us(ts)) OVER w + (row_number() OVER w - 1) * 3600000000 AS intended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT op, count(*) AS n, CAST(sum(latency) AS BIGINT) AS total, max(latency) AS most FROM (SELECT op, ended - started AS latency FROM e UNION ALL SELECT 'Intended-' || op, ended - intended FROM e) GROUP BY op""")
def lat_intended(spark: SparkSession, d: str) -> DataFrame:
    """Latencies from the start and, for a thread that should do one operation an hour, from the schedule."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = micros(table(spark, d, "events")).withColumn("latency_us", F.round(F.col("value") * 1000).cast("long"))
    intended = M.scheduled(F.row_number().over(w) - 1, F.min("us").over(w), 3_600_000_000)
    rows = rows.select(F.col("event_type").alias("op"), F.col("us").alias("started"), (F.col("us") + F.col("latency_us")).alias("ended"), intended.alias("intended"))
    return M.with_intended(rows, "op", "started", "ended", "intended").groupBy("op").agg(F.count("*").alias("n"), F.sum("latency").alias("total"), F.max("latency").alias("most"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS value_long, CASE WHEN event_id % 3 = 1 THEN value WHEN event_id % 3 = 2 THEN 'NaN'::DOUBLE END AS value_double FROM events""")
def ts_insert_typed(spark: SparkSession, d: str) -> DataFrame:
    """Points whose values come as text, as whole or floating numbers."""
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.col("user_id").cast("string")).when(e % 3 == 1, F.col("value").cast("string")).otherwise("NaN")
    return T.typed(table(spark, d, "events").select("event_id", text.alias("v")), "v")


@query(f"""SELECT c_custkey, CAST(1704067200 + c_custkey * 60 AS BIGINT) AS start, CAST(1704067200 + c_custkey * 60 + 60 * floor({U} * 60) AS BIGINT) AS "end" FROM customer""")
def ts_random_span(spark: SparkSession, d: str) -> DataFrame:
    """Time ranges of random length below an hour, in minutes."""
    start = (F.lit(1704067200) + F.col("c_custkey") * 60).cast("long")
    return _u(spark, d).select("c_custkey", start.alias("start"), T.random_span(start, F.col("u"), 3600, 60).alias("end"))


@query("""SELECT CASE WHEN c_custkey % 13 = 0 THEN 'UNEXPECTED_STATE' WHEN c_custkey % 17 = 0 THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS n FROM customer GROUP BY 1""")
def workload_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Rows read back and verified: some have a field changed, some have no fields."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, Z.key_name(k, ordered=True).alias("key"))
    made = rows.select("c_custkey", "key", *[Z.field_value("key", F.lit(f), F.lit(100)).alias(f) for f in ("field0", "field1")])
    field1 = F.when(k % 13 == 0, F.concat(F.substring("field1", 1, 99), F.lit("!"))).otherwise(F.col("field1"))
    fields = F.create_map(F.lit("field0"), F.col("field0"), F.lit("field1"), field1)
    empty = F.create_map().cast("map<string,string>")
    return W.verify_rows(made.select("key", F.when((k % 17 == 0) & (k % 13 != 0), empty).otherwise(fields).alias("fields")), 100).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT c_custkey, list_filter(range(0, 3), lambda i: CAST('0x' || substr(md5(c_custkey || ':' || i), 1, 13) AS BIGINT) / 4503599627370496.0 >= 0.4)[1] AS ok FROM customer)
SELECT c_custkey, CAST(coalesce(ok + 1, 3) AS INT) AS attempts, CASE WHEN ok IS NULL THEN 'ERROR' ELSE 'OK' END AS status FROM t""")
def insert_retries(spark: SparkSession, d: str) -> DataFrame:
    """Inserts that fail with chance 0.4 and are tried again twice at most."""
    fails = lambda i: G.unit(F.concat_ws(":", F.col("c_custkey").cast("string"), F.lit(str(i)))) < 0.4
    return W.retried(table(spark, d, "customer").select("c_custkey"), fails, 2)


@query("SELECT c_custkey AS YCSB_KEY, c_name AS FIELD0, CAST(c_nationkey AS VARCHAR) AS FIELD1, CAST(abs(h) % 2 AS INT) AS shard FROM (SELECT *, CASE WHEN h0 >= 2147483648 THEN h0 - 4294967296 ELSE h0 END AS h FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_custkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h0 FROM customer))")
def jdbc_shards(spark: SparkSession, d: str) -> DataFrame:
    """Rows to two databases by the hash of their key, and read again from both."""
    run = uuid.uuid4().hex
    urls = [f"jdbc:derby:memory:{run}{i};create=true" for i in range(2)]
    properties = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "createTableColumnTypes": "YCSB_KEY VARCHAR(64)"}
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("YCSB_KEY"), F.col("c_name").alias("FIELD0"), F.col("c_nationkey").cast("string").alias("FIELD1"))
    jdbc.save(rows, urls, "usertable", properties)
    folder = _folder(spark)
    parts = [jdbc.load(spark, [u], "usertable", {"driver": properties["driver"]}, folder=folder).withColumn("shard", F.lit(i)) for i, u in enumerate(urls)]
    for u in urls:
        if jdbc.driver_only(spark, u):  # its rows are in the folder
            jdbc.drop_memory(spark, u)
    out = parts[0].unionByName(parts[1])
    return out.select(F.col("YCSB_KEY").cast("long").alias("YCSB_KEY"), "FIELD0", "FIELD1", "shard")


@query("""SELECT event_id, CASE WHEN w = '' THEN s || CASE WHEN length(s::VARCHAR) = 1 THEN ' second ' ELSE ' seconds ' END ELSE w END AS duration FROM (SELECT event_id, s,
  CASE WHEN s >= 172800 THEN s // 86400 || ' days ' WHEN s >= 86400 THEN '1 day ' ELSE '' END || CASE WHEN s % 86400 >= 7200 THEN s % 86400 // 3600 || ' hours ' WHEN s % 86400 >= 3600 THEN '1 hour ' ELSE '' END
  || CASE WHEN s >= 86400 OR s % 3600 < 60 THEN '' WHEN s % 3600 < 120 THEN '1 minute ' ELSE s % 3600 // 60 || ' minutes ' END AS w FROM (SELECT event_id, event_id * 37 % 400000 AS s FROM events))""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """Seconds up to four days and more in words."""
    return table(spark, d, "events").select("event_id", Z.duration(F.col("event_id") * 37 % 400000).alias("duration"))


_TRACES = {"READ": ("customer", "c_custkey", "c_name", 0.99), "INSERT": ("supplier", "s_suppkey", "s_name", 0.9), "DELETE": ("nation", "n_nationkey", "n_name", 0.99), "UPDATE": ("part", "p_partkey", "p_name", 0.8)}
_A = lambda i: f"(CAST('0x' || substr(md5('1:{i}:' || op_id), 1, 13) AS BIGINT) / 4503599627370496.0)"


@query(f"""WITH t AS ({" UNION ALL ".join(f"SELECT '{k}' AS op, {theta} AS theta, row_number() OVER (ORDER BY {i}) - 1 AS place, '/{t}/' || {i} || '/' || {name} AS address FROM {t}" for k, (t, i, name, theta) in _TRACES.items())}),
z AS (SELECT op, theta, count(*)::DOUBLE AS n, sum(1 / pow(place + 1, theta)) AS z FROM t GROUP BY ALL),
e AS (SELECT *, (1 - pow(2 / n, 1 - theta)) / (1 - (1 + pow(0.5, theta)) / z) AS eta FROM z),
o AS (SELECT range AS op_id, {_A(1)} AS u, {_A(3)} AS v, CASE WHEN {_A(0)} < 0.5 THEN 'READ' WHEN {_A(0)} < 0.7 THEN 'UPDATE' WHEN {_A(0)} < 0.9 THEN 'INSERT' ELSE 'DELETE' END AS op FROM (SELECT range, range AS op_id FROM range(3000))),
p AS (SELECT op_id, op, CASE WHEN op IN ('INSERT', 'UPDATE') THEN CAST(1 + floor(v * 100) AS BIGINT) END AS length, CAST(CASE WHEN u * z < 1 THEN 0 WHEN u * z < 1 + pow(0.5, theta) THEN 1 ELSE floor(n * pow(eta * u - eta + 1, 1 / (1 - theta))) END AS BIGINT) AS place FROM o JOIN e USING (op))
SELECT op_id, op, address, length FROM p LEFT JOIN t USING (op, place)""")
def workload_trace(spark: SparkSession, d: str) -> DataFrame:
    """Operations on the addresses of four trace files, each with its own skew."""
    folder = _folder(spark)
    for op, (name, number, title, _) in _TRACES.items():
        line = F.concat_ws("/", F.lit(f" /{name}"), F.col(number).cast("string"), title)
        table(spark, d, name).orderBy(number).select(line).write.text(f"{folder}/{op}")
    mix = {"READ": 5.0, "UPDATE": 2.0, "INSERT": 2.0, "DELETE": 1.0}
    w = W.Trace({op: f"{folder}/{op}" for op in _TRACES}, 3000, mix, theta={op: t[3] for op, t in _TRACES.items()}, lengths="uniform")
    return W.traced(spark, w)
