"""Queries over the change log and the row table: reads, scans, writes, runs and control logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import decode_entry, decode_messages, decode_row, encode_entry, encode_message, encode_row
from ..operators import control as C
from ..operators import runs as R
from ..operators import scan as S
from ..operators import snapshot as N
from .registry import deleted, log, query, table

KEY, SEQ = ["user_id"], ["event_id"]
LAST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events"


@query(f"SELECT user_id, event_id, ts, event_type, value FROM ({LAST}) WHERE rn = 1 AND event_type <> 'error'")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return N.snapshot(log(spark, d), KEY, SEQ, deleted())


@query(f"SELECT user_id, event_id, ts, event_type, value FROM ({LAST}) WHERE rn = 1 AND event_type <> 'error' AND user_id = 7")
def kv_point_get(spark: SparkSession, d: str) -> DataFrame:
    return N.get(log(spark, d), "user_id", SEQ, deleted(), 7)


@query(f"""SELECT c_custkey, CASE WHEN e.user_id IS NULL THEN 'NOT_FOUND' WHEN event_type = 'error' THEN 'DELETED' ELSE 'OK' END AS status,
  CASE WHEN event_type <> 'error' THEN value END AS value
FROM customer LEFT JOIN (SELECT * FROM ({LAST}) WHERE rn = 1) e ON e.user_id = c_custkey""")
def kv_multi_get_status(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "customer").select("c_custkey")
    return N.multi_get(probes, "c_custkey", log(spark, d), "user_id", SEQ, deleted(), ["value"])


@query(f"SELECT user_id, event_id, ts, event_type, value FROM ({LAST}) WHERE rn = 1 AND event_type = 'error'")
def kv_deleted_keys(spark: SparkSession, d: str) -> DataFrame:
    return N.deleted_keys(log(spark, d), KEY, SEQ, deleted())


@query("""SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00')
WHERE rn = 1 AND event_type <> 'error'""")
def kv_as_of(spark: SparkSession, d: str) -> DataFrame:
    return N.as_of(log(spark, d), KEY, SEQ, deleted(), F.col("ts") <= F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'"))


@query("""SELECT p.event_id, p.user_id, max(e.ts) AS visible_ts, arg_max(e.event_type, e.ts) AS visible_event_type
FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts <= p.ts - INTERVAL 6 HOUR GROUP BY 1, 2""")
def kv_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    probes = log(spark, d).select("event_id", "user_id", F.expr("ts - INTERVAL '6' HOUR").alias("at"))
    return N.as_of_join(probes, "user_id", "at", log(spark, d), "user_id", "ts", ["event_type"]).drop("at")


@query("""SELECT user_id, event_id, ts, event_type, value, row_number() OVER w AS version, lag(value) OVER w AS previous, lead(event_id) OVER w IS NULL AS is_last
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def kv_version_history(spark: SparkSession, d: str) -> DataFrame:
    return N.history(log(spark, d), KEY, SEQ, "value")


FIELDS = ["click", "purchase", "signup", "view"]


@query(f"SELECT user_id, {', '.join(f"arg_max(value, event_id) FILTER (event_type = '{f}') AS {f}" for f in FIELDS)} FROM events GROUP BY user_id")
def kv_rmw_merge(spark: SparkSession, d: str) -> DataFrame:
    return N.merge_wide(log(spark, d), KEY, "event_id", "event_type", "value", FIELDS)


@query("""WITH r AS (SELECT user_id, max(event_id) AS reset FROM events WHERE event_type = 'error' GROUP BY 1),
w AS (SELECT e.user_id, e.event_type, arg_max(value, event_id) AS v FROM events e LEFT JOIN r USING (user_id)
      WHERE event_type <> 'error' AND (reset IS NULL OR event_id >= reset) GROUP BY 1, 2)
SELECT user_id, count(*) AS n_fields, round(sum(v), 4) AS total, min(event_type) AS first_field FROM w GROUP BY 1""")
def kv_rmw_reset(spark: SparkSession, d: str) -> DataFrame:
    writes = log(spark, d).where(~deleted())
    resets = log(spark, d).where(deleted()).select("user_id", "event_id", F.lit(True).alias("deleted"))
    merged = N.merge_fields(writes, KEY, "event_id", "event_type", "value", resets)
    total = F.aggregate(F.map_values("fields"), F.lit(0.0), lambda a, x: a + x)
    return merged.select("user_id", F.size("fields").cast("long").alias("n_fields"), F.round(total, 4).alias("total"), F.array_min(F.map_keys("fields")).alias("first_field"))


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM ({LAST}) WHERE rn = 1 AND event_type <> 'error')")
def kv_insert_conflicts(spark: SparkSession, d: str) -> DataFrame:
    state = N.snapshot(log(spark, d), KEY, SEQ, deleted()).select(F.col("user_id").alias("c_custkey"))
    return N.insert_conflicts(table(spark, d, "customer").select("c_custkey", "c_name"), state, ["c_custkey"])


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM ({LAST}) WHERE rn = 1 AND event_type = 'error')")
def kv_delete_anti(spark: SparkSession, d: str) -> DataFrame:
    gone = N.deleted_keys(log(spark, d), KEY, SEQ, deleted()).select(F.col("user_id").alias("o_custkey"))
    return N.without(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query(f"SELECT user_id, event_id, event_type, value FROM ({LAST}) WHERE rn = 1 AND event_type <> 'error' AND user_id IN (SELECT c_custkey FROM customer)")
def kv_layered_get(spark: SparkSession, d: str) -> DataFrame:
    """Three layers by time; older ones are asked only for keys that newer ones don't have."""
    rows, cuts = log(spark, d).drop("ts"), ["2024-01-20", "2024-01-10"]
    at = lambda c: F.expr(f"TIMESTAMP_NTZ'{c} 00:00:00'")
    ts = log(spark, d)
    layers = [ts.where(F.col("ts") >= at(cuts[0])), ts.where((F.col("ts") < at(cuts[0])) & (F.col("ts") >= at(cuts[1]))), ts.where(F.col("ts") < at(cuts[1]))]
    layers = [x.select(*rows.columns) for x in layers]
    return N.layered_get(table(spark, d, "customer"), "c_custkey", layers, "user_id", SEQ, deleted())


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def read_projection(spark: SparkSession, d: str) -> DataFrame:
    return N.read_fields(table(spark, d, "orders").where("o_orderkey = 7"), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 50")
def scan_range_limit(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(table(spark, d, "orders"), "o_orderkey", 100, 50, ["o_custkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 500 ORDER BY o_orderkey DESC LIMIT 20")
def scan_desc(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_back(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 20)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey >= 100 ORDER BY o_orderkey LIMIT 30")
def scan_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return S.scan(rows, "o_orderkey", 100, 30, partition=("o_orderstatus", "F"))


@query("""WITH s AS (SELECT c_custkey AS scan_id, c_custkey * 7 AS start, 1 + c_custkey % 10 AS length FROM customer),
r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders),
f AS (SELECT s.*, (SELECT min(k) FROM r WHERE o_orderkey >= s.start) AS k0 FROM s)
SELECT scan_id, start, length, o_orderkey, o_totalprice, k - k0 + 1 AS place FROM f JOIN r ON r.k >= f.k0 AND r.k < f.k0 + length""")
def scan_batch(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    starts = table(spark, d, "customer").select(c.alias("scan_id"), (c * 7).alias("start"), (1 + c % 10).alias("length"))
    return S.scan_batch(starts, "start", "length", table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id >= 128 AND event_id < 640")
def log_range_read(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).where("event_id >= 128 AND event_id < 640").select("event_id", "user_id", "event_type")


@query("SELECT event_id // 64 AS segment, count(*) AS n, min(event_id) AS first, max(event_id) + 1 AS next FROM events GROUP BY 1")
def log_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).groupBy(R.entry_segment(F.col("event_id")).alias("segment"))
    return rows.agg(F.count("*").alias("n"), F.min("event_id").alias("first"), (F.max("event_id") + 1).alias("next"))


@query("SELECT event_id, user_id, value FROM events WHERE event_id // 64 = 3")
def log_segment_read(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).where(R.in_segments(F.col("event_id"), 3, 3)).select("event_id", "user_id", "value")


@query("SELECT max(event_id) + 1 AS tail, count(*) AS n_records, CAST(sum(strlen(props)) AS BIGINT) AS n_bytes FROM events")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg((F.max("event_id") + 1).alias("tail"), F.count("*").alias("n_records"), F.sum(F.octet_length("props")).cast("long").alias("n_bytes"))


@query("""WITH s AS (SELECT event_id, coalesce(sum(strlen(props) + 24) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT CAST(before // 4096 AS BIGINT) AS segment, count(*) AS n, min(event_id) AS first FROM s GROUP BY 1""")
def tail_roll(spark: SparkSession, d: str) -> DataFrame:
    rows = R.rolled_sizes(table(spark, d, "events"), "event_id", F.octet_length("props") + 24, 4096)
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""SELECT segment, user_id, event_id, event_type, value FROM (
  SELECT *, event_id // 1000 AS segment, row_number() OVER (PARTITION BY event_id // 1000, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def segment_lww(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).drop("ts").withColumn("segment", R.entry_segment(F.col("event_id"), 1000))
    return N.last_records(rows, ["segment", "user_id"], SEQ)


@query("""SELECT event_id // 1000 AS run, min(user_id) AS key_min, max(user_id) AS key_max, count(*) AS n_records, CAST(sum(strlen(props)) AS BIGINT) AS size_bytes FROM events GROUP BY 1""")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("run", R.entry_segment(F.col("event_id"), 1000))
    return R.manifest(rows, ["run"], "user_id", F.octet_length("props"))


@query("""WITH m AS (SELECT o_orderkey // 500 AS run, min(o_custkey) AS key_min, max(o_custkey) AS key_max FROM orders GROUP BY 1)
SELECT c_custkey, count(*) AS n_runs, min(run) AS first_run FROM customer JOIN m ON c_custkey BETWEEN key_min AND key_max GROUP BY 1""")
def run_prune(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("run", R.entry_segment(F.col("o_orderkey"), 500))
    runs = R.manifest(rows, ["run"], "o_custkey", F.lit(1)).select("run", "key_min", "key_max")
    found = S.range_totals(table(spark, d, "customer").select("c_custkey"), "c_custkey", runs, "key_min", "key_max", "run")
    return found.select("c_custkey", F.col("n").alias("n_runs"), F.col("least").alias("first_run"))


@query("""WITH c AS (SELECT user_id, CAST(3 - least(event_id // 2500, 2) AS INT) AS level, event_id // 500 AS file_ord, event_id, event_type, value FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level, file_ord DESC, event_id DESC) AS rn FROM c)
SELECT user_id, level, file_ord, event_id, event_type, value FROM l WHERE rn = 1""")
def level_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = log(spark, d).drop("ts").withColumn("level", (3 - F.least(F.floor(e / 2500), F.lit(2))).cast("int")).withColumn("file_ord", F.floor(e / 500).cast("long"))
    in_run = N.last_records(rows, ["user_id", "level", "file_ord"], SEQ)
    return R.level_lookup(in_run, "user_id", "level", "file_ord")


@query("""SELECT target, user_id, event_id, event_type, value FROM (
  SELECT *, event_id // 2000 AS target, row_number() OVER (PARTITION BY event_id // 2000, user_id ORDER BY event_id // 1000 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def compact_merge_pair(spark: SparkSession, d: str) -> DataFrame:
    """Runs 2i and 2i + 1 merged: the newer run's record of a key wins, deletions stay."""
    rows = log(spark, d).drop("ts").withColumn("run", R.entry_segment(F.col("event_id"), 1000))
    return R.merge_runs(rows, F.floor(F.col("run") / 2).cast("long"), "user_id", ["run", "event_id"]).drop("run")


@query(f"SELECT user_id, event_id, event_type, value FROM ({LAST}) WHERE rn = 1 AND event_type <> 'error'")
def compact_full_equiv(spark: SparkSession, d: str) -> DataFrame:
    """Merging pairs of runs, then pairs of those, doesn't change the state."""
    rows = log(spark, d).drop("ts").withColumn("run", R.entry_segment(F.col("event_id"), 1000))
    once = R.merge_runs(rows, F.floor(F.col("run") / 2).cast("long"), "user_id", ["run", "event_id"]).drop("run").withColumnRenamed("target", "run")
    twice = R.merge_runs(once, F.floor(F.col("run") / 2).cast("long"), "user_id", ["run", "event_id"]).drop("run", "target")
    return N.snapshot(twice, KEY, SEQ, deleted())


RUNS = """runs AS (SELECT CAST((event_id // 250) % 4 AS INT) AS level, event_id // 250 AS file_ord, count(*) AS n_records, CAST(sum(strlen(props)) AS BIGINT) AS size_bytes, min(event_id) AS key_min
FROM events GROUP BY 1, 2)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    run = F.floor(F.col("event_id") / 250)
    rows = table(spark, d, "events").withColumn("file_ord", run.cast("long")).withColumn("level", (run % 4).cast("int"))
    return rows.groupBy("level", "file_ord").agg(F.count("*").alias("n_records"), F.sum(F.octet_length("props")).cast("long").alias("size_bytes"), F.min("event_id").alias("key_min"))


@query(f"""WITH {RUNS} SELECT level, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
  sum(size_bytes) / CASE level WHEN 0 THEN 10000 WHEN 1 THEN 20000 WHEN 2 THEN 40000 WHEN 3 THEN 80000 END AS score FROM runs GROUP BY level""")
def level_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.level_scores(_runs(spark, d), {0: 10000, 1: 20000, 2: 40000, 3: 80000})


@query(f"""WITH {RUNS}, s AS (SELECT level, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM runs GROUP BY level)
SELECT level, n_files, size_bytes, level AS priority FROM s WHERE level = 0 AND n_files >= 2 OR level = 1 AND size_bytes > 20000 OR level = 2 AND size_bytes > 40000 OR level = 3 AND n_files > 4""")
def compaction_pick(spark: SparkSession, d: str) -> DataFrame:
    return R.pick_compaction(_runs(spark, d), {0: 10000, 1: 20000, 2: 40000, 3: 80000}, last=3)


@query(f"WITH {RUNS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY level ORDER BY file_ord) AS INT) AS place FROM runs) WHERE place <= 2")
def compaction_inputs(spark: SparkSession, d: str) -> DataFrame:
    return R.compaction_inputs(_runs(spark, d))


@query(f"""WITH {RUNS}, v AS (SELECT level, file_ord, file_ord // 12 AS version FROM runs),
p AS (SELECT *, lead(version) OVER w AS v2, lead(file_ord) OVER w AS o2 FROM v WINDOW w AS (PARTITION BY level ORDER BY file_ord))
SELECT level, min(file_ord) AS first_ord, arg_min(o2, file_ord) AS second_ord, arg_min(version, file_ord) + 1 AS next_version FROM p WHERE version = v2 GROUP BY level""")
def compaction_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return R.adjacent_inputs(_runs(spark, d).withColumn("version", F.floor(F.col("file_ord") / 12).cast("long")), "version")


OPERATIONS = """ops AS (SELECT event_id AS seq, CASE WHEN event_id % 5 = 4 THEN 'COMPACT' ELSE 'LOGCREATE' END AS op,
  CASE WHEN event_id % 5 = 4 THEN ['sharedlog/' || (event_id - 4), 'sharedlog/' || (event_id - 3)] ELSE ['sharedlog/' || (event_id - 1)] END AS inputs,
  CASE WHEN event_id % 5 = 4 THEN ['sstable1/' || event_id] ELSE ['sharedlog/' || event_id] END AS outputs, 'k' || user_id AS k FROM events)"""


def _operations(spark: SparkSession, d: str) -> DataFrame:
    """An operation log made of event numbers: four new segments, then a merge of the first two of them."""
    e = F.col("event_id")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    merge = e % 5 == 4
    return log(spark, d).select(
        e.alias("seq"), F.when(merge, "COMPACT").otherwise("LOGCREATE").alias("op"), F.lit(False).alias("in_last_level"),
        F.when(merge, F.array(name("sharedlog/", e - 4), name("sharedlog/", e - 3))).otherwise(F.array(name("sharedlog/", e - 1))).alias("inputs"),
        F.when(merge, F.array(name("sstable1/", e))).otherwise(F.array(name("sharedlog/", e))).alias("outputs"),
        F.array(F.concat(F.lit("k"), F.col("user_id").cast("string"))).alias("key_start"), F.array(F.concat(F.lit("k"), F.col("user_id").cast("string"))).alias("key_end"),
    )


@query(f"""WITH {OPERATIONS} SELECT unnest(outputs) AS file, seq, k AS key_start, k AS key_end FROM ops
WHERE outputs[1] NOT IN (SELECT unnest(inputs) FROM ops WHERE op = 'COMPACT')""")
def view_live_files(spark: SparkSession, d: str) -> DataFrame:
    return C.live_files(_operations(spark, d))


@query("""WITH n AS (SELECT DISTINCT event_id + 1 AS n FROM events WHERE event_type <> 'error' OR event_id < 100)
SELECT coalesce(min(n.n), 0) AS tail FROM n WHERE n.n + 1 NOT IN (SELECT n FROM n) AND EXISTS (SELECT 1 FROM n WHERE n = 1)""")
def log_chain(spark: SparkSession, d: str) -> DataFrame:
    numbers = log(spark, d).where(~deleted() | (F.col("event_id") < 100)).select((F.col("event_id") + 1).alias("n"))
    return C.chain_end(numbers, "n")


@query("SELECT min(event_id) - 1 AS \"limit\" FROM events WHERE event_type = 'purchase'")
def acknowledged_limit(spark: SparkSession, d: str) -> DataFrame:
    return C.acknowledged(log(spark, d).where("event_type <> 'purchase'"), "event_id")


@query("""SELECT task, generation, owner, seq, n_claims FROM (
  SELECT event_id // 20 AS task, CAST(event_id % 3 AS INT) AS generation, arg_min(user_id, event_id) AS owner, min(event_id) AS seq, count(*) AS n_claims,
         row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id % 3 DESC) AS rn FROM events GROUP BY event_id // 20, event_id % 3) WHERE rn = 1""")
def task_first_writer(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    tasks = log(spark, d).select(F.floor(e / 20).cast("long").alias("task"), (e % 3).cast("int").alias("generation"), F.col("user_id").alias("owner"), e.alias("seq"))
    return C.task_owners(tasks, "task", "generation", "owner", "seq")


DEAD = "(SELECT user_id AS task, max(ts) AS ts, arg_max(event_type, ts) AS status FROM events GROUP BY 1)"


@query(f"SELECT task, ts, status FROM {DEAD} WHERE status <> 'signup' AND TIMESTAMP '2024-01-31 00:00:00' - ts >= INTERVAL 12 HOUR")
def task_dead(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d)


def _dead(spark: SparkSession, d: str) -> DataFrame:
    tasks = log(spark, d).select(F.col("user_id").alias("task"), "ts", F.when(F.col("event_type") == "signup", "COMPLETE").otherwise(F.col("event_type")).alias("status"))
    return C.dead_tasks(tasks, "task", "ts", "status", F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'"), F.expr("INTERVAL '12' HOUR"))


@query(f"""SELECT user_id AS task, max(event_id % 3) + 1 AS generation FROM events
WHERE user_id IN (SELECT task FROM {DEAD} WHERE status <> 'signup' AND TIMESTAMP '2024-01-31 00:00:00' - ts >= INTERVAL 12 HOUR) GROUP BY 1""")
def task_reclaims(spark: SparkSession, d: str) -> DataFrame:
    tasks = log(spark, d).select(F.col("user_id").alias("task"), (F.col("event_id") % 3).alias("generation"))
    return C.reclaims(tasks, _dead(spark, d), "task", "generation")


@query("""WITH p AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS place FROM events)
SELECT a.user_id, CAST(a.place AS INT) AS place, a.ts AS begin_at, b.ts AS end_at FROM p a JOIN p b USING (user_id, place) WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def event_intervals(spark: SparkSession, d: str) -> DataFrame:
    return C.intervals(log(spark, d), "user_id", "ts", "event_type", "view", "purchase")


@query("""WITH f AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'sharedlog/' || event_id || ':' || (event_id + 64) ELSE 'sstable' || (1 + event_id % 3) || '/' || event_id || '_' || user_id END AS name FROM events)
SELECT name, regexp_extract(name, '^([^/]*)/', 1) AS prefix, nullif(regexp_extract(name, '^sstable(\\d+)/', 1), '')::INT AS level, nullif(regexp_extract(name, '/(\\d+):\\d+$', 1), '')::BIGINT AS start_offset,
  nullif(regexp_extract(name, ':(\\d+)$', 1), '')::BIGINT AS end_offset, nullif(regexp_extract(name, '/(\\d+)_', 1), '')::BIGINT AS version, regexp_extract(name, '(\\d+)$', 1)::BIGINT AS number FROM f""")
def file_name_parts(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    entry = F.concat(F.lit("sharedlog/"), e.cast("string"), F.lit(":"), (e + 64).cast("string"))
    run = F.concat(F.lit("sstable"), (1 + e % 3).cast("string"), F.lit("/"), e.cast("string"), F.lit("_"), u)
    names = log(spark, d).select(F.when(e % 2 == 0, entry).otherwise(run).alias("name"))
    parts = C.name_parts(F.col("name"))
    return names.select("name", *[parts[p].alias(p) for p in ("prefix", "level", "start_offset", "end_offset", "version")], C.trailing_number(F.col("name")).alias("number"))


def _hex_sql(x: str) -> str:
    return f"hex(encode({x}))"


def _size_sql(x: str, little: bool = False) -> str:
    """The length of a text's bytes, 4 bytes as hex; those of these texts are below 256."""
    n = f"lpad(upper(to_hex(strlen({x}))), 2, '0')"
    return f"({n} || '000000')" if little else f"('000000' || {n})"


@query(f"""SELECT event_id, event_type, props, {' || '.join(f"{_size_sql(x)} || {_hex_sql(x)}" for x in ("'event_type'", "event_type", "'props'", "props"))} AS bytes FROM events""")
def row_codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    bytes_ = lambda c: F.col(c).cast("binary")
    rows = table(spark, d, "events").select("event_id", encode_row(F.create_map(F.lit("event_type"), bytes_("event_type"), F.lit("props"), bytes_("props"))).alias("blob"))
    rows = rows.select("event_id", F.hex("blob").alias("bytes"), decode_row("blob").alias("f"))
    return rows.select("event_id", "bytes", F.col("f.event_type").cast("string").alias("event_type"), F.col("f.props").cast("string").alias("props"))


@query(f"""SELECT event_id, event_type AS k, props AS v, CAST(event_type <> 'error' AS INT) AS op,
  {_size_sql('event_type', True)} || {_hex_sql('event_type')} || {_size_sql('props', True)} || {_hex_sql('props')} || CASE WHEN event_type = 'error' THEN '00' ELSE '01' END AS bytes FROM events""")
def entry_codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    blob = encode_entry(F.col("event_type").cast("binary"), F.col("props").cast("binary"), (F.col("event_type") != "error").cast("int"))
    got = rows.select("event_id", F.hex(blob).alias("bytes"), decode_entry(blob).alias("e"))
    return got.select("event_id", "bytes", F.col("e.key").cast("string").alias("k"), F.col("e.value").cast("string").alias("v"), F.col("e.op").alias("op"))


_ONE = "lpad(upper(to_hex({0})), 2, '0')"


@query(f"""SELECT event_id, true AS ok, event_type AS k, props AS v, CAST(event_type <> 'error' AS INT) AS type,
  {_ONE.format('strlen(event_type) + strlen(props) + 6')} || '0A' || {_ONE.format('strlen(event_type)')} || {_hex_sql('event_type')} || '12' || {_ONE.format('strlen(props)')} || {_hex_sql('props')} || '18' || CASE WHEN event_type = 'error' THEN '00' ELSE '01' END AS bytes FROM events""")
def message_codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    blob = encode_message(F.col("event_type").cast("binary"), F.col("props").cast("binary"), (F.col("event_type") != "error").cast("int"))
    got = rows.select("event_id", F.hex(blob).alias("bytes"), decode_messages(blob).alias("m")).select("event_id", "bytes", "m.ok", F.explode("m.records").alias("r"))
    return got.select("event_id", "bytes", "ok", F.col("r.key").cast("string").alias("k"), F.col("r.value").cast("string").alias("v"), F.col("r.type").alias("type"))
