"""Databases that only the driver can open, from executors that are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

from oracle import differences
from sedimenta.plans.catalog import QUERIES, SQL

ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
folder = sys.argv[1]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from oracle import differences
from pyspark.sql import functions as F
from sedimenta.functions.scalar import shard_of
from sedimenta.plans.catalog import QUERIES, SQL
from sedimenta.sources import jdbc
wrong = differences(spark, QUERIES["jdbc_shards"], SQL["jdbc_shards"], "/root/testdata/sf0.001")
assert not wrong, wrong

jdbc.PIECE = 7  # many pieces, the last one not full
odd = {"": "empty", "a'b": None, "ü\\U0001f642": 'x"y', **{f"k{i}": str(i) for i in range(40)}}
rows = spark.createDataFrame(list(odd.items()), "YCSB_KEY string, FIELD0 string")
driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
urls = [f"jdbc:derby:memory:odd{i};create=true" for i in range(3)]
assert all(jdbc.driver_only(spark, u) for u in urls) and not jdbc.driver_only(spark, "jdbc:derby://host/x")
text = driver | {"createTableColumnTypes": "YCSB_KEY VARCHAR(64)"}
load = lambda u: jdbc.load(spark, u, "t", driver, folder=f"{folder}/shared")
jdbc.save(rows.limit(0), urls, "t", text)
assert load(urls).count() == 0
jdbc.save(rows, urls, "t", text, batch=3)
got = load(urls).collect()
assert len(got) == len(odd) and {r.YCSB_KEY: r.FIELD0 for r in got} == odd
assert all(load([u]).where(shard_of(F.col("YCSB_KEY"), 3) != i).count() == 0 for i, u in enumerate(urls))
jdbc.save(rows, urls, "t", text)
assert load(urls).count() == 2 * len(odd)
try:
    jdbc.load(spark, urls, "t", driver)
    raise SystemExit("read without a shared folder")
except ValueError:
    pass
jdbc.drop_memory(spark, urls[0])
try:
    spark._jvm.java.sql.DriverManager.getConnection("jdbc:derby:memory:odd0")
    raise SystemExit("a dropped database is there")
except Exception as e:
    assert "not found" in str(e)
print("all right")
"""


def test_embedded_databases_on_a_cluster(tmp_path):
    (tmp_path / "shared").mkdir()
    repo = Path(__file__).resolve().parents[1]
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_")} | {"PYTHONPATH": f"{repo}:{repo}/tests:{os.environ.get('PYTHONPATH', '')}", "SPARK_LOCAL_DIRS": str(tmp_path)}
    got = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all right" in got.stdout, got.stderr[-3000:]


def test_fields_may_be_null_or_long(spark, tmp_path):
    for p in Path("/root/testdata/sf0.001").iterdir():
        if p.name != "customer.parquet":
            (tmp_path / p.name).symlink_to(p)
    rows = [(1, None, 3), (2, "n" * 5000, None), (3, "", 0), (4, "ü'\"", 1)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert not differences(spark, QUERIES["jdbc_shards"], SQL["jdbc_shards"], str(tmp_path))
