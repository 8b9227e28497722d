"""Queries that SQL can express, against DuckDB."""

import pytest
from oracle import differences
from sedimenta.llm import queries

from .helpers import FOLDER


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_sql(spark, name):
    assert not differences(spark, queries.QUERIES[name], queries.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_for_each_input_row(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    many = {"op7_embedding_near_dedup": "embeddings"}.get(name, "documents")
    if name == "op9_preference_format":
        want = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count()
    else:
        want = spark.read.parquet(f"{FOLDER}/{many}.parquet").count()
    assert got.count() >= want if name.startswith("op2") else got.count() == want
