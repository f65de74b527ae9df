import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_names():
    names = list(entry.queries())
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_chat_sql(spark):
    rows = sorted(map(tuple, entry.queries()["op3_chat_format"](spark, DATA).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    assert rows == sorted(con.sql(entry.oracle_sql()["op3_chat_format"]).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pieces = corpus_pipeline.run(spark, DATA)
    kept = {r[0] for r in pieces.select("doc_id").distinct().collect()}
    everything = {r[0] for r in docs.select("doc_id").collect()}
    assert kept < everything and len(kept) > 0.8 * len(everything)
    leaks = {r[0] for r in entry.queries()["op6_benchmark_leaks"](spark, DATA).select("doc_id").collect()}
    assert leaks and leaks.isdisjoint(kept)
