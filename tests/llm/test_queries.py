import re

import duckdb

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_oracle import compare
from portvigil.llm.queries import ORACLES, QUERIES


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == sorted(set(numbers)) and set(range(1, 11)) <= set(numbers)
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql()) and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]


def test_queries_agree_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    for name in ORACLES:
        assert compare(spark, con, name, sf).startswith("ok")
