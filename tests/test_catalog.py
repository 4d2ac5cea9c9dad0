import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare
from portvigil.catalog.oracle import ORACLES
from portvigil.catalog.queries import QUERIES

NO_SQL = {"fit_reconstruction", "score_reconstruction", "validation_loss", "select_best_model", "detect_reconstruction"}


def test_every_query_has_sql_except_the_trained_model():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry_runs(spark):
    rows = entry(spark)
    assert rows.count() > 0 and rows.columns[:4] == ["occur_date", "ip_addr", "cid", "lid"]


@pytest.mark.parametrize(
    "name", ["preprocess_train", "quality_filter_optical", "robust_fit", "detect", "port_summary", "alarm_transitions"]
)
def test_query_agrees_with_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    assert compare(spark, con, name, sf).startswith("ok")
