"""Small frames for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

START = datetime(2024, 1, 1)
PORT = ("10.0.0.1", 1, 1)
OPTICAL_ROWS = "occur_date timestamp_ntz, ip_addr string, cid int, lid int, tx_avg_power double, rx_avg_power double"
TRAFFIC_ROWS = (
    "occur_date timestamp_ntz, ip_addr string, cid int, lid int, tx_packet double, rx_packet double, error_packet double"
)


def at(slot: float, minutes: int = 15) -> datetime:
    return START + timedelta(minutes=slot * minutes)


def optical_rows(spark: SparkSession, rows, port=PORT) -> DataFrame:
    """``rows`` are (slot, tx, rx)."""
    data = [(at(s), *port, tx, rx) for s, tx, rx in rows]
    return spark.createDataFrame(data, OPTICAL_ROWS)


def traffic_rows(spark: SparkSession, rows, port=PORT) -> DataFrame:
    """``rows`` are (slot, tx, rx, errors)."""
    data = [(at(s), *port, tx, rx, err) for s, tx, rx, err in rows]
    return spark.createDataFrame(data, TRAFFIC_ROWS)


def series(df: DataFrame, column: str) -> list:
    return [r[column] for r in df.orderBy("slot_idx").collect()]


def plan_of(df: DataFrame) -> str:
    """The physical plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()
