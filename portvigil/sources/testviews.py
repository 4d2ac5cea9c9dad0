"""Metric tracks derived from the ``events`` table, so the engine can run on the given test data.

Ten ports: one contaminated, one dead; some readings NULL; optical lacks an eighth of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portvigil.spec import SIGNAL_ETH, SIGNAL_OPTIC


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


def _port_columns():
    return [
        F.col("ts").alias("occur_date"),
        F.concat(F.lit("dev-"), "event_type").alias("ip_addr"),
        (F.col("user_id") % 2).cast("int").alias("cid"),
        F.lit(1).alias("lid"),
    ]


def traffic_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw traffic rows under their physical names."""
    k = F.col("k")
    contaminated = (F.col("event_type") == "view") & (F.col("user_id") % 2 == 1) & (k == 99)
    return _events(spark, sf_dir).select(
        *_port_columns(),
        F.when(F.col("user_id") % 10 == 9, SIGNAL_OPTIC).otherwise(SIGNAL_ETH).alias("signal_type"),
        F.when(contaminated, 1001).when(k >= 90, k - 90).otherwise(0).cast("long").alias("bbe_in_error"),
        F.when(k != 13, F.floor(F.col("value") * 100).cast("long")).alias("es"),
        F.floor(F.col("value") * 95).cast("long").alias("ses"),
    )


def optical_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = (F.col("event_type") == "signup") & (F.col("user_id") % 2 == 1)
    return (
        _events(spark, sf_dir)
        .where(F.col("k") % 8 != 0)
        .select(
            *_port_columns(),
            F.when(dead, -40.0).otherwise(-5.0 - F.col("k") / 50).alias("tx_avg_power"),
            F.when(dead, -40.0).otherwise(-8.0 - F.col("value") / 25).alias("rx_avg_power"),
        )
    )
