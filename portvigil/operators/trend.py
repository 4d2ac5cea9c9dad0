"""Trend of a long history from regression moments that are kept per port and stretch of time.

``fusion.trend_slope`` needs every scored window of a port at once.  A history that grows by cycles keeps instead one
row of moments per port and stretch (a day, say).  Positions count from 0 within a stretch; a stretch that follows
others has its positions shifted by their windows.  Moments are central, so long histories lose no digits, and they
merge in any grouping of neighbouring stretches.  A slope over months reads one row per stretch and no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portvigil.spec import KEYS

STRETCH = "stretch"


def stretch_moments(judged: DataFrame, stretch: str) -> DataFrame:
    """Moments per port and stretch, an expression that never falls as the slot grows.

    ``windows`` counts positions; the rest covers the ``n`` windows whose severity is known: means of position and
    severity, sum of squares of positions and of products, both about the means.
    """
    over = f"over (partition by {', '.join(KEYS)}, {STRETCH} order by slot_idx)"
    dealt = judged.selectExpr(*KEYS, "slot_idx", "severity", f"{stretch} as {STRETCH}")
    placed = dealt.selectExpr("*", f"row_number() {over} - 1 as _pos")
    return placed.groupBy(*KEYS, STRETCH).agg(
        F.min("slot_idx").alias("first_slot"),
        F.count("*").alias("windows"),
        F.count("severity").alias("n"),
        F.expr("coalesce(avg(_pos) filter (where severity is not null), 0.0D)").alias("mean_pos"),
        F.expr("coalesce(avg(severity), 0.0D)").alias("mean_severity"),
        F.expr("coalesce(regr_sxx(severity, _pos), 0.0D)").alias("pos_squares"),
        F.expr("coalesce(regr_sxy(severity, _pos), 0.0D)").alias("products"),
    )


def merge_moments(moments: DataFrame, *by: str) -> DataFrame:
    """Moments of all stretches of a port, or of each group of neighbouring ones that ``by`` names, put together."""
    group = [*KEYS, *by]
    over = f"partition by {', '.join(group)}"
    before = f"over ({over} order by first_slot rows between unbounded preceding and 1 preceding)"
    placed = moments.withColumn("mean_pos", F.expr(f"mean_pos + coalesce(sum(windows) {before}, 0)"))
    means = {f"_{m}": F.expr(f"coalesce(sum(n * {m}) over ({over}) / nullif(sum(n) over ({over}), 0), 0.0D)") for m in ("mean_pos", "mean_severity")}
    d_pos, d_severity = "(mean_pos - _mean_pos)", "(mean_severity - _mean_severity)"
    return placed.withColumns(means).groupBy(*group).agg(
        F.min("first_slot").alias("first_slot"),
        F.sum("windows").alias("windows"),
        F.sum("n").alias("n"),
        F.first("_mean_pos").alias("mean_pos"),
        F.first("_mean_severity").alias("mean_severity"),
        F.expr(f"sum(pos_squares + n * {d_pos} * {d_pos})").alias("pos_squares"),
        F.expr(f"sum(products + n * {d_pos} * {d_severity})").alias("products"),
    )


def slopes(moments: DataFrame) -> DataFrame:
    """Least-squares slope of severity over position per row of moments, 0 where a line is not determined."""
    return moments.withColumn("slope", F.expr("coalesce(products / nullif(pos_squares, 0), 0.0D)"))


def store_moments(moments: DataFrame, path: str) -> None:
    """Keep moments by stretch; a stretch that comes again replaces what was kept of it."""
    writer = moments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(STRETCH).parquet(path)


def stored_slopes(spark: SparkSession, path: str) -> DataFrame:
    """Slope of each port over all that is stored."""
    return slopes(merge_moments(spark.read.parquet(path)))
