"""Queries over stored results."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.functions import text as X
from portvigil.functions.scores import alarm_label
from portvigil.functions.times import clock_label, ntz, time_text, to_ntz
from portvigil.spec import KEYS, OPTICAL, PAGE_SIZE, TRAFFIC, TrackSpec

RESULT_HOUR = "occur_hour"
PORT_NAMES = {"cid": "slot_id", "lid": "port_id"}
SNAPSHOT_COLS = (
    "occur_date",
    "ip_addr",
    "slot_id",
    "port_id",
    "severity",
    "alarm_level",
    "alarm_label",
    "slope",
    "slope_label",
    "ttf_minutes",
    "expected_fatal_time",
    "anomaly_reason",
    "is_traffic_anomaly",
    "is_optical_anomaly",
)
HISTORY_COLS = (
    "occur_date",
    "tx_packet",
    "rx_packet",
    "error_packet",
    "tx_avg_power",
    "rx_avg_power",
    "anomaly_score",
    "threshold",
    "severity",
    "alarm_level",
    "alarm_label",
    "anomaly_reason",
    "traffic_score",
    "traffic_threshold",
    "traffic_severity",
    "optical_score",
    "optical_threshold",
    "optical_severity",
    "is_traffic_anomaly",
    "is_optical_anomaly",
)


def project_alias(results: DataFrame) -> DataFrame:
    """Port columns under the names clients know."""
    return results.withColumnsRenamed(PORT_NAMES)


def max_slot(results: DataFrame) -> DataFrame:
    return results.agg(F.max("occur_date").alias("max_slot"))


def latest_in_table(results: DataFrame) -> DataFrame:
    """Rows of the newest stored slot.  The stored table finds its newest hour from partition names
    first, so that only this hour is read."""
    if RESULT_HOUR in results.columns:
        hour = results.agg(F.max(RESULT_HOUR).alias("h"))
        results = results.where(F.col(RESULT_HOUR) == hour.scalar())
    return results.where(F.col("occur_date") == max_slot(results).scalar())


def filter_level(results: DataFrame, severity_min: int = 0, severity_max: int = 3) -> DataFrame:
    """Alarm level between two levels; the parameter names are those of the query."""
    return results.where(F.col("alarm_level").between(severity_min, severity_max))


def filter_rising(results: DataFrame) -> DataFrame:
    return results.where(F.col("slope_label") == "RISING")


def filter_anomalies(results: DataFrame) -> DataFrame:
    return results.where("is_anomaly")


def filter_critical(results: DataFrame) -> DataFrame:
    return results.where(F.col("alarm_label") == "CRITICAL")


def filter_port_history(
    results: DataFrame, ip_addr: str, slot_id: int, port_id: int, as_of: datetime, days: int = 1
) -> DataFrame:
    since = as_of - timedelta(days=days)
    rows = results.where((F.col("ip_addr") == ip_addr) & (F.col("cid") == slot_id) & (F.col("lid") == port_id))
    if RESULT_HOUR in results.columns:
        rows = rows.where(F.col(RESULT_HOUR) >= since.strftime("%Y-%m-%d-%H"))
    return rows.where(f"occur_date >= {ntz(since)}")


def format_times(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text; NULL stays NULL."""
    return df.withColumns({c: F.expr(time_text(c)) for c in columns})


def current_anomalies(
    results: DataFrame, severity_min: int = 0, severity_max: int = 3, rising_only: bool = False
) -> DataFrame:
    """Latest snapshot, worst first."""
    rows = filter_level(latest_in_table(results), severity_min, severity_max)
    if rising_only:
        rows = filter_rising(rows)
    shown = project_alias(rows).select(*SNAPSHOT_COLS)
    ordered = shown.orderBy(F.desc("severity"), F.desc("slope"))
    return format_times(ordered, "occur_date", "expected_fatal_time")


def watchlist(results: DataFrame) -> DataFrame:
    """Ports getting worse that are not critical yet."""
    return current_anomalies(results, severity_max=2, rising_only=True)


def active_criticals(results: DataFrame) -> DataFrame:
    """Critical ports of the latest slot as alarm records."""
    return current_anomalies(results, severity_min=3).select(
        F.lit("ALARM").alias("type"),
        F.col("occur_date").alias("event_time"),
        "ip_addr",
        "slot_id",
        "port_id",
        F.col("anomaly_reason").alias("message"),
    )


def port_history(
    results: DataFrame, ip_addr: str, slot_id: int, port_id: int, as_of: datetime, days: int = 1
) -> DataFrame:
    """One port's stored rows of the trailing days, oldest first."""
    rows = filter_port_history(results, ip_addr, slot_id, port_id, as_of, days)
    return format_times(rows.select(*HISTORY_COLS).orderBy("occur_date"), "occur_date")


def paginate(df: DataFrame, order: list[Column | str], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page`` (from 1) of a totally ordered frame."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def sort_canonical(df: DataFrame) -> DataFrame:
    return df.orderBy(*KEYS, "occur_date")


def port_summary(results: DataFrame) -> DataFrame:
    """Anomalies per port: how many, the highest score and the most frequent reason (ties: smallest).

    Reasons are counted per (port, reason) first.  Reason texts carry readings, so a port can have as
    many reasons as rows; no task ever holds them together.
    """
    counted = (
        filter_anomalies(results)
        .groupBy(*KEYS, "anomaly_reason")
        .agg(F.count("*").alias("n"), F.max("anomaly_score").alias("top"))
    )
    first = F.min(F.struct((-F.col("n")).alias("rank"), F.col("anomaly_reason").alias("reason")))
    summary = counted.groupBy(*KEYS).agg(
        F.sum("n").alias("anomalies"), F.max("top").alias("max_score"), first.alias("first")
    )
    return summary.select(
        *KEYS, "anomalies", "max_score", F.col("first.reason").alias("primary_reason")
    ).orderBy(F.desc("max_score"), *KEYS)


def cycle_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("processed"), F.count_if("is_anomaly").alias("anomalies"))


def counts_per_cycle(results: DataFrame) -> DataFrame:
    return results.groupBy("occur_date").agg(
        F.count("*").alias("processed"), F.count_if("is_anomaly").alias("anomalies")
    )


def kpi_counts(results: DataFrame) -> DataFrame:
    """Current anomalies (level 1 up) and active critical alarms."""
    level = F.col("alarm_level")
    return latest_in_table(results).agg(
        F.count_if(level >= 1).alias("total_anomalies"), F.count_if(level >= 3).alias("critical_alarms")
    )


def port_time_bounds(grid: DataFrame) -> DataFrame:
    """First and last slot of each port."""
    return grid.groupBy(*KEYS).agg(F.min("occur_date").alias("first_slot"), F.max("occur_date").alias("last_slot"))


def diagnose_port(results: DataFrame, spec: TrackSpec) -> DataFrame:
    """Rule label for the last reading of each port."""
    last = [F.max_by(f, "occur_date").alias(f) for f in spec.features]
    return results.groupBy(*KEYS).agg(*last).selectExpr(*KEYS, f"{X.diagnosis(spec)} as diagnosis")


def display_fields(snapshot: DataFrame) -> DataFrame:
    """Table cells for rows of ``current_anomalies``, whose times are text already."""
    return snapshot.selectExpr(
        "occur_date as time",
        "ip_addr",
        f"{X.port_label('slot_id', 'port_id')} as port",
        "alarm_label",
        f"{X.severity_text('severity')} as severity",
        f"{X.slope_text('slope')} as trend",
        f"{X.fatal_text('ttf_minutes', to_ntz('expected_fatal_time'))} as expected",
    )


def severity_zone(history: DataFrame) -> DataFrame:
    """Zone of each plotted severity value."""
    return history.withColumns({f"{t.name}_zone": F.expr(alarm_label(t.severity)) for t in (TRAFFIC, OPTICAL)})


def history_series(history: DataFrame, traffic: bool = True, optical: bool = True) -> DataFrame:
    """A port's history as long (time, series, value) rows, for the tracks to show."""
    shown = [t for t, on in ((TRAFFIC, traffic), (OPTICAL, optical)) if on]
    series = []
    for t in shown:
        series += [
            F.coalesce(F.col(t.severity), F.lit(0.0)).alias(t.severity),
            F.col(t.score),
            F.col(t.threshold),
            *[F.col(f).cast("double").alias(f) for f in t.features],
        ]
    label = F.expr(clock_label(to_ntz("occur_date"))).alias("label")
    wide = history.select("occur_date", label, *series)
    return wide.unpivot(["occur_date", "label"], None, "series", "value")
