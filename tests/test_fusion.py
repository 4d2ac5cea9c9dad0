import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from portvigil.functions import scores as S
from portvigil.functions import text as X
from portvigil.operators import clean, fusion, scoring, windows
from portvigil.operators.config import TrackSettings
from portvigil.plans.detect import detect, score_track
from portvigil.spec import DETECTION_SCHEMA, OPTICAL, STANDARD_COLS, TRAFFIC
from tests.helpers import PORT, at, optical_rows, plan_of, series, traffic_rows

SETTINGS = {"traffic": TrackSettings(0.5), "optical": TrackSettings(0.5)}
SCALERS = {t.name: {f: (0.0, 1.0) for f in t.features} for t in (TRAFFIC, OPTICAL)}


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).selectExpr(*columns).collect()]


def test_severity_edges(spark):
    rows = [(0.0, 2.0), (2.0, 2.0), (2 * 2.0216512, 2.0), (2 * 4.2188758, 2.0), (5.0, 0.0), (None, 1.0)]
    got = values(spark, rows, "s double, t double", S.severity("s", "t"))
    assert [None if g[0] is None else round(g[0], 4) for g in got] == [0.0, 50.0, 70.0, 90.0, 0.0, None]


def test_severity_is_monotone_and_bounded(spark):
    rows = [(i / 10, 1.3) for i in range(400)]
    got = [g[0] for g in values(spark, rows, "s double, t double", S.severity("s", "t"))]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 100


def test_score_at_the_threshold_is_minor_but_not_flagged(spark):
    flag, label = S.flag_anomaly("s", "t"), S.alarm_label(S.severity("s", "t"))
    assert values(spark, [(2.0, 2.0)], "s double, t double", flag, label) == [(False, "MINOR")]


def test_alarm_tiers(spark):
    rows = [(90.0,), (89.99,), (70.0,), (50.0,), (49.9,), (None,), (math.nan,)]
    got = values(spark, rows, "s double", S.alarm_level("s"), S.alarm_label("s"))
    assert got == [
        (3, "CRITICAL"),
        (2, "MAJOR"),
        (2, "MAJOR"),
        (1, "MINOR"),
        (0, "NORMAL"),
        (0, "NORMAL"),
        (0, "NORMAL"),
    ]


def test_time_to_failure(spark):
    rows = [(60.0, 4.0), (60.0, 0.5), (95.0, 4.0), (60.0, None)]
    label = S.slope_label("m", 1.0)
    ttf = S.time_to_failure(label, "s", "m", 90.0, 15)
    got = values(spark, rows, "s double, m double", label, ttf)
    assert got == [("RISING", 120.0), ("STABLE", None), ("RISING", None), ("STABLE", None)]


def test_packet_counts_come_back_exactly(spark):
    df = spark.range(0, 1_000_000, 7).select("id", F.expr(S.packets_back("log1p(id)")).alias("back"))
    assert df.where("id <> back").count() == 0


def test_fixed_decimals(spark):
    rows = [(1.239,), (-14.304,), (-0.004,), (0.0,), (None,), (math.inf,), (1234567.891,)]
    got = [g[0] for g in values(spark, rows, "x double", X.fixed("x", 2))]
    assert got == ["1.24", "-14.30", "0.00", "0.00", None, None, "1234567.89"]


def test_reasons(spark):
    df = spark.createDataFrame([(5, 6, 0, True), (5, 6, 7, True), (5, 6, 7, False)], "tx_packet long, rx_packet long, error_packet long, f boolean")
    got = [r[0] for r in df.selectExpr(X.reason_text(TRAFFIC, "f")).collect()]
    assert got == ["Traffic (TX:5, RX:6)", "Traffic (TX:5, RX:6, Err:7)", "NORMAL"]
    df = spark.createDataFrame([(-5.128, -8.2, True)], "tx_avg_power double, rx_avg_power double, f boolean")
    assert df.selectExpr(X.reason_text(OPTICAL, "f")).first()[0] == "Optical (RX:-8.20, TX:-5.13)"
    pairs = [("a", "'one'"), ("b", "'two'")]
    rows = [(True, True), (False, True), (False, False)]
    assert values(spark, rows, "a boolean, b boolean", X.join_reasons(pairs)) == [("one + two",), ("two",), ("NORMAL",)]


def test_format_ttf(spark):
    rows = [(135.0,), (45.0,), (120.0,), (None,)]
    assert values(spark, rows, "m double", X.format_ttf("m")) == [("2h 15m",), ("45m",), ("2h 0m",), ("N/A",)]


def steady(n, level=0.0):
    return [(i, level, level) for i in range(n)]


def test_slope_of_a_single_window_is_zero(spark):
    grid = clean.preprocess(optical_rows(spark, steady(12)), OPTICAL)
    scored = scoring.score_window_mean(windows.robust_apply(grid, OPTICAL, SCALERS["optical"]), OPTICAL)
    row = fusion.trend_slope(fusion.judge_scores(scored, SETTINGS["optical"])).collect()
    assert [r.slope for r in row] == [0.0]


def test_slope_counts_scored_windows_not_slots(spark):
    judged = spark.createDataFrame(
        [(*PORT, s, v) for s, v in ((0, 1.0), (1, 2.0), (50, 3.0), (51, 4.0))],
        "ip_addr string, cid int, lid int, slot_idx long, severity double",
    )
    assert series(fusion.trend_slope(judged), "slope") == [1.0] * 4


def test_detect_keeps_schema_with_one_track(spark):
    found = detect(None, optical_rows(spark, steady(14)), SCALERS, SETTINGS, latest_only=False)
    assert tuple(found.columns) == STANDARD_COLS
    assert [f.dataType for f in found.schema] == [f.dataType for f in DETECTION_SCHEMA]
    rows = found.collect()
    assert len(rows) == 3
    # A tie goes to traffic, whose values are zeros.
    assert {(r.severity, r.threshold, r.slope, r.slope_label, r.tx_packet) for r in rows} == {(0.0, 0.0, 0.0, "STABLE", 0)}


def test_detect_without_a_model_gives_nothing(spark):
    assert detect(traffic_rows(spark, []), None, {}, {}) is None
    assert detect(None, None, SCALERS, SETTINGS) is None


def test_outer_join_leaves_threshold_and_slope_of_the_missing_side_null(spark):
    optical = optical_rows(spark, steady(13), port=("b", 1, 1))
    traffic = traffic_rows(spark, [(i, 3.0, 3.0, 0.0) for i in range(12)], port=("a", 1, 1))
    found = {r.ip_addr: r for r in detect(traffic, optical, SCALERS, SETTINGS, latest_only=False).collect()}
    only_optical = found["b"]
    assert (only_optical.traffic_threshold, only_optical.slope, only_optical.slope_label) == (None, None, "STABLE")
    assert only_optical.traffic_severity == 0.0 and not only_optical.is_anomaly
    assert found["a"].optical_threshold is None and found["a"].threshold == 0.5


def test_latest_only_takes_the_newest_slot_of_the_batch(spark):
    late = optical_rows(spark, steady(15), port=("late", 1, 1))
    gone = optical_rows(spark, steady(13), port=("gone", 1, 1))
    found = detect(None, late.unionByName(gone), SCALERS, SETTINGS).collect()
    assert [(r.ip_addr, r.occur_date) for r in found] == [("late", at(14))]


def test_anomaly_gets_reason_and_outlook(spark):
    rows = [(i, -5.0, -5.0) for i in range(12)] + [(12 + i, -5.0 - i, -5.0 - i) for i in range(1, 5)]
    strict = {"optical": TrackSettings(2.0)}
    found = detect(None, optical_rows(spark, rows), SCALERS, strict, latest_only=False)
    last = found.orderBy(F.desc("occur_date")).first()
    assert last.is_optical_anomaly and last.anomaly_reason == "Optical (RX:-9.00, TX:-9.00)"
    assert last.slope_label == "RISING"
    for r in found.collect():
        rising = r.slope_label == "RISING" and r.severity < 90
        assert (r.ttf_minutes is not None) == rising
        if rising:
            assert r.ttf_minutes % 15 == 0 and r.ttf_minutes > 0
            assert r.expected_fatal_time == r.occur_date + timedelta(minutes=r.ttf_minutes)


def test_infinite_readings_count_as_missing(spark):
    rows = [(i, float("inf") if i == 13 else -5.0, -5.0) for i in range(15)]
    found = detect(None, optical_rows(spark, rows), SCALERS, SETTINGS, latest_only=False).collect()
    assert len(found) == 4 and {(r.is_anomaly, r.alarm_label) for r in found} == {(False, "NORMAL")}


def many_ports(spark, skip: int):
    """Readings of 400 ports, some of which a track does not know."""
    ports = spark.range(400).where(f"id % {skip} > 0").select(
        F.concat(F.lit("10.0.0."), F.col("id")).alias("ip_addr"), (F.col("id") % 7).cast("int").alias("cid"), F.lit(1).alias("lid")
    )
    slots = spark.range(30).selectExpr("timestampadd(MINUTE, id * 15, timestamp_ntz'2024-01-01') as occur_date", "id as n")
    return ports.crossJoin(slots.hint("broadcast"))


def finished_pair(spark):
    raws = {
        TRAFFIC: many_ports(spark, 5).selectExpr("*", "n * 10D as tx_packet", "n * 9D as rx_packet", "0D as error_packet"),
        OPTICAL: many_ports(spark, 3).selectExpr("*", "-5D - n / 50 as tx_avg_power", "-8D - n / 25 as rx_avg_power"),
    }
    return [score_track(raws[t].drop("n"), t, SCALERS[t.name], SETTINGS[t.name]) for t in (TRAFFIC, OPTICAL)]


def test_fusion_adds_no_exchange_to_those_of_the_tracks(spark):
    sides = finished_pair(spark)
    counts = [plan_of(s).count("Exchange hashpartitioning") for s in sides]
    assert plan_of(fusion.fuse_tracks_join(*sides)).count("Exchange hashpartitioning") == sum(counts)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_fusion_equals_a_full_join_when_partitions_are_coalesced(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        traffic, optical = finished_pair(spark)
        got = fusion.fuse_tracks_join(traffic, optical)
        want = traffic.join(optical, list(fusion.JOIN_KEYS), "full_outer")
        assert got.columns == want.columns
        rows = sorted(map(repr, got.collect()))
        assert rows == sorted(map(repr, want.collect())) and len(rows) == 373 * 19
    finally:
        for key in (
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst",
            "spark.sql.adaptive.enabled",
        ):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fusion_of_an_empty_track(spark):
    traffic, optical = finished_pair(spark)
    got = fusion.fuse_tracks_join(traffic.where("false"), optical)
    assert got.count() == optical.count() and got.where("traffic_score is not null").count() == 0
