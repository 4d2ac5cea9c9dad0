import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from portvigil.operators import alarms, config, reports, sinks, splits
from portvigil.sources import raw
from portvigil.spec import OPTICAL_SCHEMA, RESULT_COLS, RESULT_SCHEMA, TRAFFIC_RAW_SCHEMA, TRAFFIC_SCHEMA
from tests.helpers import START, at, traffic_rows

LABELS = {0: "NORMAL", 1: "MINOR", 2: "MAJOR", 3: "CRITICAL"}


def stored(spark, rows):
    """Result rows from (slot, ip, level, extra columns)."""
    columns = "occur_date timestamp_ntz, ip_addr string, cid int, lid int, alarm_level int, alarm_label string, severity double, slope double, slope_label string, is_anomaly boolean, anomaly_score double, anomaly_reason string"
    data = []
    for slot, ip, level, *rest in rows:
        extra = {"severity": 30.0 * level, "slope": 0.0, "slope_label": "STABLE", "reason": f"r{slot}", **(rest[0] if rest else {})}
        data.append(
            (at(slot), ip, 1, 1, level, LABELS[level], extra["severity"], extra["slope"], extra["slope_label"], level > 0, float(level), extra["reason"])
        )
    return sinks.ensure_schema(spark.createDataFrame(data, columns), START)


def events(df):
    return sorted((r.event_time, r.type, r.ip_addr) for r in df.collect())


def test_alarm_sequence(spark):
    df = stored(spark, [(1, "a", 3), (2, "a", 3), (3, "b", 0), (4, "a", 3), (5, "a", 1)])
    assert events(alarms.alarm_transitions(df)) == [
        (at(1), "ALARM", "a"),
        (at(2), "ALARM", "a"),
        (at(3), "CLEAR", "a"),
        (at(4), "ALARM", "a"),
        (at(5), "CLEAR", "a"),
    ]
    assert alarms.active_alarm_view(alarms.alarm_transitions(df)).count() == 0
    open_ = alarms.active_alarm_view(alarms.alarm_transitions(df.where(F.col("occur_date") <= F.lit(at(4)))))
    assert events(open_) == [(at(4), "ALARM", "a")]


def test_alarm_steps_agree_with_transitions(spark):
    rows = [(1, "a", 3), (1, "b", 0), (2, "a", 3), (2, "b", 3), (3, "b", 1), (4, "b", 0), (4, "a", 3)]
    df = stored(spark, rows)
    cycles = [df.where(F.col("occur_date") == F.lit(at(s))) for s in range(1, 5)]
    stepped = []
    for before, now in zip([df.limit(0), *cycles], cycles):
        stepped += events(alarms.alarm_step(reports.filter_critical(before), now))
    assert stepped == events(alarms.alarm_transitions(df))
    # The same cycle again announces nothing.
    assert events(alarms.alarm_step(reports.filter_critical(cycles[1]), cycles[1])) == []


def test_alarm_json(spark):
    df = stored(spark, [(1, "a", 3), (2, "b", 0)])
    got = {json.loads(r.value)["type"]: json.loads(r.value) for r in alarms.alarm_json(alarms.alarm_transitions(df)).collect()}
    assert got["ALARM"] == {
        "type": "ALARM", "event_time": "2024-01-01 00:15:00", "ip_addr": "a", "slot_id": 1, "port_id": 1,
        "severity": "CRITICAL", "message": "r1",
    }
    assert got["CLEAR"] == {
        "type": "CLEAR", "event_time": "2024-01-01 00:30:00", "ip_addr": "a", "slot_id": 1, "port_id": 1,
        "message": "Alarm cleared",
    }


def test_top_alarms_keeps_the_newest_per_port(spark):
    df = stored(spark, [(s, f"p{s % 40:02d}", 3) for s in range(80)])
    got = alarms.top_alarms(alarms.alarm_transitions(df)).collect()
    assert [r.event_time for r in got] == [at(s) for s in range(79, 49, -1)]


def test_port_summary_takes_the_first_of_equally_frequent_reasons(spark):
    rows = [(1, "a", 1, {"reason": "z"}), (2, "a", 2, {"reason": "m"}), (3, "a", 3, {"reason": "m"}), (4, "a", 1, {"reason": "z"}), (5, "b", 0)]
    got = reports.port_summary(stored(spark, rows)).collect()
    assert [(r.ip_addr, r.anomalies, r.max_score, r.primary_reason) for r in got] == [("a", 4, 3.0, "m")]


def test_snapshot_reports(spark):
    rows = [
        (1, "old", 3),
        (2, "a", 3),
        (2, "b", 1, {"slope": 2.0, "slope_label": "RISING"}),
        (2, "c", 0, {"slope": 3.0, "slope_label": "RISING", "severity": 30.0}),
        (2, "d", 3, {"slope": 4.0, "slope_label": "RISING"}),
    ]
    df = stored(spark, rows)
    assert [r.ip_addr for r in reports.current_anomalies(df).collect()] == ["d", "a", "c", "b"]
    assert [r.ip_addr for r in reports.watchlist(df).collect()] == ["c", "b"]
    assert {r.ip_addr for r in reports.active_criticals(df).collect()} == {"a", "d"}
    assert tuple(reports.kpi_counts(df).first()) == (3, 2)
    assert reports.current_anomalies(df).first().occur_date == "2024-01-01 00:30:00"


def test_pages_cover_everything_once(spark):
    df = stored(spark, [(s, f"p{s}", 0) for s in range(23)])
    pages = [[r.ip_addr for r in reports.paginate(df, ["occur_date"], p).collect()] for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 3, 0] and len(set(sum(pages, []))) == 23


# --- stored table ----------------------------------------------------------------------------------


def test_missing_columns_get_table_defaults(spark):
    df = spark.createDataFrame([(at(0), "a", 1, 1)], "occur_date timestamp_ntz, ip_addr string, cid int, lid int")
    row = sinks.ensure_schema(df, START).first()
    assert (row.tx_packet, row.severity, row.is_anomaly, row.slope_label, row.alarm_label) == (0, 0.0, False, "STABLE", "NORMAL")
    assert row.ttf_minutes is None and row.detect_time == START


def test_sanitize(spark):
    bad = stored(spark, [(0, "a", 0)]).withColumns(
        {"severity": F.lit(float("nan")), "slope": F.lit(float("-inf")), "tx_packet": F.lit(None).cast("long"),
         "anomaly_reason": F.lit(None).cast("string"), "is_anomaly": F.lit(None).cast("boolean"),
         "ttf_minutes": F.lit(float("nan"))}
    )
    row = sinks.sanitize(bad).first()
    assert (row.severity, row.slope, row.tx_packet, row.anomaly_reason, row.is_anomaly) == (0.0, 0.0, 0, "", False)
    assert row.ttf_minutes is None


def table(spark, path):
    return sorted((r.occur_date, r.ip_addr, r.alarm_level) for r in sinks.read_results(spark, path).collect())


def test_upsert_is_idempotent_and_replaces(spark, tmp_path):
    path = str(tmp_path / "results")
    first = stored(spark, [(0, "a", 1), (0, "b", 0), (9, "a", 2)])
    sinks.upsert_results(first, path, START)
    before = table(spark, path)
    sinks.upsert_results(first, path, START)
    assert table(spark, path) == before and len(before) == 3
    sinks.upsert_results(stored(spark, [(0, "b", 3), (1, "c", 0)]), path, START)
    assert table(spark, path) == [(at(0), "a", 1), (at(0), "b", 3), (at(1), "c", 0), (at(9), "a", 2)]


def test_retention_drops_hours_and_cuts_the_edge(spark, tmp_path):
    path = str(tmp_path / "results")
    sinks.upsert_results(stored(spark, [(s, "a", 0) for s in range(12)]), path, START)
    as_of = at(6) + timedelta(days=30)
    sinks.expire_results(spark, path, as_of)
    assert [t for t, _, _ in table(spark, path)] == [at(s) for s in range(6, 12)]
    assert sinks.stored_hours(spark, path) == ["2024-01-01-01", "2024-01-01-02"]


def test_queries_read_only_the_hours_they_need(spark, tmp_path):
    path = str(tmp_path / "results")
    sinks.upsert_results(stored(spark, [(s, "a", 3) for s in range(12)]), path, START)
    df = sinks.read_results(spark, path)
    assert [r.occur_date for r in reports.current_anomalies(df).collect()] == ["2024-01-01 02:45:00"]
    history = reports.port_history(df, "a", 1, 1, at(11), 1)
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(occur_hour" in plan and "PushedFilters: [IsNotNull(ip_addr)" in plan
    sql = "select count(*) as n from {results} where alarm_level >= :level"
    assert sinks.results_sql(spark, path, sql, level=3).first().n == 12


def rows_scanned(df):
    """Rows that the scan below a plan without exchanges hands on."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().get("numOutputRows").get().value()


def test_history_of_a_port_skips_the_pages_of_other_ports(spark, tmp_path):
    path = str(tmp_path / "results")
    numbers = spark.range(100_000).select(
        F.lit(at(0)).alias("occur_date"), F.format_string("10.%06d", F.col("id") * 7919 % 100_000 * 2).alias("ip_addr"), F.lit(1).alias("cid"), F.lit(1).alias("lid")
    )
    sinks.upsert_results(numbers, path, START)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 30))
    try:
        table = sinks.read_results(spark, path)
        assert table.count() == 100_000
        held = reports.filter_port_history(table, "10.100000", 1, 1, at(1))
        assert held.count() == 1 and rows_scanned(held) <= 40_000  # at most two pages of five
        absent = reports.filter_port_history(table, "10.100001", 1, 1, at(1))
        assert absent.count() == 0 and rows_scanned(absent) == 0  # within the range of values, not in the filter
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_history_repeats_replace_their_own_files(spark, tmp_path):
    path = str(tmp_path / "history")
    df = stored(spark, [(0, "a", 0), (0, "b", 0)])
    for cycle in (0, 0, 1):
        sinks.append_history(df, path, START, cycle)
    assert raw.read_csv(spark, f"{path}/run_date=20240101/cycle=*", RESULT_SCHEMA).count() == 4


def test_report_and_split_files(spark, tmp_path):
    df = traffic_rows(spark, [(i, 1.0, 2.0, 0.0) for i in (3, 1, 2)])
    sinks.write_split(df, str(tmp_path / "train"))
    got = raw.read_csv(spark, str(tmp_path / "train"), df.schema).collect()
    assert [r.occur_date for r in got] == [at(1), at(2), at(3)]
    sinks.write_report(stored(spark, [(0, "a", 0)]), str(tmp_path / "report"))
    assert raw.read_csv(spark, str(tmp_path / "report"), RESULT_SCHEMA).columns == list(RESULT_COLS)


# --- sources and splits ----------------------------------------------------------------------------


def test_hourly_dataset_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "optical")
    df = spark.createDataFrame([(at(s), "a", 1, 1, -5.0, -6.0) for s in range(40)], OPTICAL_SCHEMA)
    raw.write_hourly(df, path)
    got = raw.read_optical(spark, path, at(5.5), at(13))
    assert [r.occur_date for r in got.orderBy("occur_date").collect()] == [at(s) for s in range(6, 14)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "pm_hour" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(occur_date" in plan.split("PushedFilters: [")[1]


def test_hours_and_texts_do_not_depend_on_the_session_zone(spark, tmp_path):
    # 02:30 does not exist in New York on this day.
    gap = datetime(2024, 3, 10, 2, 30)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(gap, "a", 1, 1, -5.0, -6.0)], OPTICAL_SCHEMA)
        raw.write_hourly(df, str(tmp_path / "o"))
        got = raw.read_optical(spark, str(tmp_path / "o"), gap, gap)
        assert [r.occur_date for r in got.collect()] == [gap]
        assert reports.format_times(got, "occur_date").first().occur_date == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_scan_traffic_renames_and_filters(spark):
    rows = [(at(0), "a", 1, 1, 6, 7, 8, 9), (at(1), "a", 1, 1, 44, 7, 8, 9)]
    got = raw.scan_traffic(spark.createDataFrame(rows, TRAFFIC_RAW_SCHEMA), at(0), at(5))
    assert [f.name for f in got.schema] == TRAFFIC_SCHEMA.names
    assert [tuple(r)[4:] for r in got.collect()] == [(7, 8, 9)]


def test_hour_tables_include_the_last_hour():
    start, end = datetime(2024, 1, 1, 10, 50), datetime(2024, 1, 1, 12, 5)
    assert raw.hour_tables("pm_", start, end) == [f"pm_2024_01_01_{h}" for h in (10, 11, 12)]
    queries = raw.traffic_queries("pm_", start, end, existing=["pm_2024_01_01_11"])
    assert len(queries) == 1 and "es AS tx_packet" in queries[0] and "signal_type = 6" in queries[0]
    assert len(raw.optical_queries("pm_", start, end)) == 3


def test_shard_union(spark):
    assert raw.shard_union([]) is None
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    assert sorted(map(tuple, raw.shard_union([a, b]).collect())) == [(1, None), (2, 3)]


def test_splits_include_the_last_day(spark):
    last = datetime(2024, 2, 7, 23, 59, 59)
    df = spark.createDataFrame([(START,), (datetime(2024, 1, 31, 8),), (last,)], "occur_date timestamp_ntz")
    train, test = splits.split_by_dates(df, *splits.split_days(last))
    assert train.count() == 2 and {r[0] for r in test.collect()} == {datetime(2024, 1, 31, 8), last}
    labelled = {r.occur_date: r.split for r in splits.split_by_cutoff(df, last, 60).collect()}
    assert labelled == {START: "train", datetime(2024, 1, 31, 8): "test", last: "test"}
    gate = splits.min_sample_gate(train).first()
    assert (gate.rows, gate.required, gate.enough) == (2, 12, False)


# --- settings --------------------------------------------------------------------------------------


def test_settings_resolve_over_defaults_and_newest_wins(spark, tmp_path):
    path = str(tmp_path / "config")
    config.write_config(config.config_row(spark, "traffic", 1, threshold=0.4, samples_used=99), path)
    versions = config.read_config(spark, path)
    assert config.track_settings(versions)["traffic"] == config.TrackSettings(0.4, 1.0, 90.0, 12)
    config.write_config(config.override_config(versions, "traffic", threshold=0.7, slope_threshold=2.0), path)
    got = config.track_settings(config.read_config(spark, path))
    assert got == {"traffic": config.TrackSettings(0.7, 2.0, 90.0, 12)}
    with pytest.raises(ValueError):
        config.override_config(versions, "traffic", speed=1)


def test_a_track_without_threshold_is_skipped(spark):
    assert config.track_settings(config.config_row(spark, "optical", 1)) == {}


def test_model_status_lists_tracks_without_a_model(spark):
    got = {r.track: r for r in config.model_status(spark, config.config_row(spark, "optical", 1, threshold=0.4, trained_at=START)).collect()}
    assert got["optical"].exists and got["optical"].last_trained == START and got["optical"].threshold == 0.4
    assert not got["traffic"].exists and got["traffic"].threshold == 0.1 and got["traffic"].samples_used == 0
