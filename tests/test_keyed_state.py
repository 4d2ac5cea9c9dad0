"""Streams with keyed state, and the revision of stored verdicts, against their batch forms."""

import pytest
from pyspark.sql import functions as F

from portvigil.operators import alarms, sinks, windows
from portvigil.operators.config import TrackSettings
from portvigil.plans.detect import detect
from portvigil.spec import KEYS, OPTICAL, TRACKS, TRAFFIC, TREND_SLOTS
from portvigil.streaming import alarm_transitions, revision, window_state
from portvigil.streaming.cycle import ingest
from portvigil.streaming.state import PROVIDER_CONF, to_parquet

from tests.helpers import START, at, optical_rows

SCALED = "ip_addr string, cid int, lid int, slot_idx long, tx_avg_power double, rx_avg_power double, z_tx_avg_power double, z_rx_avg_power double"


def stream_of(spark, frames, path):
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{path}/part={i}")
    reader = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1)
    return reader.option("recursiveFileLookup", "true").parquet(str(path))


def scaled(spark, slots, ip="a"):
    return spark.createDataFrame([(ip, 1, 1, s, float(s), None if s % 41 == 40 else 1.0, s / 2, s / 3) for s in slots], SCALED)


def test_windows_of_the_stream_equal_those_of_the_batch(spark, tmp_path):
    slots = [s for s in range(60) if s not in (20, 21)]  # a gap, and a missing metric at 40
    arrival = {s: s + (s * 7) % (TREND_SLOTS + 1) for s in slots}
    parts = [[s for s in slots if low <= arrival[s] < low + 16] for low in range(0, 80, 16)]
    parts = [p + p[:2] for p in parts if p]  # some come twice
    frames = [scaled(spark, p).unionByName(scaled(spark, p[::-1], "b")) for p in parts]
    before = spark.conf.get(PROVIDER_CONF, None)
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    first = window_state.window_stream(stream_of(spark, frames[:2], tmp_path / "in"), OPTICAL)
    to_parquet(first, out, log, availableNow=True).awaitTermination(300)
    for i, frame in enumerate(frames[2:], 2):
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    again = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    to_parquet(window_state.window_stream(again.parquet(str(tmp_path / "in")), OPTICAL), out, log, availableNow=True).awaitTermination(300)
    assert spark.conf.get(PROVIDER_CONF, None) == before
    whole = scaled(spark, slots).unionByName(scaled(spark, slots, "b"))
    want = windows.sliding_windows(whole, OPTICAL)
    got = spark.read.schema(want.schema).parquet(out)
    assert want.count() > 30
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ring_drops_what_is_too_old():
    ring = window_state.Ring(5, [], [])
    assert [ring.add(s, [0.0], 3) for s in (1, 2, 3)] == [[], [], [3]]
    assert ring.add(9, [0.0], 3) == [] and sorted(ring.held) == [9]
    assert ring.add(4, [0.0], 3) == []  # five slots before the newest: gone
    assert ring.add(7, [0.0], 3) == [] and ring.add(8, [0.0], 3) == [9] and ring.add(8, [1.0], 3) == []


RESULTS = "occur_date timestamp_ntz, ip_addr string, cid int, lid int, alarm_level int, alarm_label string, anomaly_reason string"


def result_rows(cycles):
    """``cycles``: slot -> {port: level}."""
    labels = ("NORMAL", "MINOR", "MAJOR", "CRITICAL")
    return [(at(s), ip, 1, 1, level, labels[level], f"r{s}") for s, ports in cycles.items() for ip, level in ports.items()]


CYCLES = {0: {"a": 3, "b": 0}, 1: {"a": 3, "b": 3}, 2: {"b": 3}, 4: {"c": 0}, 5: {"a": 3, "b": 3, "c": 3}, 6: {"a": 0, "c": 3}}


@pytest.mark.parametrize("order", [[[0, 1, 2, 4, 5, 6]], [[0], [1, 2], [4], [5, 6]], [[5, 6], [0, 2], [4], [1]]])
def test_events_of_the_stream_equal_those_of_the_batch(spark, tmp_path, order):
    frames = [spark.createDataFrame(result_rows({s: CYCLES[s] for s in part}), RESULTS) for part in order]
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    alarm_transitions.start(stream_of(spark, frames, tmp_path / "in"), out, log, availableNow=True).awaitTermination(300)
    want = alarms.alarm_transitions(spark.createDataFrame(result_rows(CYCLES), RESULTS))
    got = alarm_transitions.standing(spark, out)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_events_go_on_after_a_restart_with_rows_of_a_known_cycle(spark, tmp_path):
    out, log, path = str(tmp_path / "out"), str(tmp_path / "log"), tmp_path / "in"
    first = spark.createDataFrame(result_rows({0: {"a": 3}, 1: {"b": 0}}), RESULTS)
    alarm_transitions.start(stream_of(spark, [first], path), out, log, availableNow=True).awaitTermination(300)
    assert {r.type for r in alarm_transitions.standing(spark, out).collect()} == {"ALARM", "CLEAR"}
    spark.createDataFrame(result_rows({1: {"a": 3}}), RESULTS).coalesce(1).write.parquet(str(path / "part=1"))
    again = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(str(path))
    alarm_transitions.start(again, out, log, availableNow=True).awaitTermination(300)
    assert [r.type for r in alarm_transitions.standing(spark, out).collect()] == ["ALARM", "ALARM"]  # the clear is withdrawn
    changes = spark.read.parquet(out).groupBy("change").count().collect()
    assert {r.change: r["count"] for r in changes} == {1: 3, -1: 1}


def test_ranges_that_meet_are_merged(spark):
    slots = spark.createDataFrame([("a", 1, 1, s) for s in (5, 5, 9, 40)] + [("b", 1, 1, 7)], "ip_addr string, cid int, lid int, slot_idx long")
    found = revision.merged_ranges(slots, 1, 3).orderBy("ip_addr", "first").collect()
    assert [(r.ip_addr, r.first, r.last) for r in found] == [("a", 4, 12), ("a", 39, 43), ("b", 6, 10)]


def test_verdicts_do_not_depend_on_the_order_of_delivery(spark, tmp_path):
    traffic_cols = "occur_date timestamp_ntz, ip_addr string, cid int, lid int, signal_type int, bbe_in_error long, es long, ses long"
    optical_cols = "occur_date timestamp_ntz, ip_addr string, cid int, lid int, tx_avg_power double, rx_avg_power double"
    import portvigil.spec as spec

    slots = [s for s in range(60) if s not in (17, 30, 31, 32) and not 46 <= s <= 51]
    values = {"signal_type": 6, "bbe_in_error": lambda s: s % 3, "es": lambda s: 100 + (s * 37) % 50, "ses": lambda s: 90 + (s * 11) % 40}
    fields = [f.name for f in spec.TRAFFIC_RAW_SCHEMA.fields]
    traffic = [
        tuple({"occur_date": at(s), "ip_addr": ip, "cid": 1, "lid": 1}.get(f, v(s) if callable(v := values.get(f)) else v) for f in fields)
        for ip in ("10.0.0.1", "b@c") for s in slots
    ]
    optical = [(at(s), "10.0.0.1", 1, 1, -5.0 - (s * 13) % 7 / 10, -8.0 - (s * 5) % 9 / 10) for s in slots if s % 11]
    scalers = {TRAFFIC.name: {f: (0.0, 1.0) for f in TRAFFIC.features}, OPTICAL.name: {f: (0.0, 1.0) for f in OPTICAL.features}}
    settings = {t: TrackSettings(5.0, 0.05, 90.0) for t in TRACKS}

    def stored(name, parts):
        paths = [str(tmp_path / f"{name}-{n}") for n in ("traffic", "optical", "results", "rejected")]
        for part in parts:
            rows = [
                spark.createDataFrame([r for r in traffic if part(r[0])], spec.TRAFFIC_RAW_SCHEMA),
                spark.createDataFrame([r for r in optical if part(r[0])], spec.OPTICAL_SCHEMA),
            ]
            marked = [revision.slots_of(scan, s) for scan, s in ((revision.scan_traffic(rows[0]), TRAFFIC), (revision.scan_optical(rows[1]), OPTICAL))]
            for frame, path in zip(rows, paths):
                ingest(frame, path, paths[3])
            revision.revise(spark, marked[0].unionByName(marked[1]), *paths[:3], scalers, settings, detect_time=START)
        table = sinks.read_results(spark, paths[2]).drop("occur_hour")
        return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in table.collect()), table

    late = {at(s) for s in (3, 14, 15, 29, 44, 52)}
    once, table = stored("once", [lambda t: True])
    assert stored("late", [lambda t: t not in late, lambda t: t in late, lambda t: t in late])[0] == once
    whole = detect(revision.scan_traffic(spark.createDataFrame(traffic, spec.TRAFFIC_RAW_SCHEMA)),
                   revision.scan_optical(spark.createDataFrame(optical, spec.OPTICAL_SCHEMA)), scalers, settings, latest_only=False)
    columns = ["occur_date", *KEYS, "anomaly_score", "severity", "is_anomaly", "anomaly_reason"]
    key = lambda df: sorted(str((*r[:4], round(r[4], 9), round(r[5], 6), *r[6:])) for r in df.select(*columns).collect())
    bridged = whole.where(F.col("occur_date") != F.lit(at(46)))  # judged by the batch alone: more than REACH slots are missing
    assert whole.count() > bridged.count() and key(table) == key(bridged) and len(once) > 40


def test_a_slot_is_laid_out_once_per_verdict_however_many_readings_it_has(spark):
    first = 1_893_408  # slot of START
    readings = optical_rows(spark, [(s + i / 100, -5.0 - i, -8.0) for s in range(3) for i in range(-40, 41)])
    verdicts = spark.createDataFrame([("10.0.0.1", 1, 1, s + first) for s in (1, 2)], "ip_addr string, cid int, lid int, slot_idx long")
    laid = revision._laid_out(readings, OPTICAL, verdicts, 16, 15).collect()
    # the last reading of each slot, for both verdicts
    assert sorted((r.ip_addr, r.occur_date, r.tx_avg_power) for r in laid) == [
        (f"10.0.0.1@{v + first}", at(s), -45.0) for v in (1, 2) for s in range(3)
    ]
