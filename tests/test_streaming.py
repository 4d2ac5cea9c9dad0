import json
import os
import time
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from portvigil.operators import alarms, sinks
from portvigil.operators.config import TrackSettings
from portvigil.operators.reports import latest_in_table
from portvigil.plans.detect import detect
from portvigil.sources import raw
from portvigil.spec import OPTICAL, OPTICAL_SCHEMA, STANDARD_COLS, TRAFFIC, TRAFFIC_RAW_SCHEMA
from portvigil.streaming import alarm_state, cycle
from tests.helpers import OPTICAL_ROWS, START, at
from tests.test_results import events, stored

SCALERS = {t.name: {f: (0.0, 1.0) for f in t.features} for t in (TRAFFIC, OPTICAL)}
SETTINGS = {"traffic": TrackSettings(0.05), "optical": TrackSettings(0.8)}


@pytest.fixture()
def readings(spark):
    """Forty slots of two ports; port ``b`` stops early."""
    rng = np.random.default_rng(8)
    traffic, optical = [], []
    for s in range(40):
        for ip in ("a", "b") if s < 30 else ("a",):
            tx, power = int(rng.integers(10, 10**5)), float(rng.normal(-8, 1.5))
            traffic.append((at(s), ip, 1, 1, 6, int(rng.integers(0, 3)), tx, tx))
            optical.append((at(s), ip, 1, 1, power, power - 2))
    return spark.createDataFrame(traffic, TRAFFIC_RAW_SCHEMA), spark.createDataFrame(optical, OPTICAL_SCHEMA)


def only(df, s):
    return df.where(F.col("occur_date") == F.lit(at(s)))


def config(tmp_path, **more):
    paths = {f"{n}_path": str(tmp_path / n) for n in ("traffic", "optical", "results", "history", "alarms", "open")}
    return cycle.CycleConfig(**paths, scalers=SCALERS, settings=lambda: SETTINGS, **more)


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*STANDARD_COLS).collect())


def test_stream_equals_batch_cycle_by_cycle(spark, tmp_path, readings):
    traffic, optical = readings
    seen = []
    conf = config(tmp_path, callback=lambda results, events: seen.append((results.count(), events.count())))
    raw.write_hourly(traffic, conf.traffic_path)
    raw.write_hourly(optical, conf.optical_path)
    slots = list(range(27, 33))
    cycle.write_ticks(spark, [at(s) for s in slots], str(tmp_path / "ticks"))
    for checkpoint in ("first", "fresh"):  # a new checkpoint repeats all cycles and changes nothing
        ticks = cycle.replay_clock(spark, str(tmp_path / "ticks"), 2)
        query = cycle.detect_stream(spark, conf, str(tmp_path / checkpoint), ticks, availableNow=True)
        query.awaitTermination()
    batch = None
    for s in slots:
        window = [raw.filter_time_range(d, at(s) - conf.look_back, at(s)) for d in (traffic, optical)]
        found = detect(raw.scan_traffic(window[0]), window[1], SCALERS, SETTINGS)
        found = sinks.sanitize(sinks.ensure_schema(found, START))
        batch = found if batch is None else batch.unionByName(found)
    stored_rows = sinks.read_results(spark, conf.results_path)
    assert rows(stored_rows) == rows(batch) and len(rows(batch)) == 3 * 2 + 3
    assert [n for n, _ in seen] == [2, 2, 2, 1, 1, 1, 1]  # of the repeat only the newest cycle runs again
    log = spark.read.schema(cycle.LOG_SCHEMA).json(conf.alarms_path)
    got = sorted((json.loads(r.value)["event_time"], json.loads(r.value)["type"]) for r in log.collect())
    want = sorted((str(t), kind) for t, kind, _ in events(alarms.alarm_transitions(stored_rows)))
    assert got == want and got
    logged = raw.read_csv(spark, f"{conf.history_path}/run_date=*/cycle=*", batch.schema)
    assert logged.count() == len(rows(batch))


def sent(spark, conf):
    log = spark.read.schema(cycle.LOG_SCHEMA).json(conf.alarms_path)
    return sorted((r.cycle, r.type, r.ip_addr) for r in log.collect())


@pytest.mark.parametrize("latest_only", [True, False])
def test_alarms_survive_repeats_and_cycles_without_news(spark, tmp_path, readings, latest_only):
    traffic, optical = readings
    quiet = {n: TrackSettings(1e9) for n in SETTINGS}
    loud = {n: TrackSettings(1e-9) for n in SETTINGS}
    level = dict(quiet)
    conf = config(tmp_path, latest_only=latest_only)
    conf = cycle.CycleConfig(**{**conf.__dict__, "settings": lambda: dict(level)})
    raw.write_hourly(traffic, conf.traffic_path)
    raw.write_hourly(optical, conf.optical_path)
    expected = []
    # raised, repeated after a failure, quiet, the quiet cycle repeated, raised again, an older cycle, quiet
    for slot, settings, news in (
        (20, loud, ["ALARM", "ALARM"]),
        (20, loud, None),
        (22, quiet, ["CLEAR", "CLEAR"]),
        (22, quiet, None),
        (23, loud, ["ALARM", "ALARM"]),
        (21, quiet, None),
        (24, quiet, ["CLEAR", "CLEAR"]),
        (25, quiet, []),
    ):
        level.clear()
        level.update(settings)
        cycle.run_cycle(spark, conf, at(slot))
        expected += [(cycle.cycle_name(at(slot)), kind, ip) for kind, ip in zip(news or [], "ab")]
        assert sent(spark, conf) == expected
    assert cycle.run_cycle(spark, conf, at(500)) is None


def test_a_wrong_device_clock_changes_nothing_for_others(spark, tmp_path, readings):
    traffic, optical = readings
    conf = config(tmp_path)
    raw.write_hourly(traffic, conf.traffic_path)
    raw.write_hourly(optical, conf.optical_path)
    ahead = spark.createDataFrame([(at(s + 40_000), "z", 1, 1, -8.0, -9.0) for s in range(16)], OPTICAL_SCHEMA)
    raw.write_hourly(ahead.unionByName(ahead.limit(1).selectExpr("cast(null as timestamp_ntz) as occur_date", "ip_addr", "cid", "lid", "tx_avg_power", "rx_avg_power")), conf.optical_path)
    cycle.run_cycle(spark, conf, at(20))
    counts = cycle.run_cycle(spark, conf, at(21))
    stored_rows = sinks.read_results(spark, conf.results_path)
    assert sorted((r.ip_addr, r.occur_date) for r in stored_rows.collect()) == [(ip, at(s)) for ip in "ab" for s in (20, 21)]
    later = 2 * 18  # readings of both tracks that are dated after the cycle: slots 22 to 39, port b until 29
    assert counts.quarantined == 16 + 1 + later + 2 * 8


def test_optical_is_judged_when_traffic_is_silent(spark, tmp_path, readings):
    _, optical = readings
    conf = config(tmp_path)
    raw.write_hourly(only(readings[0], 0), conf.traffic_path)
    raw.write_hourly(optical, conf.optical_path)
    counts = cycle.run_cycle(spark, conf, at(25))
    assert counts.processed == 2


def test_late_port_is_added_when_the_look_back_is_revised(spark, tmp_path, readings):
    traffic, optical = readings
    conf = config(tmp_path, latest_only=False)
    late = (F.col("ip_addr") == "b") & (F.col("occur_date") == F.lit(at(20)))
    for df, path in ((traffic, conf.traffic_path), (optical, conf.optical_path)):
        raw.write_hourly(df.where(~late), path)
    cycle.run_cycle(spark, conf, at(20))
    at_20 = F.col("occur_date") == F.lit(at(20))
    assert sinks.read_results(spark, conf.results_path).where(at_20).count() == 1
    for df, path in ((traffic, conf.traffic_path), (optical, conf.optical_path)):
        raw.write_hourly(df.where(late), path)
    cycle.run_cycle(spark, conf, at(21))
    assert sinks.read_results(spark, conf.results_path).where(at_20).count() == 2


@pytest.mark.parametrize("files", [1, 100])
def test_alarm_state_stream_agrees_with_batch(spark, tmp_path, files):
    script = [
        (1, "a", 3), (1, "b", 0), (2, "a", 3), (2, "b", 3), (3, "b", 1), (4, "b", 0), (5, "a", 3), (5, "b", 3), (6, "b", 3), (7, "c", 0),
    ]
    df = stored(spark, script)
    path = str(tmp_path / "results")
    for i, s in enumerate(sorted({s for s, *_ in script})):
        only(df, s).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > time.time() - 10**6:
                os.utime(full, (10**9 + i, 10**9 + i))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
    out = str(tmp_path / "alarms")
    alarm_state.alarm_state_stream(source, out, str(tmp_path / "ckpt"), availableNow=True).awaitTermination(300)
    assert events(alarm_state.read_events(spark, out)) == events(alarms.alarm_transitions(df))
    before = events(alarm_state.read_events(spark, out))
    alarm_state.alarm_batch(only(df, 2), out, 1000)  # late rows are kept apart
    assert events(alarm_state.read_events(spark, out)) == before
    assert spark.read.parquet(f"{out}/late/batch=000000001000").count() == 2


def test_late_and_repeated_readings_are_stored_once(spark, tmp_path):
    out, rejected = str(tmp_path / "stored"), str(tmp_path / "rejected")
    rows_ = [(at(s), "a", 1, 1, -5.0, -6.0) for s in (100, 100, 101)] + [(None, "a", 1, 1, -5.0, -6.0)]
    cycle.ingest(spark.createDataFrame(rows_, OPTICAL_ROWS), out, rejected)
    late = [(at(s), "a", 1, 1, -5.0, -6.0) for s in (1, 100, 101)]  # a day late, and two again
    cycle.ingest(spark.createDataFrame(late, OPTICAL_ROWS), out, rejected)
    assert sorted(r.occur_date for r in spark.read.parquet(out).collect()) == [at(1), at(100), at(101)]
    assert spark.read.parquet(rejected).count() == 1
    assert timedelta(minutes=240) == config(tmp_path).look_back
