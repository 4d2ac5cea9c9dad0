"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the cores.  Fitted
parameters are kept for the queries after the fit, as a deployment keeps its trained models.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from portvigil.catalog import queries as Q
from portvigil.catalog.grids import COARSE, FINE
from portvigil.operators.config import TrackSettings
from portvigil.plans.detect import score_track
from portvigil.sources import testviews
from portvigil.sources.raw import write_hourly
from portvigil.spec import TRACKS, TRAFFIC
from portvigil.storage import work_path
from portvigil.streaming.cycle import CycleConfig, run_cycle

HEADLINE = [
    "dedup_last",
    "gap_fill",
    "preprocess",
    "preprocess_train",
    "sliding_windows",
    "score_window_mean",
    "score_track",
    "fuse_tracks_join",
    "detect",
    "detect_latest",
    "alarm_transitions",
    "port_summary",
    "current_anomalies",
    "port_history",
    "history_series",
    "score_reconstruction",
    "detect_reconstruction",
    "sink_upsert",
]


TRIAL_READINGS = 21_000_000
TRIAL_PORTS = 5_000


def generated_readings(spark: SparkSession) -> DataFrame:
    """Twenty days of traffic readings, a third of them from one port."""
    return spark.range(TRIAL_READINGS).selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(xxhash64(id, 1), 20 * 86400)) as occur_date",
        f"if(id % 3 = 0, 'hot', concat('p', pmod(xxhash64(id, 2), {TRIAL_PORTS}))) as ip_addr",
        "1 as cid",
        "1 as lid",
        "pmod(xxhash64(id, 3), 4) as error_packet",
        "pmod(xxhash64(id, 4), 100000) as tx_packet",
        "pmod(xxhash64(id, 5), 100000) as rx_packet",
    )


def trial(spark: SparkSession) -> None:
    scaler = {f: (5.0, 2.0) for f in TRAFFIC.features}
    run(score_track(generated_readings(spark), TRAFFIC, scaler, TrackSettings(1.0)))


def one_cycle(spark: SparkSession, sf: str) -> None:
    """One tick of the stream over stored readings: detect, store, expire, alarms, log."""
    names = ("traffic", "optical", "results", "history", "alarms", "open")
    job = CycleConfig(
        **{f"{n}_path": work_path(spark, n) for n in names},
        scalers=Q.scalers(spark, sf, COARSE),
        settings=lambda: Q.settings(spark, sf, COARSE),
        interval_minutes=COARSE.minutes,
    )
    write_hourly(testviews.traffic_raw(spark, sf), job.traffic_path)
    write_hourly(testviews.optical_raw(spark, sf), job.optical_path)
    run_cycle(spark, job, Q.as_of(spark, sf))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, job) -> None:
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)

    spark.range(1000).groupBy("id").count().collect()
    timed("fit_thresholds", lambda: Q.settings(spark, sf, FINE))
    timed("fit_thresholds_coarse", lambda: Q.settings(spark, sf, COARSE))
    timed("train_models", lambda: [Q.trained(spark, sf, t) for t in TRACKS.values()])
    for name in HEADLINE:
        timed(name, lambda name=name: run(Q.QUERIES[name](spark, sf)))
    timed("stream_cycle", lambda: one_cycle(spark, sf))
    timed("trial_21m_readings", lambda: trial(spark))
    rate = round(TRIAL_READINGS / times["trial_21m_readings"])
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf, "trial_readings_per_sec": rate}))
    spark.stop()


if __name__ == "__main__":
    main()
