"""Detection as a stream of ticks: every tick of the clock is one cycle.

A tick only says that it is time, and what time it is.  The cycle reads the trailing slots of both tracks up to
that time and runs the batch plan on them, so a track that stays silent, or a device whose clock is wrong, never
decides when or as of when the others are judged.  Readings dated after the tick wait in their hour folders and
are counted as quarantined, like readings without a time or a port.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from portvigil.operators.alarms import alarm_json, alarm_step
from portvigil.operators.clean import quarantine
from portvigil.operators.config import TrackSettings
from portvigil.operators.reports import cycle_counts, filter_critical, max_slot
from portvigil.operators.scoring import Scorer
from portvigil.operators.sinks import append_history, expire_results, upsert_results
from portvigil.operators.windows import Scaler
from portvigil.plans.detect import detect
from portvigil.sources.raw import HOUR_COL, hours_of, read_hours, scan_optical, scan_traffic, write_hourly
from portvigil.spec import (
    INTERVAL_MINUTES,
    KEYS,
    OPTICAL,
    OPTICAL_SCHEMA,
    RETENTION_DAYS,
    TRAFFIC,
    TRAFFIC_RAW_SCHEMA,
    TREND_SLOTS,
    WINDOW_SIZE,
)
from portvigil.storage import materialized, partition_values

LOG_DAY = "event_day"
LOG_SCHEMA = (
    "type string, event_time timestamp_ntz, ip_addr string, slot_id int, port_id int, value string, "
    f"{LOG_DAY} string, cycle string"
)
OPEN_SCHEMA = "ip_addr string, cid int, lid int, occur_date timestamp_ntz"
TICK = "cycle_time"
TICK_SCHEMA = f"{TICK} timestamp_ntz"

Callback = Callable[[DataFrame, DataFrame], None]


@dataclass(frozen=True)
class CycleConfig:
    """Where a deployment keeps its data and how it judges it."""

    traffic_path: str
    optical_path: str
    results_path: str
    history_path: str
    alarms_path: str
    open_path: str
    scalers: dict[str, Scaler]
    settings: Callable[[], dict[str, TrackSettings]]
    scorers: dict[str, Scorer] = field(default_factory=dict)
    interval_minutes: int = INTERVAL_MINUTES
    retention_days: int = RETENTION_DAYS
    latest_only: bool = True
    callback: Callback | None = None

    @property
    def look_back(self) -> timedelta:
        return timedelta(minutes=(WINDOW_SIZE + TREND_SLOTS) * self.interval_minutes)


def cycle_name(at: datetime) -> str:
    """Cycles are named, and ordered, by their time; a new checkpoint goes on with the same names."""
    return f"{at:%Y%m%d%H%M%S}"


def open_alarms(spark: SparkSession, path: str, cycles: list[str], cycle: str) -> DataFrame:
    """Ports that were critical in the newest cycle before this one, with their slot."""
    before = [c for c in cycles if c < cycle]
    if not before:
        return spark.createDataFrame([], OPEN_SCHEMA)
    return spark.read.schema(OPEN_SCHEMA).parquet(f"{path}/cycle={before[-1]}")


def quarantined(traffic: DataFrame, optical: DataFrame, at: datetime) -> int:
    """Readings of both tracks that no plan can use as of ``at``: without time or port, or dated later."""
    rejected = [quarantine(rows, spec, at).select("occur_date") for rows, spec in ((traffic, TRAFFIC), (optical, OPTICAL))]
    return rejected[0].unionByName(rejected[1]).count()


def run_cycle(spark: SparkSession, config: CycleConfig, at: datetime) -> Row | None:
    """The cycle of time ``at``: fetch, detect, raise and clear alarms, store, expire, log.

    Gives the processed, anomalous and quarantined rows; None without valid data, and None for a cycle that is
    older than the newest one that ran, since alarms are decided in order.  Safe to repeat: results are upserted,
    alarms are decided by the open alarms of the cycle before, and all files of the cycle are replaced.  Rows
    expire by ``at``, never by the time of a reading.
    """
    cycle = cycle_name(at)
    cycles = partition_values(spark, config.open_path, "cycle")
    if cycles and cycles[-1] > cycle:
        return None
    start = at - config.look_back
    # the look-back's hours and later ones, listed once per track for detection and quarantine
    traffic = read_hours(spark, config.traffic_path, TRAFFIC_RAW_SCHEMA, start)
    optical = read_hours(spark, config.optical_path, OPTICAL_SCHEMA, start)
    found = detect(
        scan_traffic(traffic, start, at),
        scan_optical(optical, start, at),
        config.scalers,
        config.settings(),
        config.scorers,
        config.interval_minutes,
        latest_only=False,
    )
    if found is None:
        return None
    # the look-back's verdicts are evaluated once; the newest slot is then a filter on what was written
    with materialized(found, "cycle") as judged:
        slot = max_slot(judged).first()[0]
        if slot is None:
            return None
        now = judged.where(F.col("occur_date") == F.lit(slot))
        results = now if config.latest_only else judged
        counts = cycle_counts(results).first()
        step = alarm_step(open_alarms(spark, config.open_path, cycles, cycle), now)
        with materialized(step, "events") as events:
            alarm_json(events).write.mode("overwrite").json(f"{config.alarms_path}/{LOG_DAY}={slot:%Y%m%d}/cycle={cycle}")
            upsert_results(results, config.results_path, at)
            expire_results(spark, config.results_path, at, config.retention_days)
            if config.callback:
                config.callback(results, events)
        append_history(results, config.history_path, at, cycle)
        still_open = filter_critical(now).select(*KEYS, "occur_date")
        still_open.write.mode("overwrite").parquet(f"{config.open_path}/cycle={cycle}")  # last: the cycle is complete
    return Row(**counts.asDict(), quarantined=quarantined(traffic, optical, at))


def clock(spark: SparkSession, interval_minutes: int = INTERVAL_MINUTES) -> DataFrame:
    """Ticks of the wall clock, cut to the interval."""
    seconds = 60 * interval_minutes
    tick = F.timestamp_seconds(F.floor(F.unix_timestamp("timestamp") / seconds) * seconds)
    return spark.readStream.format("rate").load().select(tick.cast("timestamp_ntz").alias(TICK))


def write_ticks(spark: SparkSession, times: list[datetime], path: str) -> None:
    """Ticks of a replay, one file each, for ``replay_clock``."""
    for number, time in enumerate(times):
        tick = spark.createDataFrame([(time,)], TICK_SCHEMA).coalesce(1)
        tick.write.mode("append").parquet(f"{path}/part={number:06d}")


def replay_clock(spark: SparkSession, path: str, ticks_per_trigger: int = 1) -> DataFrame:
    files = spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", ticks_per_trigger)
    return files.option("recursiveFileLookup", "true").parquet(path)


def detect_stream(
    spark: SparkSession, config: CycleConfig, checkpoint: str, ticks: DataFrame | None = None, **trigger
) -> StreamingQuery:
    """Start the stream; by default it fires once per interval of the wall clock.

    ``ticks`` is a stream of ``cycle_time``; a micro-batch with several ticks runs their cycles in order.
    ``latest_only=False`` in ``config`` stores the verdicts of the whole look-back.
    """
    wall = ticks is None
    ticks = clock(spark, config.interval_minutes) if wall else ticks

    def run(batch: DataFrame, _: int) -> None:
        times = sorted(r[0] for r in batch.select(TICK).distinct().collect() if r[0] is not None)
        for time in times[-1:] if wall else times:  # of missed wall-clock ticks the last says all
            run_cycle(batch.sparkSession, config, time)

    trigger = trigger or {"processingTime": f"{config.interval_minutes} minutes"}
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest(batch: DataFrame, path: str, rejected_path: str) -> None:
    """Append readings that are not stored yet, however late they come; repeated deliveries are dropped.

    Only the hours that the batch touches are read.  Of readings with one port and time the first delivery
    stays; within a batch the one of largest metrics.  Readings without time or port go to ``rejected_path``.
    Running a batch again changes nothing but that folder.
    """
    spark = batch.sparkSession
    keys = ("occur_date", *KEYS)
    plain = [c for c in batch.columns if c != HOUR_COL]
    metrics = [c for c in plain if c not in keys]
    missing: Column = F.lit(False)
    for key in keys:
        missing |= F.col(key).isNull()
    with materialized(batch.select(*plain), "arrived") as arrived:
        unusable = arrived.where(missing)
        if not unusable.isEmpty():
            unusable.write.mode("append").parquet(rejected_path)
        kept = arrived.where(~missing).groupBy(*keys).agg(F.max(F.struct(*metrics)).alias("m")).select(*keys, "m.*")
        hours = [r[0] for r in arrived.where(~missing).select(F.date_format("occur_date", "yyyy-MM-dd-HH")).distinct().collect()]
        touched = sorted(set(hours) & set(partition_values(spark, path, HOUR_COL)))
        if touched:
            stored = hours_of(spark, path, arrived.schema, touched)
            kept = kept.join(stored.select(*keys), list(keys), "left_anti")
        with materialized(kept.select(*plain), "new") as new:
            write_hourly(new, path)


def ingest_stream(raw: DataFrame, path: str, rejected_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Raw readings as they arrive into the hourly dataset."""
    writer = raw.writeStream.foreachBatch(lambda batch, _: ingest(batch, path, rejected_path))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
