"""Registered queries over the given tables.

The metric tracks are views of ``events`` (``sources/testviews.py``).  Detection queries use a 30-minute
grid, on which the small test data has holes, fills and dropped windows; report queries use a 6-hour
grid, on which every port is present in the latest slot.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portvigil.catalog.grids import COARSE, CYCLES, FINE, LOUD, PORT, RANGE, Grid
from portvigil.functions import text as X
from portvigil.functions import times as TM
from portvigil.operators import alarms, clean, config, fusion, moments, reports, scoring, sinks, sketches, splits, trend, windows
from portvigil.plans.detect import detect, score_track
from portvigil.plans.train import load_track, save_track, train_track, training_windows
from portvigil.sources import raw, testviews
from portvigil.spec import (
    DEFAULT_THRESHOLD,
    DETECTION_SCHEMA,
    KEYS,
    OPTICAL,
    OPTICAL_SCHEMA,
    RESULT_SCHEMA,
    STANDARD_COLS,
    TRACKS,
    TRAFFIC,
    TRAFFIC_RAW_SCHEMA,
    TRAFFIC_SCHEMA,
    TREND_SLOTS,
    WINDOW_SIZE,
    TrackSpec,
)
from portvigil.storage import materialized, modified, work_path
from portvigil.streaming import alarm_transitions, revision, window_state
from portvigil.streaming.cycle import CycleConfig, LOG_SCHEMA, detect_stream, ingest, ingest_stream, replay_clock, write_ticks
from portvigil.streaming.state import to_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to a fixed number of digits, so the last bits of a sum do not matter."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def fitted(fn):
    """Keep what was fitted on a table until the table changes."""
    kept: dict = {}

    @wraps(fn)
    def once(spark: SparkSession, sf: str, *args):
        key = (sf, modified(spark, f"{sf}/events.parquet"), *args)
        if key not in kept:
            kept[key] = fn(spark, sf, *args)
        return kept[key]

    return once


# --- shared inputs ---------------------------------------------------------------------------------


def traffic(spark: SparkSession, sf: str) -> DataFrame:
    return raw.scan_traffic(testviews.traffic_raw(spark, sf))


def optical(spark: SparkSession, sf: str) -> DataFrame:
    return raw.scan_optical(testviews.optical_raw(spark, sf))


SOURCES = {TRAFFIC.name: traffic, OPTICAL.name: optical}


@fitted
def as_of(spark: SparkSession, sf: str) -> datetime:
    """The newest reading: the clock of every query."""
    return spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts")).first()[0]


def cutoff(spark: SparkSession, sf: str) -> datetime:
    return splits.cutoff_of(as_of(spark, sf))


def train_rows(spark: SparkSession, sf: str, spec: TrackSpec) -> DataFrame:
    return SOURCES[spec.name](spark, sf).where(F.col("occur_date") < F.expr(TM.ntz(cutoff(spark, sf))))


def train_clean(spark: SparkSession, sf: str, spec: TrackSpec, grid: Grid) -> DataFrame:
    return clean.preprocess(train_rows(spark, sf, spec), spec, grid.minutes, train=True, full_grid=False)


@fitted
def scaler(spark: SparkSession, sf: str, spec: TrackSpec, grid: Grid) -> windows.Scaler:
    return windows.robust_fit(train_clean(spark, sf, spec, grid), spec)


def train_scores(spark: SparkSession, sf: str, spec: TrackSpec, grid: Grid) -> DataFrame:
    scaled = windows.robust_apply(train_clean(spark, sf, spec, grid), spec, scaler(spark, sf, spec, grid))
    return scoring.score_window_mean(scaled, spec)


@fitted
def threshold(spark: SparkSession, sf: str, spec: TrackSpec, grid: Grid) -> float:
    found = scoring.threshold_percentile(train_scores(spark, sf, spec, grid), grid.percentile)
    return DEFAULT_THRESHOLD if found is None else found


def scalers(spark: SparkSession, sf: str, grid: Grid) -> dict[str, windows.Scaler]:
    return {t.name: scaler(spark, sf, t, grid) for t in TRACKS.values()}


def settings(spark: SparkSession, sf: str, grid: Grid) -> dict[str, config.TrackSettings]:
    return {
        t.name: config.TrackSettings(threshold(spark, sf, t, grid), grid.slope_threshold, grid.rul_target)
        for t in TRACKS.values()
    }


def scaled_rows(spark: SparkSession, sf: str, spec: TrackSpec, grid: Grid) -> DataFrame:
    rows = clean.preprocess(SOURCES[spec.name](spark, sf), spec, grid.minutes, full_grid=False)
    return windows.robust_apply(rows, spec, scaler(spark, sf, spec, grid))


def scored(spark: SparkSession, sf: str, spec: TrackSpec, grid: Grid) -> DataFrame:
    return scoring.score_window_mean(scaled_rows(spark, sf, spec, grid), spec)


def judged(spark: SparkSession, sf: str, spec: TrackSpec, grid: Grid) -> DataFrame:
    return fusion.judge_scores(scored(spark, sf, spec, grid), settings(spark, sf, grid)[spec.name])


def finished(spark: SparkSession, sf: str, spec: TrackSpec, grid: Grid) -> DataFrame:
    return score_track(
        SOURCES[spec.name](spark, sf),
        spec,
        scaler(spark, sf, spec, grid),
        settings(spark, sf, grid)[spec.name],
        interval_minutes=grid.minutes,
    )


def results(spark: SparkSession, sf: str, grid: Grid = COARSE, latest_only: bool = False) -> DataFrame:
    return detect(
        traffic(spark, sf),
        optical(spark, sf),
        scalers(spark, sf, grid),
        settings(spark, sf, grid),
        interval_minutes=grid.minutes,
        latest_only=latest_only,
    )


def timed(df: DataFrame, grid: Grid = FINE) -> DataFrame:
    """Slot number as slot time, for output."""
    rest = [c for c in df.columns if c not in ("slot_idx", *KEYS)]
    return df.select(F.expr(TM.slot_time("slot_idx", grid.minutes)).alias("occur_date"), *KEYS, *rest)


def deduplicated(spark: SparkSession, sf: str, spec: TrackSpec) -> DataFrame:
    return clean.dedup_last(clean.coerce_types(SOURCES[spec.name](spark, sf), spec), spec, FINE.minutes)


# --- sources ---------------------------------------------------------------------------------------


@query("scan_traffic")
def _(spark, sf):
    return raw.scan_traffic(testviews.traffic_raw(spark, sf), *RANGE)


@query("scan_optical")
def _(spark, sf):
    return rounded(raw.scan_optical(testviews.optical_raw(spark, sf), *RANGE))


@query("shard_prune")
def _(spark, sf):
    path = work_path(spark, "hourly")
    raw.write_hourly(traffic(spark, sf), path)
    return raw.shard_counts(raw.read_hourly(spark, path, TRAFFIC_SCHEMA), *RANGE)


@query("shard_union")
def _(spark, sf):
    return rounded(raw.shard_union([traffic(spark, sf), optical(spark, sf)]))


# --- projections, filters, splits ------------------------------------------------------------------


@query("project_alias")
def _(spark, sf):
    return rounded(reports.project_alias(results(spark, sf)).select("occur_date", "ip_addr", "slot_id", "port_id", "severity"))


@query("project_standard")
def _(spark, sf):
    return rounded(results(spark, sf).select(*STANDARD_COLS))


@query("filter_signal_type")
def _(spark, sf):
    return raw.filter_signal_type(testviews.traffic_raw(spark, sf))


@query("filter_time_range")
def _(spark, sf):
    return traffic(spark, sf).transform(raw.filter_time_range, *RANGE)


@query("split_by_dates")
def _(spark, sf):
    days = splits.split_days(as_of(spark, sf))
    train, test = splits.split_by_dates(traffic(spark, sf), *days)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("split_by_cutoff")
def _(spark, sf):
    return splits.split_by_cutoff(traffic(spark, sf), as_of(spark, sf))


@query("split_counts")
def _(spark, sf):
    labelled = [
        splits.split_by_cutoff(SOURCES[t](spark, sf), as_of(spark, sf)).select(F.lit(t).alias("track"), "split")
        for t in TRACKS
    ]
    return splits.split_counts(labelled[0].unionByName(labelled[1]))


@query("min_sample_gate")
def _(spark, sf):
    return splits.min_sample_gate(train_rows(spark, sf, TRAFFIC))


@query("filter_severity")
def _(spark, sf):
    return rounded(reports.filter_level(results(spark, sf), 1, 2))


@query("filter_rising")
def _(spark, sf):
    return rounded(reports.filter_rising(results(spark, sf)))


@query("filter_port_history")
def _(spark, sf):
    return rounded(reports.filter_port_history(results(spark, sf), *PORT, as_of(spark, sf), 7))


@query("filter_anomalies")
def _(spark, sf):
    return rounded(reports.filter_anomalies(results(spark, sf, FINE)))


@query("filter_critical")
def _(spark, sf):
    return rounded(reports.filter_critical(results(spark, sf)))


@query("latest_in_batch")
def _(spark, sf):
    return rounded(fusion.latest_in_batch(results(spark, sf)))


@query("latest_in_table")
def _(spark, sf):
    return rounded(reports.latest_in_table(results(spark, sf, FINE)))


def as_text(spark: SparkSession, sf: str) -> DataFrame:
    """Traffic as a text file would bring it, with unreadable times and counts."""
    k = F.col("error_packet")
    time = F.when(k == 3, "not a time").otherwise(F.expr(TM.time_text("occur_date")))
    tx = F.when(k == 5, "n/a").otherwise(F.col("tx_packet").cast("string"))
    return traffic(spark, sf).withColumns({"occur_date": time, "tx_packet": tx})


@query("coerce_types")
def _(spark, sf):
    return clean.coerce_types(as_text(spark, sf), TRAFFIC)


@query("coerce_quarantine")
def _(spark, sf):
    return clean.quarantine(as_text(spark, sf), TRAFFIC).select("occur_date", *KEYS, "rx_packet", "error_packet")


# --- cleaning --------------------------------------------------------------------------------------


@query("slot_round")
def _(spark, sf):
    rows = traffic(spark, sf)
    return rows.select("occur_date", *KEYS, F.expr(TM.slot_round("occur_date", FINE.minutes)).alias("slot"))


@query("slot_tumbling")
def _(spark, sf):
    slot = F.expr(TM.slot_round("occur_date", 15)).alias("slot")
    return optical(spark, sf).groupBy(slot).agg(F.count("*").alias("readings"))


@query("dedup_last")
def _(spark, sf):
    return timed(deduplicated(spark, sf, TRAFFIC))


@query("quality_min_rows")
def _(spark, sf):
    return clean.valid_ports(deduplicated(spark, sf, TRAFFIC), clean.has_min_rows(TRAFFIC))


@query("quality_dead_channel")
def _(spark, sf):
    return clean.valid_ports(deduplicated(spark, sf, OPTICAL), ~clean.is_dead(OPTICAL))


@query("quality_contaminated")
def _(spark, sf):
    return clean.valid_ports(deduplicated(spark, sf, TRAFFIC), ~clean.is_contaminated())


@query("quality_filter")
def _(spark, sf):
    return timed(clean.quality_filter(deduplicated(spark, sf, TRAFFIC), TRAFFIC))


@query("quality_filter_optical")
def _(spark, sf):
    return rounded(timed(clean.quality_filter(deduplicated(spark, sf, OPTICAL), OPTICAL)))


@query("quality_semi")
def _(spark, sf):
    rows = deduplicated(spark, sf, TRAFFIC)
    return timed(clean.quality_semi(rows, clean.valid_ports(rows, clean.quality_rule(TRAFFIC))))


@query("transform_log1p")
def _(spark, sf):
    return rounded(timed(clean.transform(deduplicated(spark, sf, TRAFFIC), TRAFFIC)))


@query("gap_fill")
def _(spark, sf):
    return timed(clean.gap_fill(deduplicated(spark, sf, TRAFFIC), TRAFFIC))


@query("interpolate_bounded")
def _(spark, sf):
    grid = clean.gap_fill(deduplicated(spark, sf, OPTICAL), OPTICAL)
    return rounded(timed(clean.interpolate_bounded(grid, OPTICAL)))


@query("preprocess")
def _(spark, sf):
    return rounded(timed(clean.preprocess(traffic(spark, sf), TRAFFIC, FINE.minutes)))


@query("preprocess_train")
def _(spark, sf):
    return rounded(timed(clean.preprocess(traffic(spark, sf), TRAFFIC, FINE.minutes, train=True)))


@query("port_time_bounds")
def _(spark, sf):
    return reports.port_time_bounds(timed(deduplicated(spark, sf, OPTICAL)))


@query("robust_fit")
def _(spark, sf):
    rows = [windows.scaler_frame(spark, t, scaler(spark, sf, t, FINE)) for t in TRACKS.values()]
    return rounded(rows[0].unionByName(rows[1]))


@query("robust_apply")
def _(spark, sf):
    rows = clean.preprocess(traffic(spark, sf), TRAFFIC, FINE.minutes)
    scaled = windows.robust_apply(rows, TRAFFIC, scaler(spark, sf, TRAFFIC, FINE))
    return rounded(timed(scaled.drop(*TRAFFIC.features)))


@query("null_mask")
def _(spark, sf):
    rows = clean.preprocess(optical(spark, sf), OPTICAL, FINE.minutes)
    return rounded(timed(windows.placeholder_filled(rows, OPTICAL)))


@query("sliding_windows")
def _(spark, sf):
    cut = windows.sliding_windows(scaled_rows(spark, sf, TRAFFIC, FINE), TRAFFIC)
    total = F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x)
    return rounded(
        timed(
            cut.select(
                *KEYS,
                "slot_idx",
                F.size("seq").cast("long").alias("slots"),
                F.col("seq")[0][0].alias("oldest_tx"),
                F.element_at("seq", -1)[0].alias("newest_tx"),
                total.alias("total"),
            )
        )
    )


def in_deliveries(rows: DataFrame, order: str, parts: int, path: str) -> DataFrame:
    """``rows`` as a stream that brings them in ``parts`` files, one per micro-batch, by the number ``order``."""
    cuts = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    bounds = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        chosen = rows.where((F.lit(True) if low is None else F.col(order) > low) & (F.lit(True) if high is None else F.col(order) <= high))
        chosen.drop(order).coalesce(1).write.parquet(f"{path}/part={i}")
    source = rows.sparkSession.readStream.schema(rows.drop(order).schema).option("maxFilesPerTrigger", 1)
    return source.option("recursiveFileLookup", "true").parquet(path)


@query("sliding_12")
def _(spark, sf):
    """Windows cut by the stream; one slot in five comes a slot late, one in five two slots, and so on up to four."""
    rows = scaled_rows(spark, sf, OPTICAL, FINE)
    late = F.pmod(F.xxhash64("slot_idx", *KEYS), F.lit(TREND_SLOTS + 1))
    with materialized(rows.withColumn("_arrival", F.col("slot_idx") + late), "slots") as arriving:
        source = in_deliveries(arriving, "_arrival", 4, work_path(spark, "slot-files"))
    cut, out = window_state.window_stream(source, OPTICAL), work_path(spark, "windows")
    to_parquet(cut, out, work_path(spark, "window-log"), availableNow=True).awaitTermination()
    return spark.read.schema(cut.schema).parquet(out).groupBy(*KEYS).agg(F.count("*").alias("windows"))


# --- scoring ---------------------------------------------------------------------------------------


@query("score_window_mean")
def _(spark, sf):
    return rounded(timed(scored(spark, sf, TRAFFIC, FINE).select(*KEYS, "slot_idx", "score")))


@query("score_last_step_mse")
def _(spark, sf):
    return rounded(timed(scored(spark, sf, OPTICAL, FINE).select(*KEYS, "slot_idx", "score")))


@query("score_custom")
def _(spark, sf):
    def window_mean(x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(x.mean(axis=1, keepdims=True), x.shape)

    rows = scoring.score_custom(window_mean)(scaled_rows(spark, sf, TRAFFIC, FINE), TRAFFIC)
    return rounded(timed(rows.select(*KEYS, "slot_idx", "score")))


@query("score_window_mse")
def _(spark, sf):
    return rounded(timed(scoring.window_mean_loss(scaled_rows(spark, sf, TRAFFIC, FINE), TRAFFIC)))


@fitted
def trained(spark: SparkSession, sf: str, spec: TrackSpec):
    rows = SOURCES[spec.name](spark, sf)
    held_out = rows.where(F.col("occur_date") >= F.expr(TM.ntz(cutoff(spark, sf))))
    return train_track(
        train_rows(spark, sf, spec),
        held_out,
        spec,
        cutoff(spark, sf),
        interval_minutes=FINE.minutes,
        percentile=FINE.percentile,
        hidden_slots=1,
    )


@query("fit_reconstruction")
def _(spark, sf):
    """Share of variance each component explains."""
    rows = [(i + 1, v) for i, v in enumerate(trained(spark, sf, TRAFFIC).model.explained)]
    return rounded(spark.createDataFrame(rows, "component int, explained double"))


@query("window_moments")
def _(spark, sf):
    """Count, sums and products of all training windows of the optical track."""
    scaled = windows.robust_apply(train_clean(spark, sf, OPTICAL, FINE), OPTICAL, scaler(spark, sf, OPTICAL, FINE))
    return rounded(moments.window_moments(scaled, OPTICAL), 4)


@query("score_reconstruction")
def _(spark, sf):
    track = trained(spark, sf, TRAFFIC)
    rows = clean.preprocess(traffic(spark, sf), TRAFFIC, FINE.minutes, full_grid=False)
    scaled = windows.robust_apply(rows, TRAFFIC, track.scaler)
    return rounded(timed(scoring.score_reconstruction(track.model)(scaled, TRAFFIC, WINDOW_SIZE)))


@query("stored_tracks")
def _(spark, sf):
    """Both trained tracks stored, loaded again and used: windows scored, and those that the trained model scores otherwise."""
    path, rows = work_path(spark, "tracks"), []
    for t in TRACKS.values():
        track = trained(spark, sf, t)
        save_track(track, t, path)
        again = load_track(spark, t, path)
        cleaned = clean.preprocess(SOURCES[t.name](spark, sf), t, FINE.minutes, full_grid=False)
        before, after = (
            scoring.score_reconstruction(x.model)(windows.robust_apply(cleaned, t, x.scaler), t).select(*KEYS, "slot_idx", F.col("score").alias(name))
            for x, name in ((track, "before"), (again, "after"))
        )
        met = before.join(after, [*KEYS, "slot_idx"], "full")
        rows.append(
            met.agg(
                F.lit(t.name).alias("track"),
                F.count("after").alias("windows"),
                F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing"),
                F.lit(again.config.first().samples_used).cast("long").alias("samples_used"),
            )
        )
    return rows[0].unionByName(rows[1])


@query("validation_loss")
def _(spark, sf):
    track = trained(spark, sf, OPTICAL)
    held_out = optical(spark, sf).where(F.col("occur_date") >= F.expr(TM.ntz(cutoff(spark, sf))))
    cut = training_windows(held_out, OPTICAL, track.scaler, FINE.minutes)
    return rounded(scoring.validation_loss(cut, track.model))


@query("select_best_model")
def _(spark, sf):
    rows = [trained(spark, sf, t).config for t in TRACKS.values()]
    chosen = rows[0].unionByName(rows[1])
    return rounded(chosen.select("track", "latent_dim", "samples_used", "final_val_loss", "threshold"))


@query("detect_reconstruction")
def _(spark, sf):
    """The whole chain with the trained models in place of window means."""
    tracks = {t.name: trained(spark, sf, t) for t in TRACKS.values()}
    versions = tracks[TRAFFIC.name].config.unionByName(tracks[OPTICAL.name].config)
    found = detect(
        traffic(spark, sf),
        optical(spark, sf),
        {n: t.scaler for n, t in tracks.items()},
        config.track_settings(versions),
        {n: scoring.score_reconstruction(t.model) for n, t in tracks.items()},
        FINE.minutes,
        latest_only=False,
    )
    return rounded(found)


@query("threshold_percentile")
def _(spark, sf):
    rows = [(t.name, threshold(spark, sf, t, FINE)) for t in TRACKS.values()]
    return rounded(spark.createDataFrame(rows, "track string, threshold double"))


@query("threshold_sketched")
def _(spark, sf):
    """Thresholds settled from stored sketches, one per day of scores."""
    rows = []
    for t in TRACKS.values():
        scores, path = train_scores(spark, sf, t, FINE), work_path(spark, "sketches")
        sketches.score_sketches(scores, f"slot_idx div {1440 // FINE.minutes}").write.parquet(path)
        rows.append((t.name, sketches.settled_threshold(scores, spark.read.parquet(path), FINE.percentile)))
    return rounded(spark.createDataFrame(rows, "track string, threshold double"))


@query("samples_used")
def _(spark, sf):
    rows = [train_scores(spark, sf, t, FINE).select(F.lit(t.name).alias("track")) for t in TRACKS.values()]
    return rows[0].unionByName(rows[1]).groupBy("track").agg(F.count("*").alias("samples_used"))


@query("flag_anomaly")
def _(spark, sf):
    return rounded(timed(judged(spark, sf, TRAFFIC, FINE).select(*KEYS, "slot_idx", "score", "threshold", "flag")))


@query("severity")
def _(spark, sf):
    return rounded(timed(judged(spark, sf, OPTICAL, FINE).select(*KEYS, "slot_idx", "severity")))


@query("trend_slope")
def _(spark, sf):
    rows = fusion.trend_slope(judged(spark, sf, TRAFFIC, FINE))
    return rounded(timed(rows.select(*KEYS, "slot_idx", "slope")), 9)


@query("trend_slope_merged")
def _(spark, sf):
    """The slope of each port from moments of days, stored in two parts with a day in common."""
    rows, path = judged(spark, sf, TRAFFIC, FINE), work_path(spark, "trend-moments")
    a_day = 1440 // FINE.minutes
    middle = int(cutoff(spark, sf).replace(tzinfo=timezone.utc).timestamp()) // 86_400
    moments_of_days = trend.stretch_moments(rows, f"slot_idx div {a_day}")
    trend.store_moments(moments_of_days.where(F.col(trend.STRETCH) <= middle), path)
    trend.store_moments(moments_of_days.where(F.col(trend.STRETCH) >= middle), path)
    return rounded(trend.stored_slopes(spark, path).select(*KEYS, "slope"), 9)


@query("inverse_transform")
def _(spark, sf):
    rows = fusion.inverse_transform(scored(spark, sf, TRAFFIC, FINE), TRAFFIC)
    return timed(rows.select(*KEYS, "slot_idx", *TRAFFIC.features))


@query("reason_text")
def _(spark, sf):
    sides = [
        finished(spark, sf, t, FINE).select("occur_date", *KEYS, F.col(t.reason).alias("reason"))
        for t in TRACKS.values()
    ]
    return sides[0].unionByName(sides[1])


@query("score_track")
def _(spark, sf):
    return rounded(finished(spark, sf, TRAFFIC, FINE))


@query("score_track_optical")
def _(spark, sf):
    return rounded(finished(spark, sf, OPTICAL, FINE))


# --- settings --------------------------------------------------------------------------------------


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Trained versions of both tracks, and a later override of one."""
    counts = {r.track: r.samples_used for r in QUERIES["samples_used"](spark, sf).collect()}
    first = [
        config.config_row(
            spark,
            t.name,
            trained_at=cutoff(spark, sf),
            threshold=threshold(spark, sf, t, FINE),
            samples_used=counts[t.name],
        )
        for t in TRACKS.values()
    ]
    both = first[0].unionByName(first[1])
    return both.unionByName(config.override_config(both, TRAFFIC.name, slope_threshold=FINE.slope_threshold))


SHOWN_SETTINGS = ("track", "version", "threshold", "slope_threshold", "rul_target", "window_size", "samples_used")


@query("resolve_config")
def _(spark, sf):
    return rounded(config.resolve_config(versions(spark, sf)).select(*SHOWN_SETTINGS))


@query("override_config")
def _(spark, sf):
    stored = versions(spark, sf)
    newer = config.override_config(stored, OPTICAL.name, threshold=0.25, rul_target=80.0)
    return rounded(config.resolve_config(stored.unionByName(newer)).select(*SHOWN_SETTINGS))


@query("model_status")
def _(spark, sf):
    optical_only = versions(spark, sf).where(F.col("track") == OPTICAL.name)
    return rounded(config.model_status(spark, optical_only).drop("final_val_loss"))


@query("config_broadcast_join")
def _(spark, sf):
    resolved = config.resolve_config(versions(spark, sf))
    rows = [scored(spark, sf, t, FINE).select(F.lit(t.name).alias("track"), *KEYS, "slot_idx", "score") for t in TRACKS.values()]
    joined = config.lookup_config(rows[0].unionByName(rows[1]), resolved, "threshold", "slope_threshold")
    return rounded(timed(joined))


# --- joins and fusion ------------------------------------------------------------------------------


def joined(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse_tracks_join(finished(spark, sf, TRAFFIC, FINE), finished(spark, sf, OPTICAL, FINE))


@query("fuse_tracks_join")
def _(spark, sf):
    return rounded(joined(spark, sf))


@query("fuse_defaults")
def _(spark, sf):
    return rounded(fusion.fuse_defaults(joined(spark, sf)))


@query("fuse_is_anomaly")
def _(spark, sf):
    return fusion.fuse_is_anomaly(fusion.fuse_defaults(joined(spark, sf))).select("occur_date", *KEYS, "is_anomaly")


@query("fuse_reason")
def _(spark, sf):
    return fusion.fuse_reason(fusion.fuse_defaults(joined(spark, sf))).select("occur_date", *KEYS, "anomaly_reason")


@query("fuse_dominant")
def _(spark, sf):
    rows = fusion.fuse_dominant(fusion.fuse_defaults(joined(spark, sf)))
    return rounded(rows.select("occur_date", *KEYS, "dominant", "anomaly_score", "threshold", "slope", "severity"))


@query("slope_label")
def _(spark, sf):
    return results(spark, sf, FINE).select("occur_date", *KEYS, "slope_label")


@query("time_to_failure")
def _(spark, sf):
    return results(spark, sf, FINE).select("occur_date", *KEYS, "ttf_minutes", "expected_fatal_time")


@query("alarm_tier")
def _(spark, sf):
    return results(spark, sf, FINE).select("occur_date", *KEYS, "alarm_level", "alarm_label")


@query("detect")
def _(spark, sf):
    return rounded(results(spark, sf, FINE))


@query("detect_latest")
def _(spark, sf):
    return rounded(results(spark, sf, FINE, latest_only=True))


@query("recovered_keys_anti")
def _(spark, sf):
    rows = reports.filter_critical(results(spark, sf, FINE))
    middle = F.expr(TM.ntz(RANGE[1]))
    before, now = rows.where(F.col("occur_date") < middle), rows.where(F.col("occur_date") >= middle)
    return alarms.recovered_keys(before, now).distinct()


@query("known_alarm_probe")
def _(spark, sf):
    rows = reports.filter_critical(results(spark, sf, FINE))
    known = rows.where(F.col("occur_date") < F.expr(TM.ntz(RANGE[1]))).select(*KEYS, "occur_date")
    return alarms.known_alarm_probe(rows, known).select("occur_date", *KEYS, "anomaly_reason")


# --- reports ---------------------------------------------------------------------------------------


@query("port_summary")
def _(spark, sf):
    return rounded(reports.port_summary(results(spark, sf, FINE)))


@query("cycle_counts")
def _(spark, sf):
    return reports.cycle_counts(results(spark, sf, FINE))


@query("counts_per_cycle")
def _(spark, sf):
    return reports.counts_per_cycle(results(spark, sf, FINE))


@query("kpi_counts")
def _(spark, sf):
    return reports.kpi_counts(stored_results(spark, sf))


@query("max_slot")
def _(spark, sf):
    return reports.max_slot(results(spark, sf, FINE))


@query("sort_canonical")
def _(spark, sf):
    rows = reports.sort_canonical(results(spark, sf))
    return rounded(rows.select(*KEYS, "occur_date", "severity"))


@query("current_anomalies")
def _(spark, sf):
    return rounded(reports.current_anomalies(stored_results(spark, sf)))


@query("watchlist")
def _(spark, sf):
    return rounded(reports.watchlist(stored_results(spark, sf)))


@query("active_criticals")
def _(spark, sf):
    return reports.active_criticals(stored_results(spark, sf, LOUD))


@query("port_history")
def _(spark, sf):
    return rounded(reports.port_history(results(spark, sf), *PORT, as_of(spark, sf), 7))


@query("top_alarms")
def _(spark, sf):
    return alarms.top_alarms(alarms.alarm_transitions(results(spark, sf, FINE)))


@query("paginate")
def _(spark, sf):
    order = [F.desc("severity"), *KEYS, "occur_date"]
    rows = results(spark, sf, FINE).withColumn("severity", F.round("severity", 6))
    return reports.paginate(rows.select("occur_date", *KEYS, "severity"), order, page=3)


@query("format_ttf")
def _(spark, sf):
    return results(spark, sf, FINE).select("occur_date", *KEYS, F.expr(X.format_ttf("ttf_minutes")).alias("ttf"))


@query("format_times")
def _(spark, sf):
    rows = results(spark, sf).select("occur_date", *KEYS, "expected_fatal_time")
    return reports.format_times(rows, "occur_date", "expected_fatal_time")


@query("diagnose_port")
def _(spark, sf):
    return reports.diagnose_port(finished(spark, sf, TRAFFIC, FINE), TRAFFIC)


@query("diagnose_port_optical")
def _(spark, sf):
    return reports.diagnose_port(finished(spark, sf, OPTICAL, FINE), OPTICAL)


@query("display_fields")
def _(spark, sf):
    return reports.display_fields(reports.current_anomalies(stored_results(spark, sf)))


@query("severity_zone")
def _(spark, sf):
    rows = reports.severity_zone(results(spark, sf, FINE))
    return rows.select("occur_date", *KEYS, "traffic_zone", "optical_zone")


@query("history_series")
def _(spark, sf):
    history = reports.port_history(results(spark, sf), *PORT, as_of(spark, sf), 30)
    return rounded(reports.history_series(history))


# --- alarms ----------------------------------------------------------------------------------------


@query("alarm_transitions")
def _(spark, sf):
    return alarms.alarm_transitions(results(spark, sf, FINE))


@query("active_alarm_view")
def _(spark, sf):
    return alarms.active_alarm_view(alarms.alarm_transitions(results(spark, sf, LOUD)))


@query("sink_alarm_json")
def _(spark, sf):
    return alarms.alarm_json(alarms.alarm_transitions(results(spark, sf, FINE)))


# --- sinks and streams: written, then read back ----------------------------------------------------


def written_splits(spark: SparkSession, sf: str, spec: TrackSpec) -> DataFrame:
    """Both splits of a track, written as CSV and read back."""
    source = SOURCES[spec.name](spark, sf)
    labelled = splits.split_by_cutoff(source, as_of(spark, sf))
    read = []
    for part in ("train", "test"):
        path = work_path(spark, f"{spec.name}-{part}")
        sinks.write_split(labelled.where(F.col("split") == part).drop("split"), path)
        read.append(raw.read_csv(spark, path, source.schema).withColumn("split", F.lit(part)))
    return read[0].unionByName(read[1])


@query("read_csv")
def _(spark, sf):
    return written_splits(spark, sf, TRAFFIC)


@query("sink_train_test_csv")
def _(spark, sf):
    both = [written_splits(spark, sf, t).withColumn("track", F.lit(t.name)) for t in TRACKS.values()]
    return rounded(raw.shard_union(both))


def stored(spark: SparkSession, sf: str, grid: Grid = COARSE) -> str:
    """A result table holding the report results."""
    path = work_path(spark, "stored")
    sinks.upsert_results(results(spark, sf, grid), path, as_of(spark, sf))
    return path


def stored_results(spark: SparkSession, sf: str, grid: Grid = COARSE) -> DataFrame:
    return sinks.read_results(spark, stored(spark, sf, grid))


@query("latest_stored")
def _(spark, sf):
    return rounded(reports.latest_in_table(stored_results(spark, sf)).select(*STANDARD_COLS))


@query("port_history_stored")
def _(spark, sf):
    return rounded(reports.port_history(stored_results(spark, sf), *PORT, as_of(spark, sf), 7))


@query("history_series_stored")
def _(spark, sf):
    history = reports.port_history(stored_results(spark, sf), *PORT, as_of(spark, sf), 30)
    return rounded(reports.history_series(history))


@query("results_schema")
def _(spark, sf):
    partial = results(spark, sf).select("occur_date", *KEYS, "severity", "is_anomaly")
    return rounded(sinks.ensure_schema(partial, as_of(spark, sf)))


@query("sink_upsert")
def _(spark, sf):
    path = stored(spark, sf)
    newer = results(spark, sf).where(F.col("occur_date") >= F.expr(TM.ntz(cutoff(spark, sf))))
    sinks.upsert_results(newer.withColumn("anomaly_reason", F.lit("revised")), path, as_of(spark, sf))
    return rounded(sinks.read_results(spark, path).select(*STANDARD_COLS))


@query("sink_retention")
def _(spark, sf):
    path = stored(spark, sf)
    sinks.expire_results(spark, path, as_of(spark, sf), 10)
    return rounded(sinks.read_results(spark, path).select("occur_date", *KEYS, "severity"))


@query("sink_sanitize")
def _(spark, sf):
    level = F.col("alarm_level")
    spoiled = results(spark, sf).withColumns(
        {
            "severity": F.when(level == 1, float("nan")).otherwise(F.col("severity")),
            "slope": F.when(level == 2, float("-inf")).otherwise(F.col("slope")),
            "anomaly_reason": F.when(level > 0, F.col("anomaly_reason")),
            "is_anomaly": F.when(level < 2, F.col("is_anomaly")),
        }
    )
    return rounded(sinks.sanitize(sinks.ensure_schema(spoiled, as_of(spark, sf))).select(*STANDARD_COLS))


@query("read_results")
def _(spark, sf):
    sql = (
        "select ip_addr, cid, lid, count(*) as stored, max(alarm_level) as worst from {results} "
        "where alarm_level >= :level group by ip_addr, cid, lid"
    )
    return sinks.results_sql(spark, stored(spark, sf), sql, level=1)


@query("sink_history_append")
def _(spark, sf):
    path, now = work_path(spark, "history"), as_of(spark, sf)
    middle = F.expr(TM.ntz(cutoff(spark, sf)))
    rows = sinks.ensure_schema(results(spark, sf), now)
    sinks.append_history(rows.where(F.col("occur_date") < middle), path, now, "0")
    sinks.append_history(rows.where(F.col("occur_date") >= middle), path, now, "1")
    read = raw.read_csv(spark, f"{path}/run_date=*/cycle=*", RESULT_SCHEMA)
    return rounded(read.select(*STANDARD_COLS, "detect_time"))


@query("sink_report")
def _(spark, sf):
    path = work_path(spark, "report")
    sinks.write_report(results(spark, sf), path)
    return rounded(raw.read_csv(spark, path, DETECTION_SCHEMA))


@query("sink_track_metadata")
def _(spark, sf):
    path = work_path(spark, "track-config")
    config.write_config(versions(spark, sf), path)
    return rounded(config.read_config(spark, path).drop("final_val_loss"))


@query("sink_params")
def _(spark, sf):
    path = work_path(spark, "scaler")
    for t in TRACKS.values():
        windows.scaler_frame(spark, t, scaler(spark, sf, t, FINE)).write.mode("append").parquet(path)
    return rounded(spark.read.schema(windows.SCALER_SCHEMA).parquet(path))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Everything a stream delivers now, as a written table."""
    spark = stream.sparkSession
    out = work_path(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", work_path(spark, f"{name}-log"))
    query_ = writer.outputMode("append").trigger(availableNow=True).start(out)
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_source")
def _(spark, sf):
    path = work_path(spark, "traffic")
    raw.write_hourly(testviews.traffic_raw(spark, sf), path)
    return drained(raw.stream_hourly(spark, path, TRAFFIC_RAW_SCHEMA), "arrived")


@query("late_data")
def _(spark, sf):
    """Readings in several deliveries: the newest first, then all of them, days late and partly repeated."""
    path, out = work_path(spark, "optical"), work_path(spark, "optical-stored")
    middle = F.expr(TM.ntz(cutoff(spark, sf)))
    rows = optical(spark, sf)
    for part in (rows.where(F.col("occur_date") >= middle), rows):
        part.coalesce(2).write.mode("append").parquet(path)
    source = spark.readStream.schema(OPTICAL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    job = ingest_stream(source, out, work_path(spark, "rejected"), work_path(spark, "ingest"), availableNow=True)
    job.awaitTermination()
    return rounded(raw.read_hourly(spark, out, OPTICAL_SCHEMA))


@fitted
def replayed(spark: SparkSession, sf: str) -> CycleConfig:
    """The deployment after the last ``CYCLES`` cycles of the data, replayed tick by tick."""
    names = ("traffic", "optical", "results", "history", "alarms", "open")
    paths = {f"{n}_path": work_path(spark, n) for n in names}
    raw.write_hourly(testviews.traffic_raw(spark, sf), paths["traffic_path"])
    raw.write_hourly(testviews.optical_raw(spark, sf), paths["optical_path"])
    job = CycleConfig(
        **paths,
        scalers=scalers(spark, sf, LOUD),
        settings=lambda: settings(spark, sf, LOUD),
        interval_minutes=LOUD.minutes,
    )
    ticks, now = work_path(spark, "ticks"), as_of(spark, sf)
    write_ticks(spark, [now - timedelta(minutes=i * LOUD.minutes) for i in reversed(range(CYCLES))], ticks)
    detect_stream(spark, job, work_path(spark, "cycles"), replay_clock(spark, ticks, 5), availableNow=True).awaitTermination()
    return job


@query("detect_stream")
def _(spark, sf):
    """What the replay's cycles stored."""
    job = replayed(spark, sf)
    return rounded(sinks.read_results(spark, job.results_path).select(*STANDARD_COLS))


@query("stream_alarms")
def _(spark, sf):
    """The events that the replay's cycles logged."""
    log = spark.read.schema(LOG_SCHEMA).json(replayed(spark, sf).alarms_path)
    return log.select("type", "event_time", "ip_addr", "slot_id", "port_id", "value")


@query("alarm_state_stream")
def _(spark, sf):
    """Results as a stream of many cycles per micro-batch, turned into events by keyed state."""
    out = work_path(spark, "stream-alarms")
    with materialized(results(spark, sf, FINE), "cycles") as rows:
        numbered = rows.withColumn("_at", F.expr(TM.epoch_micros("occur_date")))
        source = in_deliveries(numbered, "_at", 3, work_path(spark, "cycle-files"))
    alarm_transitions.start(source, out, work_path(spark, "alarm-log"), availableNow=True).awaitTermination()
    return alarm_transitions.standing(spark, out)


#: What a verdict says of its slot, apart from the trend, which the batch takes over a port's whole history.
VERDICT_COLS = ("anomaly_score", "threshold", "severity", "is_anomaly", "anomaly_reason", "alarm_level", "alarm_label")


@query("late_verdicts")
def _(spark, sf):
    """Stored verdicts after readings came in two deliveries, those of every fortieth time long after the others."""
    names = ("late-traffic", "late-optical", "late-results", "late-rejected")
    traffic_path, optical_path, results_path, rejected = (work_path(spark, n) for n in names)
    late = F.pmod(F.xxhash64("occur_date"), F.lit(40)) == 0
    for part in (~late, late):
        marked = []
        for source, path, scan, spec in (
            (testviews.traffic_raw, traffic_path, raw.scan_traffic, TRAFFIC),
            (testviews.optical_raw, optical_path, raw.scan_optical, OPTICAL),
        ):
            delivery = source(spark, sf).where(part)
            ingest(delivery, path, rejected)
            marked.append(revision.slots_of(scan(delivery), spec, COARSE.minutes))
        revision.revise(
            spark,
            marked[0].unionByName(marked[1]),
            traffic_path,
            optical_path,
            results_path,
            scalers(spark, sf, COARSE),
            settings(spark, sf, COARSE),
            interval_minutes=COARSE.minutes,
            detect_time=as_of(spark, sf),
        )
    return rounded(sinks.read_results(spark, results_path).select("occur_date", *KEYS, *VERDICT_COLS))
