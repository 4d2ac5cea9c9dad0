"""Late readings revise the verdicts that were stored without them.

A reading at slot s enters the windows that end at s up to a window's length later, by interpolation those of
``REACH`` slots around them, and by the trend the verdicts of ``TREND_SLOTS`` more.  The slots of a delivery mark such ranges per port; ranges that meet are merged, and only
the verdicts in them are computed again, from the readings they depend on, and exchanged in the stored table.

The readings, reduced to one per port and slot, are laid out once per verdict: a port is known by its address and the
verdict's slot, so the one plan of ``detect`` judges all of them at once, each on its own look-back.  The verdict of a slot has the windows and scores
that a single batch over all readings gives it, and the trend of the windows of its look-back; it never depends on
the order in which readings came.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portvigil.functions import times as TM
from portvigil.operators.clean import coerce_types, dedup_last, with_slot_time
from portvigil.operators.config import TrackSettings
from portvigil.operators.scoring import Scorer, score_window_mean
from portvigil.operators.sinks import upsert_results
from portvigil.operators.windows import Scaler
from portvigil.plans.detect import detect
from portvigil.sources.raw import read_hours, scan_optical, scan_traffic
from portvigil.spec import INTERVAL_MINUTES, KEYS, OPTICAL, OPTICAL_SCHEMA, TRACKS, TRAFFIC, TRAFFIC_RAW_SCHEMA, TREND_SLOTS, WINDOW_SIZE, TrackSpec
from portvigil.storage import materialized

#: Missing slots across which interpolation looks for a reading, to either side.
REACH = 4
_MARK = "@"


def slots_of(readings: DataFrame, spec: TrackSpec, interval_minutes: int = INTERVAL_MINUTES) -> DataFrame:
    """(keys, slot_idx) of readings that a plan can use."""
    timed = coerce_types(readings, spec).selectExpr(*KEYS, f"{TM.epoch_micros('occur_date')} as _us")
    return timed.selectExpr(*KEYS, f"{TM.nearest_slot('_us', interval_minutes)} as slot_idx")


def merged_ranges(slots: DataFrame, before: int, after: int) -> DataFrame:
    """(keys, first, last): the union of the ranges from ``before`` slots before to ``after`` slots after each slot."""
    line = Window.partitionBy(*KEYS).orderBy("slot_idx")
    once = slots.select(*KEYS, "slot_idx").distinct()
    apart = F.col("slot_idx") - F.lag("slot_idx").over(line) > before + after + 1
    numbered = once.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int"))
    islands = numbered.withColumn("_island", F.sum("_new").over(line)).groupBy(*KEYS, "_island")
    return islands.agg((F.min("slot_idx") - before).alias("first"), (F.max("slot_idx") + after).alias("last")).drop("_island")


def touched_verdicts(slots: DataFrame, window_size: int = WINDOW_SIZE) -> DataFrame:
    """(keys, slot_idx) of all verdicts that readings of ``slots`` can change."""
    ranges = merged_ranges(slots, REACH, window_size - 1 + TREND_SLOTS + REACH)
    return ranges.select(*KEYS, F.explode(F.sequence("first", "last")).alias("slot_idx"))


def _laid_out(readings: DataFrame, spec: TrackSpec, verdicts: DataFrame, look_back: int, interval_minutes: int) -> DataFrame:
    """The reading of each slot once for every verdict whose look-back, or reach, it lies in; the address names the verdict.

    A plan uses one reading of a port and slot, and a verdict gets all or none of them; so they are reduced first, and
    what is laid out grows with the slots, however many readings a slot has.
    """
    slotted = with_slot_time(dedup_last(coerce_types(readings, spec), spec, interval_minutes), interval_minutes).withColumnRenamed("slot_idx", "_slot")
    spread = slotted.withColumn("slot_idx", F.explode(F.sequence(F.col("_slot") - REACH, F.col("_slot") + look_back - 1 + REACH)))
    chosen = spread.join(verdicts, [*KEYS, "slot_idx"], "left_semi")
    return chosen.withColumn("ip_addr", F.concat_ws(_MARK, "ip_addr", "slot_idx")).drop("_slot", "slot_idx")


def _verdict_slot(address: str = "ip_addr"):
    return F.substring_index(address, _MARK, -1).cast("long")


def _up_to_verdict(scorer: Scorer) -> Scorer:
    """Windows after a verdict's slot are read for interpolation only."""

    def score(scaled: DataFrame, spec: TrackSpec, window_size: int) -> DataFrame:
        return scorer(scaled, spec, window_size).where(F.col("slot_idx") <= _verdict_slot())

    return score


def revised(
    traffic: DataFrame,
    optical: DataFrame,
    verdicts: DataFrame,
    scalers: dict[str, Scaler],
    settings: dict[str, TrackSettings],
    scorers: dict[str, Scorer] | None = None,
    interval_minutes: int = INTERVAL_MINUTES,
) -> DataFrame:
    """The rows of ``verdicts`` (keys, ``slot_idx``) that can be given, from readings of both tracks."""
    look_back = WINDOW_SIZE + TREND_SLOTS
    chosen = {t: _up_to_verdict((scorers or {}).get(t, score_window_mean)) for t in TRACKS}
    laid = (_laid_out(rows, spec, verdicts, look_back, interval_minutes) for rows, spec in ((traffic, TRAFFIC), (optical, OPTICAL)))
    found = detect(*laid, scalers, settings, chosen, interval_minutes, latest_only=False)
    own = found.withColumn("_slot", _verdict_slot())
    at_slot = own.where(F.col("occur_date") == F.expr(TM.slot_time("_slot", interval_minutes))).drop("_slot")
    address = F.expr(f"left(ip_addr, length(ip_addr) - length(substring_index(ip_addr, '{_MARK}', -1)) - 1)")
    return at_slot.withColumn("ip_addr", address)


def revise(
    spark: SparkSession,
    late: DataFrame,
    traffic_path: str,
    optical_path: str,
    results_path: str,
    scalers: dict[str, Scaler],
    settings: dict[str, TrackSettings],
    scorers: dict[str, Scorer] | None = None,
    interval_minutes: int = INTERVAL_MINUTES,
    detect_time: datetime | None = None,
) -> None:
    """Exchange the stored verdicts that the readings at the slots ``late`` (keys, ``slot_idx``) can have changed.

    The readings are stored already.  A verdict that can no longer be given goes.  Without late slots nothing is done;
    running it again changes nothing.
    """
    with materialized(touched_verdicts(late), "touched") as verdicts:
        first, last = verdicts.agg(F.min("slot_idx"), F.max("slot_idx")).first()
        if first is None:
            return
        slot = timedelta(minutes=interval_minutes)
        start = datetime(1970, 1, 1) + (first - WINDOW_SIZE - TREND_SLOTS - REACH) * slot
        end = datetime(1970, 1, 1) + (last + REACH + 1) * slot
        traffic = scan_traffic(read_hours(spark, traffic_path, TRAFFIC_RAW_SCHEMA, start, end), start, end)
        optical = scan_optical(read_hours(spark, optical_path, OPTICAL_SCHEMA, start, end), start, end)
        rows = revised(traffic, optical, verdicts, scalers, settings, scorers, interval_minutes)
        time = F.expr(TM.slot_time("slot_idx", interval_minutes)).alias("occur_date")
        upsert_results(rows, results_path, detect_time or end, replaced=verdicts.select(time, *KEYS))
