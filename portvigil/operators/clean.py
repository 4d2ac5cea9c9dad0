"""Cleaning: typed readings, one row per port and slot, quality rules, gap fill, interpolation.

Readings are reduced to one row per (port, slot) by a hash aggregate that combines before the shuffle.
After it a port has at most one row per slot of calendar time (96 a day at 15 minutes), whatever number
of raw readings it sent, so the per-port windows that follow stay small for a port that holds a third of
the raw rows.
"""

from __future__ import annotations

from datetime import datetime

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.functions import scores as S
from portvigil.functions import times as TM
from portvigil.operators.frames import OVER_PORT_BY_SLOT, port
from portvigil.spec import (
    DEAD_POWER,
    INTERVAL_MINUTES,
    KEYS,
    MAX_ERROR_PACKETS,
    MAX_PACKETS,
    OPTICAL,
    WINDOW_SIZE,
    TrackSpec,
)


def coerce_types(df: DataFrame, spec: TrackSpec) -> DataFrame:
    """Naive times and double metrics; what is no finite number is NULL, rows without time or port go."""
    metrics = [f"{S.finite_or_null(f'try_cast({f} as double)')} as {f}" for f in spec.features]
    typed = df.selectExpr(f"{TM.to_ntz('occur_date')} as occur_date", *KEYS, *metrics)
    return typed.where(" and ".join(f"{c} is not null" for c in ("occur_date", *KEYS)))


def quarantine(df: DataFrame, spec: TrackSpec, as_of: datetime | None = None) -> DataFrame:
    """The rows ``coerce_types`` rejects, as they came; with ``as_of`` also those dated later."""
    time = TM.to_ntz("occur_date")
    rejected = [f"{c} is null" for c in (time, *KEYS)]
    if as_of is not None:
        rejected.append(f"{time} > {TM.ntz(as_of)}")
    return df.where(" or ".join(rejected))


def dedup_last(df: DataFrame, spec: TrackSpec, interval_minutes: int = INTERVAL_MINUTES) -> DataFrame:
    """The latest reading of each port and slot.

    All metrics are taken at the maximum of one ordering number, hence from one row.  It holds the time
    within the slot in its high bits and a hash of the metrics in its low bits, which settles readings
    with equal times the same way in any input order.  A primitive ordering keeps this a hash aggregate.
    """
    n = TM.micros_per_slot(interval_minutes)
    low = 1 << (62 - n.bit_length())
    kept = (*KEYS, *spec.features)
    ordered = (
        df.selectExpr(*kept, f"{TM.epoch_micros('occur_date')} as _us")
        .selectExpr(*kept, "_us", f"{TM.nearest_slot('_us', interval_minutes)} as slot_idx")
        .selectExpr(
            *kept,
            "slot_idx",
            f"(_us - slot_idx * {n}L + {n // 2}L) * {low}L + pmod(xxhash64({', '.join(spec.features)}), {low}L) as _ord",
        )
    )
    latest = [F.expr(f"max_by({f}, _ord) as {f}") for f in spec.features]
    return ordered.groupBy(*KEYS, "slot_idx").agg(*latest)


def with_slot_time(df: DataFrame, interval_minutes: int = INTERVAL_MINUTES) -> DataFrame:
    return df.withColumn("occur_date", F.expr(TM.slot_time("slot_idx", interval_minutes)))


# --- quality of training ports ---------------------------------------------------------------------


def is_complete(spec: TrackSpec) -> Column:
    return F.expr(" and ".join(f"{f} is not null" for f in spec.features))


def has_min_rows(spec: TrackSpec, window_size: int = WINDOW_SIZE, count=F.count_if) -> Column:
    return count(is_complete(spec)) >= 2 * window_size


def is_dead(spec: TrackSpec, count=F.count_if) -> Column:
    """Every value at the floor; a single NULL keeps the port."""
    low = [F.coalesce(F.col(f) <= DEAD_POWER, F.lit(False)) for f in spec.features]
    return count(~reduce(lambda a, b: a & b, low)) == 0


def is_contaminated(count=F.count_if) -> Column:
    bad = F.col("error_packet") > MAX_ERROR_PACKETS
    for f in ("tx_packet", "rx_packet"):
        bad = bad | (F.col(f) > MAX_PACKETS)
    return count(bad) > 0


def quality_rule(spec: TrackSpec, window_size: int = WINDOW_SIZE, count=F.count_if) -> Column:
    """Condition a port must meet to be trained on, as an aggregate or, with ``count`` over a window."""
    spoiled = is_dead(spec, count) if spec.name == OPTICAL.name else is_contaminated(count)
    return has_min_rows(spec, window_size, count) & ~spoiled


def valid_ports(df: DataFrame, rule: Column) -> DataFrame:
    """Ports meeting an aggregate condition; the counts combine before the shuffle."""
    return df.groupBy(*KEYS).agg(rule.alias("_ok")).where("_ok").select(*KEYS)


def quality_semi(df: DataFrame, ports: DataFrame) -> DataFrame:
    return df.join(ports, list(KEYS), "left_semi")


def quality_filter(df: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE) -> DataFrame:
    """Rows of valid ports, checked over the partitioning that the later steps use anyway."""
    rule = quality_rule(spec, window_size, lambda c: F.count_if(c).over(port()))
    return df.withColumn("_ok", rule).where("_ok").drop("_ok")


# --- values and grid -------------------------------------------------------------------------------


def transform(df: DataFrame, spec: TrackSpec) -> DataFrame:
    """Packet counts on a log scale, negatives as 0; optical power stays as it is."""
    if not spec.log_scaled:
        return df
    logs = [f"case when {f} is not null then log1p(greatest({f}, 0.0D)) end as {f}" for f in spec.features]
    return df.selectExpr(*KEYS, "slot_idx", *logs)


def _at_slots(spec: TrackSpec) -> list[str]:
    """Metrics only where the generated slot ``_slot`` is the slot of the reading."""
    metrics = [f"case when _slot = slot_idx then {f} end as {f}" for f in spec.features]
    return [*KEYS, "_slot as slot_idx", *metrics]


def gap_fill(df: DataFrame, spec: TrackSpec, block: int = 4096) -> DataFrame:
    """Every slot between a port's first and last reading; new slots have NULL metrics.

    Each reading generates the slots up to the next one, so no calendar is joined.  Long gaps are
    generated block by block, which bounds the arrays a stray timestamp could cause.
    """
    return (
        df.selectExpr("*", f"coalesce(lead(slot_idx) {OVER_PORT_BY_SLOT} - 1, slot_idx) as _last")
        .selectExpr("*", f"explode(sequence(slot_idx, _last, {block}L)) as _block")
        .selectExpr("*", f"explode(sequence(_block, least(_block + {block - 1}, _last))) as _slot")
        .selectExpr(*_at_slots(spec))
    )


def edge_fill(df: DataFrame, spec: TrackSpec) -> DataFrame:
    """Only the slots of a gap that interpolation can reach: the first and the last.

    The slots between them stay NULL, and every window over a NULL is dropped, so scoring gets the same
    windows as from ``gap_fill`` while a reading yields three rows at most, however long the gap.
    """
    edges = (
        "slot_idx, case when _after - slot_idx > 1 then slot_idx + 1 end, "
        "case when _after - slot_idx > 2 then _after - 1 end"
    )
    return (
        df.selectExpr("*", f"lead(slot_idx) {OVER_PORT_BY_SLOT} as _after")
        .selectExpr("*", f"explode(array({edges})) as _slot")
        .where("_slot is not null")
        .selectExpr(*_at_slots(spec))
    )


def interpolate_bounded(df: DataFrame, spec: TrackSpec) -> DataFrame:
    """Linear fill of NULLs next to a value, at most one from each side of a gap.

    Before a port's first value and after its last the neighbour is repeated.  The neighbours come from
    ``lag`` and ``lead`` that skip NULLs, so both directions share one sort.
    """
    around = []
    for f in spec.features:
        known = f"case when {f} is not null then struct(slot_idx as i, {f} as v) end"
        around += [
            f"lag({known}) ignore nulls {OVER_PORT_BY_SLOT} as _p_{f}",
            f"lead({known}) ignore nulls {OVER_PORT_BY_SLOT} as _n_{f}",
        ]
    filled = [f"{_filled(f)} as {f}" for f in spec.features]
    return df.selectExpr("*", *around).selectExpr(*KEYS, "slot_idx", *filled)


def _filled(f: str) -> str:
    before, after = f"_p_{f}", f"_n_{f}"
    back, ahead = f"(slot_idx - {before}.i)", f"({after}.i - slot_idx)"
    between = f"{before}.v + ({after}.v - {before}.v) * {back} / ({back} + {ahead})"
    return (
        f"case when {f} is not null then {f} when {back} = 1 or {ahead} = 1 "
        f"then coalesce({between}, {before}.v, {after}.v) end"
    )


def preprocess(
    raw: DataFrame,
    spec: TrackSpec,
    interval_minutes: int = INTERVAL_MINUTES,
    window_size: int = WINDOW_SIZE,
    train: bool = False,
    full_grid: bool = True,
) -> DataFrame:
    """Raw readings to transformed metrics on the grid: keys, ``slot_idx``, metrics."""
    df = dedup_last(coerce_types(raw, spec), spec, interval_minutes)
    if train:
        df = quality_filter(df, spec, window_size)
    df = transform(df, spec)
    df = gap_fill(df, spec) if full_grid else edge_fill(df, spec)
    return interpolate_bounded(df, spec)
