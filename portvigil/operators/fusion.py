"""From scores to track verdicts, and from two tracks to one verdict per port and slot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.functions import scores as S
from portvigil.functions.text import join_reasons, reason_text
from portvigil.functions.times import slot_time
from portvigil.operators.config import TrackSettings
from portvigil.operators.frames import OVER_PORT, OVER_PORT_BY_SLOT
from portvigil.spec import INTERVAL_MINUTES, KEYS, OPTICAL, STANDARD_COLS, TRACKS, TRAFFIC, TrackSpec

JOIN_KEYS = ("occur_date", *KEYS)


def judge_scores(scored: DataFrame, settings: TrackSettings) -> DataFrame:
    """Adds threshold, flag and severity."""
    return scored.selectExpr("*", f"double('{settings.threshold!r}') as threshold").selectExpr(
        "*",
        f"{S.flag_anomaly('score', 'threshold')} as flag",
        f"{S.severity('score', 'threshold')} as severity",
    )


def trend_slope(judged: DataFrame) -> DataFrame:
    """Adds the least-squares slope of severity over a port's scored windows, 0 for a single one."""
    placed = judged.selectExpr("*", f"row_number() {OVER_PORT_BY_SLOT} - 1 as _pos")
    return placed.selectExpr("*", f"coalesce(regr_slope(severity, _pos) {OVER_PORT}, 0.0D) as slope").drop("_pos")


def inverse_transform(df: DataFrame, spec: TrackSpec) -> DataFrame:
    """Metrics in the units they were read in."""
    if not spec.log_scaled:
        return df
    return df.withColumns({f: F.expr(S.packets_back(f)) for f in spec.features})


def track_columns(df: DataFrame, spec: TrackSpec, interval_minutes: int = INTERVAL_MINUTES) -> DataFrame:
    """A judged track under its result names."""
    return df.selectExpr(
        f"{slot_time('slot_idx', interval_minutes)} as occur_date",
        *KEYS,
        *spec.features,
        f"score as {spec.score}",
        f"severity as {spec.severity}",
        f"slope as {spec.slope}",
        f"threshold as {spec.threshold}",
        f"flag as {spec.flag}",
        f"{reason_text(spec, 'flag')} as {spec.reason}",
    )


def finish_track(
    scored: DataFrame, spec: TrackSpec, settings: TrackSettings, interval_minutes: int = INTERVAL_MINUTES
) -> DataFrame:
    judged = trend_slope(judge_scores(scored, settings))
    return track_columns(inverse_transform(judged, spec), spec, interval_minutes)


# --- fusion ----------------------------------------------------------------------------------------


def fuse_tracks_join(traffic: DataFrame, optical: DataFrame) -> DataFrame:
    """Both tracks side by side; a port and slot known to one of them only passes through.

    Both come clustered by port, which a join on port and slot would not make use of.  Their union keeps that
    clustering, so putting two rows of one port and slot together needs no exchange.  A track has one row per port
    and slot.
    """
    sides = {TRAFFIC.name: traffic, OPTICAL.name: optical}
    values = {name: [c for c in df.columns if c not in JOIN_KEYS] for name, df in sides.items()}
    packed = [
        df.select(*JOIN_KEYS, *(F.struct(*values[n]).alias(n) if n == name else F.lit(None).alias(n) for n in sides))
        for name, df in sides.items()
    ]
    held = [F.first(name, ignorenulls=True).alias(name) for name in sides]
    paired = packed[0].unionByName(packed[1]).groupBy(*JOIN_KEYS).agg(*held)
    return paired.select(*JOIN_KEYS, *(F.col(f"{n}.{c}").alias(c) for n, columns in values.items() for c in columns))


def absent_track(present: DataFrame, spec: TrackSpec) -> DataFrame:
    """Columns of a track that was not read at all."""
    kind = "bigint" if spec.log_scaled else "double"
    zero = F.lit(0.0)
    return present.withColumns(
        {
            **{f: F.lit(0).cast(kind) for f in spec.features},
            spec.score: zero,
            spec.severity: zero,
            spec.slope: zero,
            spec.threshold: zero,
            spec.flag: F.lit(False),
            spec.reason: F.lit("NORMAL"),
        }
    )


def fuse_defaults(fused: DataFrame) -> DataFrame:
    """Defaults for the side a row lacks; its threshold and slope stay NULL."""
    defaults = {}
    for t in TRACKS.values():
        defaults |= {t.flag: False, t.score: 0.0, t.severity: 0.0, t.reason: "NORMAL"}
        defaults |= {f: 0 for f in t.features}
    return fused.fillna(defaults)


def fuse_is_anomaly(fused: DataFrame) -> DataFrame:
    return fused.selectExpr("*", f"{' or '.join(t.flag for t in TRACKS.values())} as is_anomaly")


def fuse_reason(fused: DataFrame) -> DataFrame:
    pairs = [(t.flag, t.reason) for t in TRACKS.values()]
    return fused.selectExpr("*", f"{join_reasons(pairs)} as anomaly_reason")


def fuse_dominant(fused: DataFrame) -> DataFrame:
    """Score, threshold, slope and severity of the track with the higher severity; a tie is traffic's."""
    traffic_leads = f"{TRAFFIC.severity} >= {OPTICAL.severity}"
    pick = {"anomaly_score": "score", "threshold": "threshold", "slope": "slope", "severity": "severity"}
    return fused.selectExpr(
        "*",
        f"if({traffic_leads}, '{TRAFFIC.name}', '{OPTICAL.name}') as dominant",
        *[
            f"if({traffic_leads}, {getattr(TRAFFIC, field)}, {getattr(OPTICAL, field)}) as {name}"
            for name, field in pick.items()
        ],
    )


def _setting(settings: dict[str, TrackSettings], field: str) -> str:
    """A setting of the row's dominant track, NULL for a track without a model."""
    cases = " ".join(f"when '{name}' then {getattr(s, field)}D" for name, s in sorted(settings.items()))
    return f"(case dominant {cases} end)"


def fuse_outlook(
    fused: DataFrame, settings: dict[str, TrackSettings], interval_minutes: int = INTERVAL_MINUTES
) -> DataFrame:
    """Trend label, time to failure and alarm tier by the settings of the dominant track."""
    label = S.slope_label("slope", _setting(settings, "slope_threshold"))
    ttf = S.time_to_failure(
        "slope_label", "severity", "slope", _setting(settings, "rul_target"), interval_minutes
    )
    return (
        fused.selectExpr("*", f"{label} as slope_label")
        .selectExpr("*", f"{ttf} as ttf_minutes")
        .selectExpr(
            "*",
            "timestampadd(MINUTE, cast(ttf_minutes as bigint), occur_date) as expected_fatal_time",
            f"{S.alarm_level('severity')} as alarm_level",
            f"{S.alarm_label('severity')} as alarm_label",
        )
    )


def project_standard(fused: DataFrame) -> DataFrame:
    return fused.select(*STANDARD_COLS)


def newest_slot(*frames: DataFrame) -> Column:
    """The latest ``occur_date`` of all frames as a scalar subquery."""
    slots = [f.select("occur_date") for f in frames]
    return reduce(lambda a, b: a.unionByName(b), slots).agg(F.max("occur_date")).scalar()


def latest_in_batch(results: DataFrame) -> DataFrame:
    """Rows of the newest slot of the whole batch; a port that stopped earlier has none."""
    return results.where(F.col("occur_date") == newest_slot(results))


def fuse(
    traffic: DataFrame | None,
    optical: DataFrame | None,
    settings: dict[str, TrackSettings],
    interval_minutes: int = INTERVAL_MINUTES,
    latest_only: bool = False,
) -> DataFrame | None:
    """One verdict per port and slot out of two finished tracks.

    With ``latest_only`` both sides are cut to the newest slot of either before they are joined.  The
    slot needs neither scores nor slopes, so its subquery skips them.
    """
    tracks = [t for t in (traffic, optical) if t is not None]
    if not tracks:
        return None
    if latest_only:
        at = newest_slot(*tracks)
        traffic, optical = (t if t is None else t.where(F.col("occur_date") == at) for t in (traffic, optical))
    if traffic is None:
        joined = absent_track(optical, TRAFFIC)
    elif optical is None:
        joined = absent_track(traffic, OPTICAL)
    else:
        joined = fuse_tracks_join(traffic, optical)
    decided = fuse_dominant(fuse_reason(fuse_is_anomaly(fuse_defaults(joined))))
    return project_standard(fuse_outlook(decided, settings, interval_minutes))
