"""Detection as one lazy plan per call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from portvigil.operators.clean import preprocess
from portvigil.operators.config import TrackSettings
from portvigil.operators.fusion import finish_track, fuse
from portvigil.operators.scoring import Scorer, score_window_mean
from portvigil.operators.windows import Scaler, robust_apply
from portvigil.spec import INTERVAL_MINUTES, OPTICAL, TRAFFIC, TrackSpec


def score_track(
    raw: DataFrame,
    spec: TrackSpec,
    scaler: Scaler,
    settings: TrackSettings,
    scorer: Scorer = score_window_mean,
    interval_minutes: int = INTERVAL_MINUTES,
) -> DataFrame:
    """Raw readings of one track to judged windows."""
    clean = preprocess(raw, spec, interval_minutes, settings.window_size, full_grid=False)
    scored = scorer(robust_apply(clean, spec, scaler), spec, settings.window_size)
    return finish_track(scored, spec, settings, interval_minutes)


def detect(
    traffic: DataFrame | None,
    optical: DataFrame | None,
    scalers: dict[str, Scaler],
    settings: dict[str, TrackSettings],
    scorers: dict[str, Scorer] | None = None,
    interval_minutes: int = INTERVAL_MINUTES,
    latest_only: bool = True,
) -> DataFrame | None:
    """Both tracks scored and fused; None when no track has both readings and a model."""
    scorers = scorers or {}

    def track(raw: DataFrame | None, spec: TrackSpec) -> DataFrame | None:
        if raw is None or spec.name not in settings or spec.name not in scalers:
            return None
        scorer = scorers.get(spec.name, score_window_mean)
        return score_track(raw, spec, scalers[spec.name], settings[spec.name], scorer, interval_minutes)

    return fuse(track(traffic, TRAFFIC), track(optical, OPTICAL), settings, interval_minutes, latest_only)
