"""Training of one track: scaler, reconstruction model, threshold, settings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from portvigil.operators.clean import preprocess
from portvigil.operators.config import config_row, read_config, write_config
from portvigil.operators.moments import collected, masked_losses, whole_losses, window_moments
from portvigil.operators.scoring import LinearAutoencoder, choose, fit_moments, score_reconstruction, threshold_percentile
from portvigil.operators.splits import min_sample_gate
from portvigil.operators.windows import SCALER_SCHEMA, Scaler, load_scaler, robust_apply, robust_fit, scaler_frame, sliding_windows
from portvigil.spec import INTERVAL_MINUTES, LATENT_DIM, MIN_GAIN, PATIENCE, THRESHOLD_PERCENTILE, WINDOW_SIZE, TrackSpec
from portvigil.storage import drop_path, exists, materialized, partition_values


@dataclass(frozen=True)
class TrainedTrack:
    scaler: Scaler
    model: LinearAutoencoder
    config: DataFrame


def training_windows(
    raw: DataFrame,
    spec: TrackSpec,
    scaler: Scaler,
    interval_minutes: int = INTERVAL_MINUTES,
    window_size: int = WINDOW_SIZE,
) -> DataFrame:
    """Windows of the valid ports under a scaler fitted elsewhere."""
    clean = preprocess(raw, spec, interval_minutes, window_size, train=True, full_grid=False)
    return sliding_windows(robust_apply(clean, spec, scaler), spec, window_size)


def train_track(
    train: DataFrame,
    validation: DataFrame | None,
    spec: TrackSpec,
    trained_at: datetime,
    version: int = 1,
    interval_minutes: int = INTERVAL_MINUTES,
    window_size: int = WINDOW_SIZE,
    latent_dim: int = LATENT_DIM,
    percentile: float = THRESHOLD_PERCENTILE,
    patience: int = PATIENCE,
    min_gain: float = MIN_GAIN,
    hidden_slots: int = 0,
) -> TrainedTrack | None:
    """Fit on ``train``, choose the model size on ``validation``; None with fewer raw rows than a window, or
    without two windows.

    With ``hidden_slots`` the held-out loss is that of the last slots predicted from those before, which has a least
    value inside the range.  Without, it is that of whole windows: components are nested and each lowers it a little,
    so a larger model must lower it by ``min_gain`` of it.

    The scaler is fitted on training rows only and applied to both sets.  Cleaned rows are read several times
    (quartiles, moments, scores), so they are written once, and so are the scores; windows are never written: model
    and losses follow from their moments.
    """
    if not min_sample_gate(train, window_size).first().enough:
        return None
    rows = preprocess(train, spec, interval_minutes, window_size, train=True, full_grid=False)
    with materialized(rows, "clean") as clean:
        if clean.isEmpty():
            return None
        scaler = robust_fit(clean, spec)
        scaled = robust_apply(clean, spec, scaler)
        width = window_size * len(spec.features)
        moments = collected(window_moments(scaled, spec, window_size), width)
        if moments is None or moments.count < 2:
            return None
        model = fit_moments(moments, min(latent_dim, width))
        loss = None
        if validation is not None:
            rest = preprocess(validation, spec, interval_minutes, window_size, train=True, full_grid=False)
            held_out = collected(window_moments(robust_apply(rest, spec, scaler), spec, window_size), width)
            if held_out is not None:
                hidden = hidden_slots * len(spec.features)
                losses = masked_losses(moments, held_out, model.k, hidden) if hidden else whole_losses(moments, held_out, model.k)
                model, loss = choose(model, losses, patience, 0.0 if hidden else min_gain)
        with materialized(score_reconstruction(model)(scaled, spec, window_size).select("score"), "scores") as scores:
            threshold = threshold_percentile(scores, percentile)
    config = config_row(
        train.sparkSession,
        spec.name,
        version,
        trained_at=trained_at,
        threshold=threshold,
        threshold_percentile=percentile,
        window_size=window_size,
        latent_dim=model.k,
        patience=patience,
        samples_used=moments.count,
        final_val_loss=loss,
    )
    return TrainedTrack(scaler, model, config)


def save_track(track: TrainedTrack, spec: TrackSpec, path: str) -> None:
    """Model, scaler and settings as one version; the settings are written last, so a version that was
    interrupted lacks them and is not loaded."""
    spark = track.config.sparkSession
    version = track.config.first().version
    folder = f"{path}/track={spec.name}/version={version}"
    drop_path(spark, folder)
    track.model.save(spark, f"{folder}/model")
    scaler_frame(spark, spec, track.scaler).coalesce(1).write.parquet(f"{folder}/scaler")
    write_config(track.config, f"{folder}/config")


def load_track(spark: SparkSession, spec: TrackSpec, path: str) -> TrainedTrack | None:
    """The newest version of a track that has all its parts; None without one."""
    versions = sorted(map(int, partition_values(spark, f"{path}/track={spec.name}", "version")), reverse=True)
    for version in versions:
        folder = f"{path}/track={spec.name}/version={version}"
        if exists(spark, f"{folder}/config/_SUCCESS"):
            scaler = load_scaler(spark.read.schema(SCALER_SCHEMA).parquet(f"{folder}/scaler"), spec)
            model = LinearAutoencoder.load(spark, f"{folder}/model")
            return TrainedTrack(scaler, model, read_config(spark, f"{folder}/config"))
    return None
