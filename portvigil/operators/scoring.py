"""Reconstruction scores of windows.

A scorer takes the scaled grid of a track and returns its window-end rows with ``score``, the mean over
metrics of the squared reconstruction error at the last slot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portvigil.functions.scores import finite_or_null, mean_square
from portvigil.operators.frames import over_trailing
from portvigil.operators.moments import Moments, components, lags
from portvigil.operators.quantiles import FEW, exact_quantiles
from portvigil.operators.windows import complete_windows, double_literal, sliding_windows, z
from portvigil.spec import KEYS, PATIENCE, WINDOW_SIZE, TrackSpec

Scorer = Callable[[DataFrame, TrackSpec, int], DataFrame]


def score_window_mean(scaled: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE) -> DataFrame:
    """Each window rebuilt as its own mean.  Needs no trained model and no arrays."""
    means = {f"_a_{f}": f"avg({z(f)}) {over_trailing(window_size)}" for f in spec.features}
    framed = complete_windows(scaled, spec, window_size, **means)
    score = mean_square([f"{z(f)} - _a_{f}" for f in spec.features])
    return _scored(framed, spec, score)


def _scored(windows: DataFrame, spec: TrackSpec, score: str) -> DataFrame:
    rows = windows.selectExpr(*KEYS, "slot_idx", *spec.features, f"{score} as score")
    return rows.withColumn("score", F.expr(finite_or_null("score")))


def window_mean_loss(scaled: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE) -> DataFrame:
    """Mean squared error over all slots of a window that is rebuilt as its mean."""
    spread = " + ".join(f"var_pop({z(f)}) {over_trailing(window_size)}" for f in spec.features)
    framed = complete_windows(scaled, spec, window_size, loss=f"({spread}) / {len(spec.features)}")
    return framed.select(*KEYS, "slot_idx", "loss")


@dataclass(frozen=True)
class LinearAutoencoder:
    """Projection of flattened windows on the first ``k`` principal components and back.

    ``vectors`` holds the components as columns, ``explained`` the share of the variance of each.
    """

    vectors: np.ndarray
    mean: list[float]
    k: int
    explained: tuple[float, ...] = ()

    @property
    def components(self) -> np.ndarray:
        return self.vectors[:, : self.k]

    def save(self, spark: SparkSession, path: str) -> None:
        """One row with the mean and ``k``, and one row per component."""
        parts = [(i, [float(x) for x in v], float(e)) for i, (v, e) in enumerate(zip(self.vectors.T, self.explained, strict=True))]
        rows = spark.createDataFrame(parts, "component int, weights array<double>, explained double")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/components")
        rest = spark.createDataFrame([(self.mean, self.k)], "mean array<double>, k int")
        rest.coalesce(1).write.mode("overwrite").parquet(f"{path}/mean")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearAutoencoder:
        rest = spark.read.parquet(f"{path}/mean").first()
        parts = spark.read.parquet(f"{path}/components").orderBy("component").collect()
        vectors = np.array([r.weights for r in parts]).T
        return LinearAutoencoder(vectors, list(rest.mean), rest.k, tuple(r.explained for r in parts))


def _flat(windows: DataFrame) -> DataFrame:
    return windows.withColumn("x", F.flatten("seq"))


def fit_reconstruction(windows: DataFrame, k: int) -> LinearAutoencoder:
    """Fit on a table of windows.  The covariance is summed on the executors; the driver only
    decomposes a square matrix of side window size x metrics."""
    vectors = _flat(windows).select(array_to_vector("x").alias("v"))
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("m")).first().m
    pca = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    return LinearAutoencoder(pca.pc.toArray(), mean.toArray().tolist(), k, tuple(pca.explainedVariance.toArray().tolist()))


def fit_moments(train: Moments, k: int) -> LinearAutoencoder:
    """The same model from the moments of the windows, which no table has to hold."""
    vectors, explained = components(train, k)
    return LinearAutoencoder(vectors, train.mean.tolist(), vectors.shape[1], tuple(explained.tolist()))


def _projected(windows: DataFrame, model: LinearAutoencoder) -> DataFrame:
    """Adds ``x``, the flat window, and ``p``, its coordinates relative to the projected mean."""
    flat = _flat(windows)
    along = [F.array(*[F.lit(float(w)) for w in model.components[:, i]]) for i in range(model.k)]
    products = [F.aggregate(F.zip_with("x", v, lambda x, w: x * w), F.lit(0.0), lambda a, e: a + e) for v in along]
    return flat.withColumn("p", F.array(*products))


def _center(model: LinearAutoencoder) -> np.ndarray:
    return model.components.T @ np.array(model.mean)


def _last_slot_error(spec: TrackSpec, model: LinearAutoencoder, value: Callable[[int], str]) -> str:
    """Mean squared error of the rebuilt last slot; ``value`` gives the SQL of a place of the window.

    Projection and return are one matrix, of which the last slot needs one row per metric.
    """
    width, last = len(model.mean), len(spec.features)
    back = model.components[-last:] @ model.components.T
    base = np.array(model.mean[-last:]) - back @ np.array(model.mean)
    errors = []
    for j in range(last):
        parts = [f"{value(i)} * {double_literal(float(back[j, i]))}" for i in range(width)]
        errors.append(f"{value(width - last + j)} - ({' + '.join([double_literal(float(base[j])), *parts])})")
    return mean_square(errors)


def score_windows(windows: DataFrame, spec: TrackSpec, model: LinearAutoencoder) -> DataFrame:
    """Scores of windows that are already cut.  Only the last slot is rebuilt."""
    return _scored(_flat(windows), spec, _last_slot_error(spec, model, lambda i: f"x[{i}]"))


def score_reconstruction(model: LinearAutoencoder) -> Scorer:
    """Scorer of a linear autoencoder, over lagged values: no window is gathered in an array."""

    def scorer(scaled: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE) -> DataFrame:
        cut = complete_windows(scaled, spec, window_size, **lags(spec, window_size))
        return _scored(cut, spec, _last_slot_error(spec, model, lambda i: f"_x{i}"))

    return scorer


def score_custom(reconstruct: Callable[[np.ndarray], np.ndarray]) -> Scorer:
    """Scorer around any ``ndarray[n, window, metrics] -> ndarray`` of the same shape, for networks
    trained elsewhere.  Windows reach it in Arrow batches."""

    def scorer(scaled: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE) -> DataFrame:
        width = len(spec.features)

        @F.pandas_udf("double")
        def last_slot_error(flat: pd.Series) -> pd.Series:
            if flat.empty:
                return pd.Series(dtype="float64")
            x = np.stack(flat.to_numpy()).reshape(len(flat), window_size, width)
            return pd.Series(np.mean((x[:, -1, :] - reconstruct(x)[:, -1, :]) ** 2, axis=1))

        windows = _flat(sliding_windows(scaled, spec, window_size))
        scored = windows.withColumn("mse", last_slot_error("x"))
        return _scored(scored, spec, "mse")

    return scorer


def _residuals(windows: DataFrame, model: LinearAutoencoder) -> tuple[DataFrame, Column, list[Column]]:
    """Projected windows, their squared distance from the mean, and what each component explains of it.

    The components are orthonormal, so the error left after ``k`` of them is the distance minus the first
    ``k`` explained parts: one pass over the windows measures every ``k`` at once.
    """
    mean = F.array(*[F.lit(float(m)) for m in model.mean])
    centered = F.zip_with("x", mean, lambda x, m: (x - m) * (x - m))
    distance = F.aggregate(centered, F.lit(0.0), lambda a, e: a + e)
    center = _center(model)
    explained = [
        (F.col("p")[i] - float(center[i])) * (F.col("p")[i] - float(center[i])) for i in range(model.k)
    ]
    return _projected(windows, model), distance, explained


def score_window_mse(windows: DataFrame, model: LinearAutoencoder) -> DataFrame:
    """Reconstruction error of each window, averaged over its slots and metrics."""
    projected, distance, explained = _residuals(windows, model)
    left = distance
    for part in explained:
        left = left - part
    loss = F.greatest(left, F.lit(0.0)) / F.size("x")
    return projected.select(*KEYS, "slot_idx", loss.alias("loss"))


def validation_loss(windows: DataFrame, model: LinearAutoencoder) -> DataFrame:
    """One row per number of components: ``k`` and the mean loss of the given windows."""
    projected, distance, explained = _residuals(windows, model)
    sums = projected.agg(
        F.avg(distance / F.size("x")).alias("d"),
        *[F.avg(e / F.size("x")).alias(f"e{i}") for i, e in enumerate(explained)],
    )
    losses, left = [], F.col("d")
    for i in range(len(explained)):
        left = left - F.col(f"e{i}")
        losses.append(F.struct(F.lit(i + 1).alias("k"), F.greatest(left, F.lit(0.0)).alias("val_loss")))
    return sums.select(F.inline(F.array(*losses)))


def select_best_model(
    model: LinearAutoencoder, losses: DataFrame, patience: int = PATIENCE, min_gain: float = 0.0
) -> tuple[LinearAutoencoder, float | None]:
    """The number of components with the lowest validation loss, and that loss.

    Candidates are taken in growing order; the search ends after ``patience`` of them without an
    improvement of more than ``min_gain`` (relative).  ``losses`` has one row per component.
    """
    return choose(model, [(r.k, r.val_loss) for r in losses.orderBy("k").collect()], patience, min_gain)


def choose(
    model: LinearAutoencoder, losses: list[tuple[int, float | None]], patience: int = PATIENCE, min_gain: float = 0.0
) -> tuple[LinearAutoencoder, float | None]:
    """``select_best_model`` of losses in growing order of ``k``."""
    best_k, best, stale = model.k, None, 0
    for k, loss in losses:
        if loss is None:
            break
        if best is None or loss < best * (1.0 - min_gain):
            best_k, best, stale = k, loss, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return replace(model, k=best_k), best


def threshold_percentile(scored: DataFrame, percentile: float, few: int = FEW) -> float | None:
    """Exact percentile (0..100) of the scores."""
    return exact_quantiles(scored, ["score"], [percentile / 100.0], few)["score"][0]
