"""Moments of windows without a window table, and what follows from them.

A window is a vector of its slots' scaled metrics.  Count, sums and products of all complete windows are added up from
the grid in one pass: every row carries its window as lagged values, a task adds its rows to one small matrix, and the
matrices are summed.  Moments of two sets of windows are those of their union when added, so they can be kept per
day and merged.  Principal components, and the loss of any linear reconstruction, need nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portvigil.operators.frames import OVER_PORT_BY_SLOT
from portvigil.operators.windows import complete_windows, z
from portvigil.spec import WINDOW_SIZE, TrackSpec

SCHEMA = "i int, j int, total double"
_NONE = -1


@dataclass(frozen=True)
class Moments:
    """Of ``count`` windows: the sum of their vectors and of their products."""

    count: int
    sums: np.ndarray
    products: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.count

    def around(self, center: np.ndarray) -> np.ndarray:
        """Mean product of the deviations from ``center``."""
        outer = np.outer(self.sums, center)
        return (self.products - outer - outer.T) / self.count + np.outer(center, center)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.count + other.count, self.sums + other.sums, self.products + other.products)


def lags(spec: TrackSpec, window_size: int = WINDOW_SIZE) -> dict[str, str]:
    """``_x0``, ``_x1``, ...: the values of the window that a row ends, oldest slot first, as SQL.

    The rows before are the slots before, one each, wherever the window is complete.
    """
    return {
        f"_x{(window_size - 1 - d) * len(spec.features) + n}": f"lag({z(f)}, {d}) {OVER_PORT_BY_SLOT}"
        for d in range(window_size)
        for n, f in enumerate(spec.features)
    }


def lagged_windows(scaled: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE) -> DataFrame:
    """``x``: the values of every complete window, oldest slot first."""
    cut = complete_windows(scaled, spec, window_size, **lags(spec, window_size))
    return cut.select(F.array(*(f"_x{i}" for i in range(window_size * len(spec.features)))).alias("x"))


def window_moments(scaled: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE) -> DataFrame:
    """(i, j, total): the count in the row (-1, -1), sums in (i, -1), sums of products in (i, j), i <= j."""
    width = window_size * len(spec.features)
    upper = np.triu_indices(width)
    rows = np.r_[_NONE, np.arange(width), upper[0]].astype(np.int32), np.r_[_NONE, np.full(width, _NONE), upper[1]].astype(np.int32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            count, sums, products = count + len(x), sums + x.sum(axis=0), products + x.T @ x
        if count:
            totals = np.r_[count, sums, products[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(totals)], ["i", "j", "total"])

    partial = lagged_windows(scaled, spec, window_size).mapInArrow(add, SCHEMA)
    return partial.groupBy("i", "j").agg(F.sum("total").alias("total"))


def collected(moments: DataFrame, width: int) -> Moments | None:
    """The few rows of ``window_moments`` as matrices; None without a window."""
    table = moments.toPandas()
    if table.empty:
        return None
    i, j, total = (table[c].to_numpy() for c in ("i", "j", "total"))
    sums, products = np.zeros(width), np.zeros((width, width))
    first, both = (i >= 0) & (j < 0), j >= 0
    sums[i[first]] = total[first]
    products[i[both], j[both]] = products[j[both], i[both]] = total[both]
    return Moments(round(float(total[(i < 0)][0])), sums, products)


def components(moments: Moments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, share of the variance each explains), largest first; signs by the largest entry."""
    values, vectors = np.linalg.eigh(moments.around(moments.mean))
    vectors = vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    values = np.maximum(values[::-1], 0)
    return vectors, values[:k] / (values.sum() or 1.0)


def masked_prediction(vectors: np.ndarray, hidden: int) -> np.ndarray:
    """Matrix that predicts the last ``hidden`` deviations of a window from the others: the coordinates that fit the
    seen part best, carried to the hidden part."""
    seen, unseen = vectors[:-hidden], vectors[-hidden:]
    return unseen @ np.linalg.pinv(seen)


def masked_losses(train: Moments, held_out: Moments, k: int, hidden: int) -> list[tuple[int, float]]:
    """(number of components, mean squared error of the last slot predicted from the slots before) on held-out windows.

    With too many components the fit to the seen slots carries noise to the hidden one, so the loss has a least value
    inside the range; that of a whole reconstruction only falls.  Both sides are moments: no window is read again.
    """
    vectors, _ = components(train, k)
    spread = held_out.around(train.mean)
    seen, cross, unseen = spread[:-hidden, :-hidden], spread[:-hidden, -hidden:], spread[-hidden:, -hidden:]
    losses = []
    for n in range(1, vectors.shape[1] + 1):
        m = masked_prediction(vectors[:, :n], hidden)
        losses.append((n, float(np.trace(unseen - 2 * m @ cross + m @ seen @ m.T)) / hidden))
    return losses


def whole_losses(train: Moments, held_out: Moments, k: int) -> list[tuple[int, float]]:
    """(number of components, mean squared error over all slots of rebuilt held-out windows); falls with the number."""
    vectors, _ = components(train, k)
    spread = held_out.around(train.mean)
    explained = np.cumsum(((spread @ vectors) * vectors).sum(axis=0))
    return [(n, max(float(np.trace(spread) - e), 0.0) / len(spread)) for n, e in enumerate(explained, 1)]


def best_components(losses: list[tuple[int, float]]) -> int:
    """The number of components of least loss, the smaller one of equals."""
    return min(losses, key=lambda kv: (kv[1], kv[0]))[0]
