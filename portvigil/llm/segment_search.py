"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into segments of equal width.  From the mean and deviation of each segment follows a lower
bound of the squared distance of two vectors,

    |q - x|^2  >=  sum over segments of  width * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

and from |q - x|^2 = |q|^2 + |x|^2 - 2 q.x an upper bound of the inner product.  Bounds go from few wide
segments to many narrow ones; what falls below the k-th best known product at any level is dropped, and the
survivors get their exact product.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portvigil.llm import blocks

LEVELS = (4, 8, 16, 32)
#: Candidates by the coarsest bound whose exact products set the first limit.
SEEDS = 32
#: Products up to here are exact in double arithmetic.
EXACT_DOUBLE = float(2**52)
_MOST_TURNED = 1e100


class Statistics:
    """Mean and deviation of each segment, and the squared length, of every row."""

    def __init__(self, v: np.ndarray, segments: int):
        n, width = v.shape
        step = -(-width // segments)
        padded = np.zeros((n, step * segments))
        padded[:, :width] = v
        parts = padded.reshape(n, segments, step)
        # the bound is the squared distance of these rows
        self.rows = np.sqrt(step) * np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1)
        self.norm = (self.rows * self.rows).sum(axis=1)

    def distance_bound(self, other: "Statistics", row: int, rows: np.ndarray) -> np.ndarray:
        """Of the ``rows`` to one row of ``other``, as a product; while most rows are left, all are multiplied."""
        if 2 * len(rows) > len(self.rows):
            products = (self.rows @ other.rows[row])[rows]
        else:
            products = self.rows[rows] @ other.rows[row]
        return self.norm[rows] + other.norm[row] - 2 * products


def inner(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of integers held as doubles; Python integers where a double or long could round."""
    top = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q)
    if top < EXACT_DOUBLE:
        return (v @ q).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in v]
    return np.array([min(max(x, -(2**63) + 1), 2**63 - 1) for x in big], dtype=np.int64)


def kernel(k: int, levels: tuple[int, ...]) -> blocks.Kernel:
    def build(ids: np.ndarray, v: np.ndarray) -> blocks.Answer:
        steps = sorted({min(s, v.shape[1]) for s in levels})
        most = np.abs(v).max(initial=0)
        basis = _basis(v)
        with np.errstate(over="ignore", invalid="ignore"):
            have = [Statistics(v @ basis, s) for s in steps]
            length = (v * v).sum(axis=1)
        every = np.arange(len(ids))

        def answer(query_ids: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            with np.errstate(over="ignore", invalid="ignore"):
                want = [Statistics(asked @ basis, s) for s in steps]
                asked_length = (asked * asked).sum(axis=1)
            slack = 1e-9 * (length.max(initial=0) + asked_length.max(initial=0)) + 1e-6  # rounding of the bounds
            for at, q in enumerate(asked):
                left = every[ids != query_ids[at]]
                if not len(left):
                    yield ids[:0], np.zeros(0, dtype=np.int64)
                    continue
                limit = None
                moderate = most <= _MOST_TURNED and np.abs(q).max() <= _MOST_TURNED
                for mine, other in zip(have, want, strict=True) if moderate else ():  # else squares overflow: no bounds
                    bound = (length[left] + asked_length[at] - mine.distance_bound(other, at, left)) / 2 + slack
                    if limit is None:
                        seeds = left[np.argpartition(-bound, min(SEEDS, len(left)) - 1)[:SEEDS]]
                        known = np.sort(inner(v[seeds], q))[::-1]
                        limit = known[k - 1] if len(known) >= k else -np.inf
                    left = left[bound >= limit]
                scores = inner(v[left], q)
                if len(left) > k:
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    left, scores = left[keep], scores[keep]
                yield ids[left], scores

        return answer

    return build


def _basis(v: np.ndarray) -> np.ndarray:
    """Orthonormal directions of a shard's vectors, those of most energy first.  Distances stay as they are in it, and
    segments differ in energy, so the coarse bounds tell more.  Values that could overflow are left as they are."""
    if np.abs(v).max(initial=0) > _MOST_TURNED:
        return np.eye(v.shape[1])
    _, directions = np.linalg.eigh(v.T @ v)
    return directions[:, ::-1]


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v) with floor(scale * x) for every component x, as whole doubles."""
    rows = blocks.usable(df, id_col, vec_col, nonzero=False)
    largest = F.lit(sys.float_info.max)  # what overflows keeps its sign
    return rows.withColumn("v", F.transform("v", lambda x: _floor(F.greatest(F.least(x * scale, largest), -largest))))


def _floor(x):
    # floor() of a double returns a long and fails beyond its range; whole doubles there are their own floor
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def top_products(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    query_every: int = 50,
    scale: int = 256,
    levels: tuple[int, ...] = LEVELS,
    shard_rows: int = blocks.SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products, exactly.

    Null ids and vectors that are null, empty or hold null or non-finite components take no part; zero
    vectors do, with score 0; an empty table gives no rows; ties go to the smaller id; rows that repeat an
    id and a vector count once, all different vectors of an id count; products beyond a long are clipped to its range; other columns are not read.
    """
    rows = quantised(df, id_col, vec_col, scale)
    return blocks.search(rows, kernel(k, levels), k, "long", query_every, shard_rows)
