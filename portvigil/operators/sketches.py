"""Thresholds from mergeable quantile sketches.

Scores of a stretch of time (an hour, a day) are summed up in one KLL sketch each, some kilobytes that are stored.
Retraining merges the sketches of its range instead of sorting all scores again.  The merged sketch alone gives an
approximate threshold with a known error in rank; where the exact one is wanted, it gives a bracket, and one count of
the scores settles the value inside (``quantiles``), the same as without a sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.operators.quantiles import exact_quantiles

#: Size parameter of the sketches; the documented error of a single rank is 2.296 / k^0.9723 with confidence 99 %.
K = 1_000


def rank_error(k: int = K) -> float:
    """Error in rank, as a share of all values, that a sketch keeps to with 99 % confidence."""
    return 2.296 / k**0.9723


def score_sketches(scored: DataFrame, stretch: str, k: int = K) -> DataFrame:
    """One sketch of the scores per stretch, an expression of the row; combined before the shuffle."""
    sketch = F.kll_sketch_agg_double("score", k)
    return scored.where("score is not null").groupBy(F.expr(stretch).alias("stretch")).agg(sketch.alias("sketch"))


def _merged(k: int) -> Column:
    return F.kll_merge_agg_double("sketch", k)


def _quantiles(sketches: DataFrame, probs: list[float], k: int) -> tuple[float, ...] | None:
    merged = sketches.agg(_merged(k).alias("sketch"), F.count("*").alias("n")).where("n > 0")
    row = merged.select(*(F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"q{i}") for i, p in enumerate(probs))).first()
    return tuple(row) if row else None


def approximate_threshold(sketches: DataFrame, percentile: float, k: int = K) -> float | None:
    """Percentile (0..100) by the sketches alone, off by ``rank_error`` in rank at most; None without scores."""
    found = _quantiles(sketches, [percentile / 100.0], k)
    return found[0] if found else None


def settled_threshold(scored: DataFrame, sketches: DataFrame, percentile: float, k: int = K) -> float | None:
    """Exact percentile (0..100) of the scores, bracketed by their sketches.

    The bracket only says where to count first: should a sketch be off by more than its error, or be of other
    scores, more rounds follow and the value is the same.
    """
    at, margin = percentile / 100.0, 2 * rank_error(k)
    ends = _quantiles(sketches, [max(0.0, at - margin), min(1.0, at + margin)], k)
    usable = ends is not None and all(math.isfinite(e) for e in ends)
    return exact_quantiles(scored, ["score"], [at], hints={"score": list(ends)} if usable else None)["score"][0]
