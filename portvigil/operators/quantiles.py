"""Exact quantiles of columns of any size, by one method at every size.

Spark's ``percentile`` keeps every distinct value in one task.  Here each wanted order statistic is bracketed
with ``percentile_approx``; exact counts decide on which side it lies; the bracket shrinks by orders of
magnitude per round until at most ``FEW`` values are left, and only these are gathered.  Only counts and
bracket ends reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 10_000
ACCURACY = 10_000


@dataclass
class _Target:
    """An order statistic: ``rank`` values of ``col`` precede it; it lies strictly within (lo, hi)."""

    col: str
    rank: int
    inside: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None
    value: float | None = None

    def candidates(self) -> Column:
        x = F.col(self.col)
        keep = x.isNotNull()
        if self.lo is not None:
            keep = keep & (x > self.lo)
        if self.hi is not None:
            keep = keep & (x < self.hi)
        return F.when(keep, x)

    def bracket(self, accuracy: int) -> Column:
        at = (self.rank - self.below) / self.inside
        margin = 2.0 / accuracy
        ends = F.array(F.lit(max(0.0, at - margin)), F.lit(min(1.0, at + margin)))
        return F.percentile_approx(self.candidates(), ends, accuracy)

    def narrow(self, end: float, below: int, equal: int) -> None:
        """Use the exact number of values below and equal to one bracket end."""
        if self.value is not None:
            return
        if below <= self.rank < below + equal:
            self.value = end
        elif self.rank >= below + equal:
            if self.lo is None or end > self.lo:
                self.inside -= below + equal - self.below
                self.lo, self.below = end, below + equal
        elif self.hi is None or end < self.hi:
            self.inside = below - self.below
            self.hi = end

    def pick(self) -> Column:
        """The value itself, once the candidates are few."""
        return F.element_at(F.array_sort(F.collect_list(self.candidates())), self.rank - self.below + 1)


def _first(df: DataFrame, exprs: list[Column]) -> tuple:
    return tuple(df.agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def _count(df: DataFrame, pairs: list[tuple[_Target, float]]) -> None:
    """Narrow targets by exact counts at one end each, all in one pass."""
    tallies = _first(
        df, [F.count_if(F.col(t.col) < e) for t, e in pairs] + [F.count_if(F.col(t.col) == e) for t, e in pairs]
    )
    for (t, end), below, equal in zip(pairs, tallies, tallies[len(pairs) :]):
        t.narrow(end, below, equal)


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    few: int = FEW,
    accuracy: int = ACCURACY,
    hints: dict[str, list[float]] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between order statistics, NULLs ignored.

    ``hints`` are values per column that are counted first, such as the ends of a bracket known from elsewhere.
    """
    values = df.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _quantiles(values, columns, probs, few, accuracy, hints or {})
    finally:
        values.unpersist()


def _quantiles(
    df: DataFrame, columns: list[str], probs: list[float], few: int, accuracy: int, hints: dict[str, list[float]]
) -> dict[str, list[float | None]]:
    counts = dict(zip(columns, _first(df, [F.count(c) for c in columns])))
    targets = {}
    for c, n in counts.items():
        for p in probs if n else []:
            for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                targets.setdefault((c, rank), _Target(c, rank, inside=n))

    def still_open() -> list[_Target]:
        return [t for t in targets.values() if t.value is None and t.inside > few]

    hinted = [(t, end) for t in still_open() for end in hints.get(t.col, ())]
    if hinted:
        _count(df, hinted)
    while open_ := still_open():
        ends = _first(df, [t.bracket(accuracy) for t in open_])
        _count(df, [(t, end) for t, two in zip(open_, ends) for end in two])
    left = [t for t in targets.values() if t.value is None]
    if left:
        for t, v in zip(left, _first(df, [t.pick() for t in left])):
            t.value = v

    def quantile(c: str, p: float) -> float | None:
        n = counts[c]
        if not n:
            return None
        at = p * (n - 1)
        lo, hi = (targets[c, r].value for r in (math.floor(at), math.ceil(at)))
        return lo + (hi - lo) * (at - math.floor(at))

    return {c: [quantile(c, p) for p in probs] for c in columns}
