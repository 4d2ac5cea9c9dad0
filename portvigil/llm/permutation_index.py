"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  Every pivot has an inverted file of (vector,
position of the pivot in the vector's order).  A query walks the files of its own nearest pivots, adds up the
footrule distance (difference of positions; an absent pivot counts as the position after the last), and the
nearest by footrule are reranked by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from portvigil.llm import blocks

PIVOTS = 256
LENGTH = 64
#: Share of a shard's different vectors that is reranked, and the least number.
RERANK_SHARE = 0.1
RERANK_LEAST = 256


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _moderate(v: np.ndarray) -> np.ndarray:
    """Every row times a power of two that brings its largest component near one: no square overflows or vanishes,
    and nothing is rounded."""
    _, exponent = np.frexp(np.abs(v).max(axis=-1, keepdims=True))
    return np.ldexp(v, -exponent)


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that equal vectors get equal scores."""
    v, q = _moderate(v), _moderate(q)
    return (v * q).sum(axis=1) / np.sqrt((v * v).sum(axis=1)) / np.sqrt((q * q).sum())


class PermutationIndex:
    """Of one shard.  Its pivots are a seeded random choice of its different vectors."""

    def __init__(self, vectors: np.ndarray, pivots: int = PIVOTS, length: int = LENGTH):
        n = len(vectors)
        unit = _unit(vectors)
        chosen = np.random.default_rng(0).permutation(n)[:pivots]
        self.pivots = unit[chosen]
        self.length = min(length, len(chosen))
        order = self.permutation(unit)
        # inverted files: the (vector, position) pairs sorted by pivot
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.vector = (by_pivot // self.length).astype(np.int32)
        self.position = (by_pivot % self.length).astype(np.int32)
        self.start = np.searchsorted(order.ravel()[by_pivot], np.arange(len(chosen) + 1))
        self.size = n

    def permutation(self, unit: np.ndarray) -> np.ndarray:
        near = unit @ self.pivots.T
        return np.argsort(-near, axis=1, kind="stable")[:, : self.length].astype(np.int32)

    def footrule(self, permutation: np.ndarray) -> np.ndarray:
        """Distance of every vector to a query's permutation, up to a constant."""
        total = np.zeros(self.size, dtype=np.int32)
        for at, pivot in enumerate(permutation):
            files = slice(self.start[pivot], self.start[pivot + 1])
            position = self.position[files]
            # both absent positions are ``length``: what meeting at this pivot saves
            total[self.vector[files]] += np.abs(position - at) - (self.length - at) - (self.length - position)
        return total


def kernel(k: int, pivots: int, length: int, share: float, least: int) -> blocks.Kernel:
    def build(ids: np.ndarray, v: np.ndarray) -> blocks.Answer:
        # copies share one entry; of their ids the k + 1 smallest can be wanted
        different, which = np.unique(v, axis=0, return_inverse=True)
        which = which.ravel()
        by_entry = np.lexsort((ids, which))
        start = np.searchsorted(which[by_entry], np.arange(len(different) + 1))
        index = PermutationIndex(different, pivots, length)
        wanted = min(len(different), max(least, int(share * len(different))))

        def answer(_: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for q, permutation in zip(asked, index.permutation(_unit(asked)) if len(asked) else [], strict=True):
                near = np.argpartition(index.footrule(permutation), wanted - 1)[:wanted]
                scores = cosine(different[near], q)
                top = np.argsort(-scores, kind="stable")[: k + 1]
                # all entries as good as the last one, since ties go to the smaller id
                top = np.flatnonzero(scores >= scores[top[-1]])
                copies = [by_entry[start[e] : min(start[e + 1], start[e] + k + 1)] for e in near[top]]
                yield ids[np.concatenate(copies)], np.repeat(scores[top], [len(c) for c in copies])

        return answer

    return build


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    query_every: int = 50,
    pivots: int = PIVOTS,
    length: int = LENGTH,
    share: float = RERANK_SHARE,
    least: int = RERANK_LEAST,
    shard_rows: int = blocks.SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by cosine.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part;
    an empty table gives no rows; ties go to the smaller id; copies are found together, with equal scores;
    rows that repeat an id and a vector count once, all different vectors of an id count; other columns are not read.
    Every remaining row is indexed.
    """
    rows = blocks.usable(df, id_col, vec_col, nonzero=True)
    return blocks.search(rows, kernel(k, pivots, length, share, least), k, "double", query_every, shard_rows)
