"""What Python workers keep: a bounded cache, from batch to batch and task to task; and small batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

#: Rows with long texts that are held as Python objects at a time.
ROWS_AT_ONCE = 256


class WorkerCache(dict):
    """``cache[key]`` is ``compute(key)``; at most twice ``limit`` results are kept.

    Two generations: when the young one is full it becomes the old one, and what is used again moves back, so
    frequent keys stay and rare ones go.  Results never depend on what is cached.
    """

    def __init__(self, compute: Callable[[Hashable], Any], limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: Hashable) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_shared: dict[Hashable, Any] = {}


def per_worker(name: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returned when this worker process first asked for ``name``."""
    if name not in _shared:
        _shared[name] = make()
    return _shared[name]


def forget(*kept: Hashable) -> None:
    """Drop what this worker keeps for other steps, all but the names ``kept``: a worker outlives its step."""
    others = [name for name in _shared if name not in kept]
    for name in others:
        del _shared[name]
    if others:
        gc.collect()  # a cache and what fills it refer to each other


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
