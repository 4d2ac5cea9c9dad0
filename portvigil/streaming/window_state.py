"""Sliding windows of a stream: every port keeps its last slots in a ring buffer of the state store.

A micro-batch brings new slots only.  A window is sent once, when the last of its slots has come; slots may come
in any order as long as the buffer still holds their window, ``spare`` slots beyond a window's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from portvigil.operators.windows import z
from portvigil.spec import KEYS, TREND_SLOTS, WINDOW_SIZE, TrackSpec

STATE = "slots array<long>, metrics array<array<double>>"


class Ring:
    """The newest slots of a port, at most ``size`` consecutive slot numbers."""

    def __init__(self, size: int, slots: list[int], metrics: list[list[float]]):
        self.size, self.held = size, dict(zip(slots, metrics, strict=True))
        self.newest = max(slots, default=None)

    def add(self, slot: int, metrics: list[float], window: int) -> list[int]:
        """Ends of the windows that this slot completes, oldest first; none if it is held already or comes too late."""
        if slot in self.held or (self.newest is not None and slot <= self.newest - self.size):
            return []
        self.held[slot] = metrics
        if self.newest is None or slot > self.newest:
            self.newest = slot
            self.held = {s: m for s, m in self.held.items() if s > slot - self.size}
        ends = range(slot, min(slot + window - 1, self.newest) + 1)
        return [e for e in ends if all(s in self.held for s in range(e - window + 1, e + 1))]


class WindowProcessor(StatefulProcessor):
    """Per port: reads its ring once per micro-batch, adds the new slots in order, stores it once."""

    def __init__(self, features: list[str], window: int, spare: int):
        self.features, self.window, self.spare = features, window, spare

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self.ring.get()
        slots, metrics = ([int(s) for s in stored[0]], [list(m) for m in stored[1]]) if stored else ([], [])
        ring = Ring(self.window + self.spare, slots, metrics)
        n = len(self.features)
        # a port has one row per slot of the calendar, so its rows of a micro-batch are few
        arrived = pd.concat(rows).dropna(subset=self.features).sort_values("slot_idx", kind="stable")
        out = []
        for slot, *values in arrived[["slot_idx", *self.features, *map(z, self.features)]].itertuples(index=False):
            for end in ring.add(int(slot), [float(v) for v in values], self.window):
                frame = [ring.held[s] for s in range(end - self.window + 1, end + 1)]
                out.append([*key, end, *frame[-1][:n], [m[n:] for m in frame]])
        kept = sorted(ring.held)
        self.ring.update((kept, [ring.held[s] for s in kept]))
        yield pd.DataFrame(out, columns=[*KEYS, "slot_idx", *self.features, "seq"])

    def close(self) -> None:
        pass


def window_stream(scaled: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE, spare: int = TREND_SLOTS) -> DataFrame:
    """The stream form of ``sliding_windows``: (keys, ``slot_idx``, metrics, ``seq``) of every complete window, once.

    ``scaled`` is a stream of scaled slots.  A slot with a missing metric is a hole.  A slot that comes again is
    left out; one that comes more than ``spare`` slots after a later one completes only the windows that the ring
    still holds whole.  Needs the RocksDB state provider (``state.rocksdb_state``) when the query is started.
    """
    fields = [scaled.schema[c] for c in (*KEYS, "slot_idx", *spec.features)]
    out = T.StructType([*fields, T.StructField("seq", T.ArrayType(T.ArrayType(T.DoubleType())))])
    rows = scaled.select(*KEYS, "slot_idx", *spec.features, *map(z, spec.features))
    processor = WindowProcessor(list(spec.features), window_size, spare)
    return rows.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None"
    )
