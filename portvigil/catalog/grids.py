"""Parameters shared by the registered queries and the SQL that checks them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

RANGE = (datetime(2024, 1, 5, 6, 20), datetime(2024, 1, 20, 18, 40))
PORT = ("dev-click", 0, 1)


@dataclass(frozen=True)
class Grid:
    """Interval and settings a group of queries runs with."""

    minutes: int
    percentile: float
    slope_threshold: float
    rul_target: float = 90.0


FINE = Grid(30, 95.0, 0.002)
COARSE = Grid(360, 90.0, 0.05)
#: A low threshold, so that the latest slots hold critical ports.
LOUD = Grid(360, 35.0, 0.05)
#: Cycles of the streaming replay.
CYCLES = 20
