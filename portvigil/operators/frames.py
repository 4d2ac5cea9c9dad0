"""Window frames.  All of them cluster on the port, so one shuffle serves a whole pipeline."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec

from portvigil.spec import KEYS, WINDOW_SIZE

_PORT = f"partition by {', '.join(KEYS)}"
OVER_PORT = f"over ({_PORT})"
OVER_PORT_BY_SLOT = f"over ({_PORT} order by slot_idx)"


def port() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def over_trailing(window_size: int = WINDOW_SIZE) -> str:
    """The current slot and the ``window_size - 1`` slots before it, by slot number and not by row."""
    return f"over ({_PORT} order by slot_idx range between {window_size - 1} preceding and current row)"
