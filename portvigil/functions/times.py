"""Grid arithmetic on naive timestamps, as SQL expression text.

A reading belongs to grid slot ``n`` = nearest multiple of the interval since 1970, ties to the even
slot.  Slots are kept as integers (``slot_idx``) until the last projection, so neighbours differ by 1
and no step depends on the session time zone.

Expressions are text because one parsed string costs one call into the JVM, where the same expression
built from columns costs dozens; plans here have hundreds of operators.
"""

from __future__ import annotations

from datetime import datetime

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def ntz(moment: datetime) -> str:
    """Literal of a naive time, independent of any zone."""
    return f"timestamp_ntz'{moment.isoformat(' ')}'"


def to_ntz(ts: str) -> str:
    """Naive timestamp, NULL where the value is not a time."""
    return f"try_cast({ts} as timestamp_ntz)"


def micros_per_slot(interval_minutes: int) -> int:
    return interval_minutes * 60_000_000


def epoch_micros(ts: str) -> str:
    """Microseconds since 1970 of a naive timestamp, read field by field (no zone involved)."""
    minutes = f"(unix_date(cast({ts} as date)) * 24L + hour({ts})) * 60L + minute({ts})"
    return f"({minutes}) * 60000000L + cast(extract(second from {ts}) * 1000000 as bigint)"


def nearest_slot(micros: str, interval_minutes: int) -> str:
    """Index of the nearest grid slot, half-way readings go to the even one."""
    n = f"{micros_per_slot(interval_minutes)}L"
    rest = f"pmod({micros}, {n})"
    floor = f"({micros} - {rest}) div {n}"
    return f"{floor} + if(2 * {rest} > {n} or (2 * {rest} = {n} and pmod({floor}, 2) = 1), 1, 0)"


def slot_time(idx: str, interval_minutes: int) -> str:
    """Timestamp of a slot index."""
    return f"timestampadd(MINUTE, {idx} * {interval_minutes}, {EPOCH})"


def slot_round(ts: str, interval_minutes: int) -> str:
    return slot_time(f"({nearest_slot(f'({epoch_micros(ts)})', interval_minutes)})", interval_minutes)


def hour_key(ts: str) -> str:
    """Name of the hour shard holding a timestamp, ``yyyy-MM-dd-HH``."""
    return f"translate(substr(cast({ts} as string), 1, 13), ' ', '-')"


def time_text(ts: str) -> str:
    """``yyyy-MM-dd HH:mm:ss``; casting to text involves no zone, formatting functions do."""
    return f"substr(cast({ts} as string), 1, 19)"


def clock_label(ts: str) -> str:
    """``HH:mm`` axis label."""
    return f"substr(cast({ts} as string), 12, 5)"
