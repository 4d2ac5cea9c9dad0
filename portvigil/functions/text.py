"""Text rendering as SQL expression text.

Decimals are built from rounded integers, so every engine prints the same digits.
"""

from __future__ import annotations

from portvigil.functions.times import time_text
from portvigil.spec import DEAD_POWER, HIGH_ERROR_PACKETS, OPTICAL, TRAFFIC, WEAK_POWER, TrackSpec


def fixed(x: str, digits: int) -> str:
    """``x`` with a fixed number of decimals, NULL where it has no finite value."""
    scale = 10**digits
    units = f"try_cast(round(({x}) * {scale}) as bigint)"
    whole, frac = f"cast(abs({units}) div {scale} as string)", f"cast(abs({units}) % {scale} as string)"
    return f"concat(if({units} < 0, '-', ''), {whole}, '.', lpad({frac}, {digits}, '0'))"


def whole_number(x: str) -> str:
    return f"coalesce(cast({x} as string), '0')"


def reason_text(spec: TrackSpec, flag: str) -> str:
    """Why a track flagged the row; ``NORMAL`` when it did not."""
    if spec.name == TRAFFIC.name:
        tx, rx, err = spec.features
        errors = f"if({err} > 0, concat(', Err:', {whole_number(err)}), '')"
        text = f"concat('Traffic (TX:', {whole_number(tx)}, ', RX:', {whole_number(rx)}, {errors}, ')')"
    else:
        tx, rx = spec.features
        text = f"concat('Optical (RX:', {fixed(rx, 2)}, ', TX:', {fixed(tx, 2)}, ')')"
    return f"case when {flag} then {text} else 'NORMAL' end"


def join_reasons(pairs: list[tuple[str, str]]) -> str:
    """Reasons of the flagged tracks joined by `` + ``; ``pairs`` are (flag, reason)."""
    joined = f"concat_ws(' + ', {', '.join(f'case when {flag} then {reason} end' for flag, reason in pairs)})"
    return f"coalesce(nullif({joined}, ''), 'NORMAL')"


def diagnosis(spec: TrackSpec) -> str:
    """Rule label for the last reading of a port."""
    if spec.name == OPTICAL.name:
        tx, rx = spec.features
        return (
            f"case when {rx} <= {DEAD_POWER} then 'Signal Lost (RX: -40dBm)' "
            f"when {rx} < {WEAK_POWER} then concat('Weak Signal (RX: ', {fixed(rx, 2)}, 'dBm)') "
            f"else concat('Power Fluctuation (TX: ', {fixed(tx, 2)}, ', RX: ', {fixed(rx, 2)}, ')') end"
        )
    tx, _, err = spec.features
    return (
        f"case when {err} > {HIGH_ERROR_PACKETS} then concat('High Error Packets (', {whole_number(err)}, ' pkts)') "
        f"else concat('Traffic Anomaly (TX: ', {whole_number(tx)}, ' pkts)') end"
    )


def format_ttf(minutes: str) -> str:
    """``2h 15m``, ``45m`` or ``N/A``."""
    hours = f"cast(floor({minutes} / 60) as bigint)"
    rest = f"cast(round({minutes} - {hours} * 60) as bigint)"
    return (
        f"case when {minutes} is null then 'N/A' when {hours} > 0 then concat({hours}, 'h ', {rest}, 'm') "
        f"else concat({rest}, 'm') end"
    )


def port_label(slot: str, port: str) -> str:
    return f"concat('S', {slot}, '/P', {port})"


def severity_text(severity: str) -> str:
    return f"concat({fixed(severity, 1)}, '%')"


def slope_text(slope: str) -> str:
    return f"concat('+', {fixed(slope, 2)})"


def fatal_text(ttf: str, fatal_time: str) -> str:
    """When a port is expected to turn critical; a ttf of NULL or 0 is still being computed."""
    ready = f"concat({time_text(fatal_time)}, ' (', {format_ttf(ttf)}, ' later)')"
    return f"if(coalesce({ttf}, 0) <> 0, {ready}, 'Calculating...')"
