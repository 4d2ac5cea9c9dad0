"""Row-wise scoring rules as SQL expression text."""

from __future__ import annotations

from portvigil.spec import ALARM_TIERS, NORMAL_TIER


def finite_or_null(x: str) -> str:
    """NaN and infinities become NULL.  Spark orders NaN above every number, which no rule here means."""
    return f"case when abs({x}) < double('infinity') then {x} end"


def mean_square(errors: list[str]) -> str:
    """Mean of the squared errors."""
    return f"({' + '.join(f'({e}) * ({e})' for e in errors)}) / {len(errors)}"


def flag_anomaly(score: str, threshold: str | float) -> str:
    return f"coalesce({score} > {threshold}, false)"


def severity(score: str, threshold: str | float) -> str:
    """0..50 linear up to the threshold, then 50..100 saturating."""
    ratio = f"({score} / nullif({threshold}, 0))"
    above = f"50.0D + 50.0D * (1.0D - exp(-0.5D * ({ratio} - 1.0D)))"
    return f"case when {threshold} <= 0 then 0.0D when {ratio} <= 1 then {ratio} * 50.0D else {above} end"


def _tier(sev: str, field: int, normal: str) -> str:
    """First tier whose limit is reached; what is not a number counts as normal."""
    quoted = [f"when {sev} >= {t[0]} then {t[field]!r}" for t in ALARM_TIERS]
    return f"case when {sev} is null or isnan({sev}) then {normal} {' '.join(quoted)} else {normal} end"


def alarm_level(sev: str) -> str:
    return _tier(sev, 1, repr(NORMAL_TIER[0]))


def alarm_label(sev: str) -> str:
    return _tier(sev, 2, repr(NORMAL_TIER[1]))


def slope_label(slope: str, slope_threshold: str | float) -> str:
    return (
        f"case when {slope} > {slope_threshold} then 'RISING' "
        f"when {slope} < -({slope_threshold}) then 'FALLING' else 'STABLE' end"
    )


def time_to_failure(label: str, sev: str, slope: str, target: str | float, interval_minutes: int) -> str:
    """Minutes until the severity line reaches ``target``, whole intervals, only while rising below it."""
    steps = f"ceil(({target} - {sev}) / {slope})"
    return f"case when {label} = 'RISING' and {sev} < {target} then cast({steps} * {interval_minutes} as double) end"


def packets_back(x: str) -> str:
    """Packet count of a log value, to the nearest integer; NULL when it does not fit."""
    return f"try_cast(round(expm1({x})) as bigint)"
