"""DuckDB SQL saying what each registered query must return.

Written independently of the Spark code: full calendar grids instead of generated edges, row frames
instead of slot ranges, explicit joins instead of windows.
"""

from __future__ import annotations

from portvigil.catalog.grids import COARSE, CYCLES, FINE, LOUD, PORT, RANGE, Grid

W = 12
K = "ip_addr, cid, lid"

EVENTS = "(select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e"

TRAFFIC_RAW = f"""
select ts as occur_date, concat('dev-', event_type) as ip_addr,
       cast(user_id % 2 as int) as cid, cast(1 as int) as lid,
       cast(case when user_id % 10 = 9 then 44 else 6 end as int) as signal_type,
       case when k = 13 then null else cast(floor(value * 100) as bigint) end as tx_packet,
       cast(floor(value * 95) as bigint) as rx_packet,
       cast(case when event_type = 'view' and user_id % 2 = 1 and k = 99 then 1001
                 when k >= 90 then k - 90 else 0 end as bigint) as error_packet
from {EVENTS}"""

OPTICAL_RAW = f"""
select ts as occur_date, concat('dev-', event_type) as ip_addr,
       cast(user_id % 2 as int) as cid, cast(1 as int) as lid,
       case when event_type = 'signup' and user_id % 2 = 1 then cast(-40 as double)
            else cast(-5 as double) - cast(k as double) / 50 end as tx_avg_power,
       case when event_type = 'signup' and user_id % 2 = 1 then cast(-40 as double)
            else cast(-8 as double) - value / 25 end as rx_avg_power
from {EVENTS} where k % 8 <> 0"""

FEATURES = {
    "traffic": ["tx_packet", "rx_packet", "error_packet"],
    "optical": ["tx_avg_power", "rx_avg_power"],
}

RAW = [
    ("traffic_all", TRAFFIC_RAW),
    ("traffic_eth", "select * exclude (signal_type) from traffic_all where signal_type = 6"),
    ("optical_all", OPTICAL_RAW),
    ("as_of", "select max(ts) as now, cast(cast(max(ts) as date) - 7 as timestamp) as cutoff from events"),
]


def slot_time(idx: str, minutes: int) -> str:
    return f"make_timestamp(({idx}) * {minutes * 60_000_000}::bigint)"


def slot_idx(ts: str, minutes: int) -> str:
    n = f"{minutes * 60_000_000}::bigint"
    q, r = f"(epoch_us({ts}) // {n})", f"(epoch_us({ts}) % {n})"
    return f"({q} + case when 2 * {r} > {n} or (2 * {r} = {n} and {q} % 2 = 1) then 1 else 0 end)"


def fixed(x: str, digits: int) -> str:
    s = 10**digits
    u = f"cast(round(({x}) * {s}) as bigint)"
    return (
        f"(case when {u} < 0 then '-' else '' end || cast(abs({u}) // {s} as varchar) || '.' || "
        f"lpad(cast(abs({u}) % {s} as varchar), {digits}, '0'))"
    )


def complete(track: str) -> str:
    return " and ".join(f"{f} is not null" for f in FEATURES[track])


def cleaned(p: str, track: str, source: str, train: bool, minutes: int) -> list[tuple[str, str]]:
    """Steps from raw rows of ``source`` to interpolated rows, each a CTE prefixed with ``p``."""
    fs = FEATURES[track]
    cast = ", ".join(f"cast({f} as double) as {f}" for f in fs)
    desc = ", ".join(f"{f} desc" for f in fs)
    steps = [
        (f"{p}slotted", f"select {K}, occur_date, {slot_idx('occur_date', minutes)} as s, {cast} from {source}"),
        (
            f"{p}dedup",
            f"select {K}, s, {', '.join(fs)} from {p}slotted qualify row_number() over "
            f"(partition by {K}, s order by occur_date desc, {desc}) = 1",
        ),
    ]
    kept = f"{p}dedup"
    if train:
        steps += [(f"{p}ports", valid_ports(track, f"{p}dedup"))]
        steps += [(f"{p}kept", f"select d.* from {p}dedup d join {p}ports using ({K})")]
        kept = f"{p}kept"
    if track == "traffic":
        logs = ", ".join(
            f"case when {f} is null then null else ln(1 + greatest({f}, 0)) end as {f}" for f in fs
        )
        steps += [(f"{p}moved", f"select {K}, s, {logs} from {kept}")]
    else:
        steps += [(f"{p}moved", f"select {K}, s, {', '.join(fs)} from {kept}")]
    steps += grid(p, fs)
    return steps


def valid_ports(track: str, source: str) -> str:
    if track == "traffic":
        good = "not bool_or(coalesce(error_packet > 1000 or tx_packet > 1e9 or rx_packet > 1e9, false))"
    else:
        good = "not bool_and(coalesce(tx_avg_power <= -39.9 and rx_avg_power <= -39.9, false))"
    return (
        f"select {K} from {source} group by {K} "
        f"having count(*) filter (where {complete(track)}) >= {2 * W} and {good}"
    )


def grid(p: str, fs: list[str]) -> list[tuple[str, str]]:
    """Calendar of each port, its readings, and the bounded interpolation."""
    cols = ", ".join(f"m.{f}" for f in fs)
    part = f"partition by {K} order by s"
    around, filled = [], []
    for f in fs:
        back = f"over ({part} rows between unbounded preceding and current row)"
        ahead = f"over ({part} rows between current row and unbounded following)"
        at = f"case when {f} is not null then s end"
        around += [
            f"last_value({f} ignore nulls) {back} as pv_{f}",
            f"last_value({at} ignore nulls) {back} as pi_{f}",
            f"first_value({f} ignore nulls) {ahead} as nv_{f}",
            f"first_value({at} ignore nulls) {ahead} as ni_{f}",
        ]
        filled += [
            f"case when {f} is not null then {f} when s - pi_{f} = 1 or ni_{f} - s = 1 then "
            f"case when pv_{f} is null then nv_{f} when nv_{f} is null then pv_{f} else "
            f"pv_{f} + (nv_{f} - pv_{f}) * (s - pi_{f}) / (ni_{f} - pi_{f}) end end as {f}"
        ]
    return [
        (
            f"{p}calendar",
            f"select {K}, unnest(range(lo, hi + 1)) as s from "
            f"(select {K}, min(s) as lo, max(s) as hi from {p}moved group by {K})",
        ),
        (f"{p}grid", f"select c.*, {cols} from {p}calendar c left join {p}moved m using ({K}, s)"),
        (f"{p}around", f"select *, {', '.join(around)} from {p}grid"),
        (f"{p}clean", f"select {K}, s, {', '.join(filled)} from {p}around"),
    ]


def scaler(p: str, track: str) -> list[tuple[str, str]]:
    """Median and IQR of each metric as one row."""
    cols = []
    for f in FEATURES[track]:
        iqr = f"quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)"
        cols += [f"quantile_cont({f}, 0.5) as c_{f}", f"case when {iqr} = 0 then 1 else {iqr} end as d_{f}"]
    return [(f"{track}_scaler", f"select {', '.join(cols)} from {p}clean where {complete(track)}")]


def scored(p: str, track: str) -> list[tuple[str, str]]:
    """Window-mean scores of the cleaned rows."""
    fs = FEATURES[track]
    frame = f"over (partition by {K} order by s rows between {W - 1} preceding and current row)"
    zs = ", ".join(f"({f} - c_{f}) / d_{f} as z_{f}" for f in fs)
    means = ", ".join(f"avg(z_{f}) {frame} as a_{f}" for f in fs)
    mse = " + ".join(f"(z_{f} - a_{f}) * (z_{f} - a_{f})" for f in fs)
    loss = " + ".join(f"v_{f}" for f in fs)
    spread = ", ".join(f"var_pop(z_{f}) {frame} as v_{f}" for f in fs)
    return [
        (f"{p}scaled", f"select c.*, {zs} from {p}clean c, {track}_scaler"),
        (
            f"{p}framed",
            f"select *, {means}, {spread}, count(*) filter (where {complete(track)}) {frame} as n from {p}scaled",
        ),
        (
            f"{p}scored",
            f"select {K}, s, {', '.join(fs)}, ({mse}) / {len(fs)} as score, ({loss}) / {len(fs)} as loss "
            f"from {p}framed where n = {W}",
        ),
    ]


def judged(p: str, track: str, percentile: float) -> list[tuple[str, str]]:
    """Threshold from training scores, then flag, severity, slope and reason of all scores."""
    if track == "traffic":
        back = ", ".join(f"cast(round(exp({f}) - 1) as bigint) as {f}" for f in FEATURES[track])
        reason = (
            "'Traffic (TX:' || tx_packet || ', RX:' || rx_packet || "
            "case when error_packet > 0 then ', Err:' || error_packet else '' end || ')'"
        )
    else:
        back = ", ".join(FEATURES[track])
        reason = f"'Optical (RX:' || {fixed('rx_avg_power', 2)} || ', TX:' || {fixed('tx_avg_power', 2)} || ')'"
    return [
        (f"{track}_th", f"select quantile_cont(score, {percentile / 100}) as th from {p}train_scored"),
        (
            f"{p}judged",
            f"select b.*, th as threshold, score > th as flag, case when th <= 0 then 0 when score / th <= 1 "
            f"then score / th * 50 else 50 + 50 * (1 - exp(-0.5 * (score / th - 1))) end as severity, "
            f"row_number() over (partition by {K} order by s) - 1 as pos "
            f"from {p}scored b, {track}_th",
        ),
        (
            f"{p}trend",
            f"select *, coalesce(regr_slope(severity, pos) over (partition by {K}), 0) as slope from {p}judged",
        ),
        (f"{p}back", f"select * exclude ({', '.join(FEATURES[track])}), {back} from {p}trend"),
        (f"{p}done", f"select *, case when flag then {reason} else 'NORMAL' end as reason from {p}back"),
    ]


def fused(g: Grid) -> list[tuple[str, str]]:
    t, o = FEATURES["traffic"], FEATURES["optical"]
    sides = []
    for side, track, fs in (("a", "traffic", t), ("b", "optical", o)):
        sides += [f"coalesce({side}.{f}, 0) as {f}" for f in fs]
        sides += [f"coalesce({side}.{c}, 0) as {track}_{c}" for c in ("score", "severity")]
        sides += [f"{side}.{c} as {track}_{c}" for c in ("slope", "threshold")]
        sides += [
            f"coalesce({side}.flag, false) as is_{track}_anomaly",
            f"coalesce({side}.reason, 'NORMAL') as {track}_reason",
        ]
    pick = ", ".join(
        f"case when traffic_severity >= optical_severity then traffic_{c} else optical_{c} end as {a}"
        for c, a in (("score", "anomaly_score"), ("severity", "severity"), ("slope", "slope"), ("threshold", "threshold"))
    )
    return [
        (
            "joined",
            f"select {slot_time('coalesce(a.s, b.s)', g.minutes)} as occur_date, coalesce(a.ip_addr, b.ip_addr) as ip_addr, "
            f"coalesce(a.cid, b.cid) as cid, coalesce(a.lid, b.lid) as lid, {', '.join(sides)} "
            "from t_done a full join o_done b on a.ip_addr = b.ip_addr and a.cid = b.cid and a.lid = b.lid and a.s = b.s",
        ),
        (
            "decided",
            f"select *, {pick}, is_traffic_anomaly or is_optical_anomaly as is_anomaly, "
            "case when is_traffic_anomaly and is_optical_anomaly then traffic_reason || ' + ' || optical_reason "
            "when is_traffic_anomaly then traffic_reason when is_optical_anomaly then optical_reason "
            "else 'NORMAL' end as anomaly_reason from joined",
        ),
        (
            "labelled",
            f"select *, case when slope > {g.slope_threshold} then 'RISING' when slope < -{g.slope_threshold} "
            "then 'FALLING' else 'STABLE' end as slope_label, "
            "cast(case when severity >= 90 then 3 when severity >= 70 then 2 when severity >= 50 then 1 else 0 end as int) "
            "as alarm_level from decided",
        ),
        (
            "timed",
            f"select *, case when slope_label = 'RISING' and severity < {g.rul_target} "
            f"then cast(ceil(({g.rul_target} - severity) / slope) * {g.minutes} as double) end as ttf_minutes, "
            "case alarm_level when 3 then 'CRITICAL' when 2 then 'MAJOR' when 1 then 'MINOR' else 'NORMAL' end as alarm_label "
            "from labelled",
        ),
        (
            "results",
            "select *, occur_date + to_minutes(cast(ttf_minutes as bigint)) as expected_fatal_time from timed",
        ),
    ]


def with_ctes(steps: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} as ({sql})" for name, sql in steps)
    return f"with {body}\n{final}"


# --- what each query returns -----------------------------------------------------------------------

TRACK_PREFIX = {"traffic": ("t_", "traffic_eth"), "optical": ("o_", "optical_all")}
KEY_COLS = ["ip_addr", "cid", "lid"]
TIMED = {g.minutes: f"{slot_time('s', g.minutes)} as occur_date, {K}" for g in (FINE, COARSE)}


def training(track: str, g: Grid) -> list[tuple[str, str]]:
    """Training rows before the cut-off, their scaler and scores."""
    p, source = TRACK_PREFIX[track]
    steps = [(f"{p}before", f"select r.* from {source} r, as_of where occur_date < cutoff")]
    steps += cleaned(f"{p}train_", track, f"{p}before", True, g.minutes)
    return steps + scaler(f"{p}train_", track) + scored(f"{p}train_", track)


def track_steps(track: str, g: Grid, within: str = "") -> list[tuple[str, str]]:
    """Training and scoring of a track; ``within`` limits the rows that are scored."""
    p, source = TRACK_PREFIX[track]
    steps = training(track, g)
    if within:
        steps += [(f"{p}recent", f"select r.* from {source} r, as_of where {within}")]
        source = f"{p}recent"
    steps += cleaned(p, track, source, False, g.minutes)
    return steps + scored(p, track) + judged(p, track, g.percentile)


def chain(g: Grid, within: str = "") -> list[tuple[str, str]]:
    return RAW + track_steps("traffic", g, within) + track_steps("optical", g, within) + fused(g)


def on(track: str, final: str, g: Grid = FINE) -> str:
    return with_ctes(RAW + track_steps(track, g), final)


def over_results(final: str, g: Grid = COARSE, extra: list[tuple[str, str]] | None = None) -> str:
    return with_ctes(chain(g) + (extra or []), final)


def clean_of(track: str, final: str, train: bool = False) -> str:
    p, source = TRACK_PREFIX[track]
    return with_ctes(RAW + cleaned(p, track, source, train, FINE.minutes), final)


def r(*columns: str, digits: int = 6) -> str:
    """Columns rounded under their own names."""
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


TRACK_OUT = {
    t: ["score", "severity", "slope", "threshold"] for t in FEATURES
}
PACKETS, POWERS = FEATURES["traffic"], FEATURES["optical"]
TRACK_DOUBLES = [f"{t}_{c}" for t in FEATURES for c in TRACK_OUT[t]]
STANDARD = ", ".join(
    [
        f"occur_date, {K}, {', '.join(PACKETS)}",
        r(*POWERS, *TRACK_DOUBLES, "anomaly_score", "severity", "slope", "threshold"),
        "is_traffic_anomaly, is_optical_anomaly, slope_label, is_anomaly, alarm_level, alarm_label, ttf_minutes, "
        "expected_fatal_time, anomaly_reason",
    ]
)
# Stored rows hold 0 where a track had nothing to say.
STANDARD_STORED = STANDARD
for _t in FEATURES:
    for _c in ("slope", "threshold"):
        STANDARD_STORED = STANDARD_STORED.replace(
            f"round({_t}_{_c}, 6) as {_t}_{_c}", f"coalesce(round({_t}_{_c}, 6), 0) as {_t}_{_c}"
        )
for _c in ("slope", "threshold"):
    STANDARD_STORED = STANDARD_STORED.replace(f", round({_c}, 6) as {_c}", f", coalesce(round({_c}, 6), 0) as {_c}")
TEXT_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def text_time(c: str) -> str:
    return TEXT_TIME.format(c) + f" as {c}"


SNAPSHOT = ", ".join(
    [
        text_time("occur_date"),
        "ip_addr, cid as slot_id, lid as port_id",
        r("severity", "slope"),
        "alarm_level, alarm_label, slope_label, ttf_minutes",
        text_time("expected_fatal_time"),
        "anomaly_reason, is_traffic_anomaly, is_optical_anomaly",
    ]
)
HISTORY = ", ".join(
    [
        text_time("occur_date"),
        ", ".join(PACKETS),
        r(*POWERS, "anomaly_score", "threshold", "severity"),
        "alarm_level, alarm_label, anomaly_reason",
        r(*[f"{t}_{c}" for t in FEATURES for c in ("score", "threshold", "severity")]),
        "is_traffic_anomaly, is_optical_anomaly",
    ]
)
LATEST = "occur_date = (select max(occur_date) from results)"
START, END = (f"timestamp '{t}'" for t in RANGE)
OF_PORT = f"ip_addr = '{PORT[0]}' and cid = {PORT[1]} and lid = {PORT[2]}"


def port_rows(days: int) -> str:
    return f"{OF_PORT} and occur_date >= (select now - interval {days} day from as_of)"


def quality_ports(source: str, condition: str) -> str:
    return f"select {K} from {source} group by {K} having {condition}"


CRITICAL = ("criticals", "select * from results where alarm_label = 'CRITICAL'")
TRANSITIONS = [
    CRITICAL,
    (
        "cycles",
        "select occur_date, lead(occur_date) over (order by occur_date) as next_cycle "
        "from (select distinct occur_date from results)",
    ),
    (
        "transitions",
        "select 'ALARM' as type, occur_date as event_time, ip_addr, cid as slot_id, lid as port_id, "
        "alarm_label as severity, anomaly_reason as message from criticals union all "
        "select 'CLEAR', next_cycle, ip_addr, cid, lid, null, 'Alarm cleared' from criticals c join cycles "
        "using (occur_date) where next_cycle is not null and not exists (select 1 from criticals n where "
        "n.ip_addr = c.ip_addr and n.cid = c.cid and n.lid = c.lid and n.occur_date = next_cycle)",
    ),
    (
        "newest",
        "select * from transitions qualify row_number() over (partition by ip_addr, slot_id, port_id "
        "order by event_time desc) = 1",
    ),
]
VERSIONS = [
    (
        "versions",
        "select 'traffic' as track, 1::bigint as version, (select th from traffic_th) as threshold, "
        "null::double as slope_threshold, (select count(*) from t_train_scored) as samples_used "
        "union all select 'optical', 1, (select th from optical_th), null, (select count(*) from o_train_scored) "
        f"union all select 'traffic', 2, (select th from traffic_th), {FINE.slope_threshold}, "
        "(select count(*) from t_train_scored)",
    ),
    (
        "newest_versions",
        "select track, version, threshold, coalesce(slope_threshold, 1.0) as slope_threshold, "
        "90.0::double as rul_target, samples_used from versions "
        "qualify row_number() over (partition by track order by version desc) = 1",
    ),
]
SETTINGS_OUT = (
    "track, version, round(threshold, 6) as threshold, slope_threshold, rul_target, "
    f"{W}::int as window_size, samples_used"
)
AS_TEXT = (
    "as_text",
    "select case when error_packet = 3 then 'not a time' else strftime(occur_date, '%Y-%m-%d %H:%M:%S') end as occur_date, "
    f"{K}, case when error_packet = 5 then 'n/a' else cast(tx_packet as varchar) end as tx_packet, rx_packet, "
    "error_packet from traffic_eth",
)
SPLIT_DAYS = "cast(now as date)"


def ttf_text(m: str) -> str:
    h = f"cast(floor({m} / 60) as bigint)"
    rest = f"cast(round({m} - {h} * 60) as bigint)"
    return f"case when {m} is null then 'N/A' when {h} > 0 then {h} || 'h ' || {rest} || 'm' else {rest} || 'm' end"


def zone(c: str) -> str:
    return (
        f"case when {c} >= 90 then 'CRITICAL' when {c} >= 70 then 'MAJOR' when {c} >= 50 then 'MINOR' "
        f"else 'NORMAL' end"
    )


def series(columns: list[str]) -> str:
    return " union all ".join(
        f"select strftime(occur_date, '%Y-%m-%d %H:%M:%S') as occur_date, strftime(occur_date, '%H:%M') as label, "
        f"'{c}' as series, round(cast({c} as double), 6) as value from shown"
        for c in columns
    )


def over_stored(final: str, g: Grid = COARSE) -> str:
    """Over the results as the result table keeps them."""
    return over_results(final.replace("from results", "from stored"), g, [("stored", f"select {STANDARD_STORED} from results")])


def replay(final: str) -> str:
    """Over what the cycles of the replay stored: each the latest slot of its own look-back; a later cycle wins."""
    span = f"interval {(W + 4) * LOUD.minutes} minute"
    cycles = []
    for i in range(CYCLES):
        time = f"now - interval {i * LOUD.minutes} minute"
        steps = chain(LOUD, f"occur_date between {time} - {span} and {time}")
        cycles.append(f"select {CYCLES - i} as cycle, * from ({with_ctes(steps, f'select {STANDARD_STORED} from results where {LATEST}')})")
    merged = f"select * exclude (cycle) from every_cycle qualify row_number() over (partition by occur_date, {K} order by cycle desc) = 1"
    return with_ctes([("every_cycle", " union all ".join(cycles)), ("results", merged)] + TRANSITIONS, final)


MESSAGE = (
    "'{\"type\":\"' || type || '\",\"event_time\":\"' || "
    f"{TEXT_TIME.format('event_time')} || '\",\"ip_addr\":\"' || ip_addr || '\",\"slot_id\":' || slot_id || "
    "',\"port_id\":' || port_id || case when severity is null then '' else ',\"severity\":\"' || severity || '\"' end || "
    "',\"message\":\"' || message || '\"}' as value"
)

ORACLES: dict[str, str] = {
    # sources
    "scan_traffic": with_ctes(RAW, f"select * from traffic_eth where occur_date between {START} and {END}"),
    "scan_optical": with_ctes(
        RAW,
        f"select occur_date, {K}, {r(*POWERS)} from optical_all where occur_date between {START} and {END}",
    ),
    "shard_prune": with_ctes(
        RAW,
        "select strftime(occur_date, '%Y-%m-%d-%H') as pm_hour, count(*) as rows from traffic_eth where "
        f"date_trunc('hour', occur_date) between date_trunc('hour', {START}) and date_trunc('hour', {END}) group by 1",
    ),
    "shard_union": with_ctes(
        RAW,
        f"select occur_date, {K}, {', '.join(PACKETS)}, cast(null as double) as tx_avg_power, "
        f"cast(null as double) as rx_avg_power from traffic_eth union all "
        f"select occur_date, {K}, null, null, null, {', '.join(f'round({f}, 6)' for f in POWERS)} from optical_all",
    ),
    # projections, filters, splits
    "project_alias": over_results(
        f"select occur_date, ip_addr, cid as slot_id, lid as port_id, {r('severity')} from results"
    ),
    "project_standard": over_results(f"select {STANDARD} from results"),
    "filter_signal_type": with_ctes(
        RAW,
        f"select occur_date, {K}, signal_type, error_packet as bbe_in_error, tx_packet as es, rx_packet as ses "
        "from traffic_all where signal_type = 6",
    ),
    "filter_time_range": with_ctes(RAW, f"select * from traffic_eth where occur_date between {START} and {END}"),
    "split_by_dates": with_ctes(
        RAW,
        "select t.*, 'train' as split from traffic_eth t, as_of where "
        f"cast(occur_date as date) between {SPLIT_DAYS} - 37 and {SPLIT_DAYS} - 7 union all "
        "select t.*, 'test' from traffic_eth t, as_of where "
        f"cast(occur_date as date) between {SPLIT_DAYS} - 7 and {SPLIT_DAYS}",
    ),
    "split_by_cutoff": with_ctes(
        RAW,
        "select t.*, case when occur_date < cutoff then 'train' else 'test' end as split from traffic_eth t, as_of "
        "where occur_date between now - interval 37 day and now",
    ),
    "split_counts": with_ctes(
        RAW,
        "select track, case when occur_date < cutoff then 'train' else 'test' end as split, count(*) as rows from "
        "(select 'traffic' as track, occur_date from traffic_eth union all select 'optical', occur_date from optical_all), "
        "as_of where occur_date between now - interval 37 day and now group by all",
    ),
    "min_sample_gate": with_ctes(
        RAW,
        f"select count(*) as rows, {W}::int as required, count(*) >= {W} as enough from traffic_eth, as_of "
        "where occur_date < cutoff",
    ),
    "filter_severity": over_results(f"select {STANDARD} from results where alarm_level between 1 and 2"),
    "filter_rising": over_results(f"select {STANDARD} from results where slope_label = 'RISING'"),
    "filter_port_history": over_results(f"select {STANDARD} from results where {port_rows(7)}"),
    "filter_anomalies": over_results(f"select {STANDARD} from results where is_anomaly", FINE),
    "filter_critical": over_results(f"select {STANDARD} from results where alarm_label = 'CRITICAL'"),
    "latest_in_batch": over_results(f"select {STANDARD} from results where {LATEST}"),
    "latest_in_table": over_results(f"select {STANDARD} from results where {LATEST}", FINE),
    "coerce_types": with_ctes(
        RAW + [AS_TEXT],
        f"select try_cast(occur_date as timestamp) as occur_date, {K}, try_cast(tx_packet as double) as tx_packet, "
        "cast(rx_packet as double) as rx_packet, cast(error_packet as double) as error_packet from as_text "
        "where try_cast(occur_date as timestamp) is not null",
    ),
    "coerce_quarantine": with_ctes(
        RAW + [AS_TEXT],
        f"select occur_date, {K}, rx_packet, error_packet from as_text where try_cast(occur_date as timestamp) is null",
    ),
    # cleaning
    "slot_round": with_ctes(
        RAW,
        f"select occur_date, {K}, {slot_time(slot_idx('occur_date', FINE.minutes), FINE.minutes)} as slot from traffic_eth",
    ),
    "slot_tumbling": with_ctes(
        RAW,
        f"select {slot_time(slot_idx('occur_date', 15), 15)} as slot, count(*) as readings from optical_all group by 1",
    ),
    "dedup_last": clean_of("traffic", f"select {TIMED[30]}, {', '.join(PACKETS)} from t_dedup"),
    "quality_min_rows": clean_of(
        "traffic", quality_ports("t_dedup", f"count(*) filter (where {complete('traffic')}) >= {2 * W}")
    ),
    "quality_dead_channel": clean_of(
        "optical",
        quality_ports(
            "o_dedup", "not bool_and(coalesce(tx_avg_power <= -39.9 and rx_avg_power <= -39.9, false))"
        ),
    ),
    "quality_contaminated": clean_of(
        "traffic",
        quality_ports(
            "t_dedup", "not bool_or(coalesce(error_packet > 1000 or tx_packet > 1e9 or rx_packet > 1e9, false))"
        ),
    ),
    "quality_filter": clean_of("traffic", f"select {TIMED[30]}, {', '.join(PACKETS)} from t_kept", True),
    "quality_filter_optical": clean_of("optical", f"select {TIMED[30]}, {r(*POWERS)} from o_kept", True),
    "quality_semi": clean_of("traffic", f"select {TIMED[30]}, {', '.join(PACKETS)} from t_kept", True),
    "transform_log1p": clean_of("traffic", f"select {TIMED[30]}, {r(*PACKETS)} from t_moved"),
    "gap_fill": with_ctes(
        RAW
        + cleaned("t_", "traffic", "traffic_eth", False, FINE.minutes)[:2]
        + [
            (
                "calendar",
                f"select {K}, unnest(range(lo, hi + 1)) as s from "
                f"(select {K}, min(s) as lo, max(s) as hi from t_dedup group by {K})",
            )
        ],
        f"select {TIMED[30]}, {', '.join(PACKETS)} from calendar left join t_dedup using ({K}, s)",
    ),
    "interpolate_bounded": clean_of("optical", f"select {TIMED[30]}, {r(*POWERS)} from o_clean"),
    "preprocess": clean_of("traffic", f"select {TIMED[30]}, {r(*PACKETS)} from t_clean"),
    "preprocess_train": clean_of("traffic", f"select {TIMED[30]}, {r(*PACKETS)} from t_clean", True),
    "port_time_bounds": clean_of(
        "optical",
        f"select {K}, {slot_time('min(s)', 30)} as first_slot, {slot_time('max(s)', 30)} as last_slot "
        f"from o_dedup group by {K}",
    ),
    "robust_fit": with_ctes(
        RAW + training("traffic", FINE) + training("optical", FINE),
        " union all ".join(
            f"select '{t}' as track, '{f}' as feature, round(cast(c_{f} as double), 6) as center, "
            f"round(cast(d_{f} as double), 6) as scale from {t}_scaler"
            for t in FEATURES
            for f in FEATURES[t]
        ),
    ),
    "robust_apply": on("traffic", f"select {TIMED[30]}, {r(*[f'z_{f}' for f in PACKETS])} from t_scaled"),
    "null_mask": clean_of(
        "optical",
        f"select {TIMED[30]}, {', '.join(f'round(coalesce({f}, -40), 6) as {f}' for f in POWERS)}, "
        f"not ({complete('optical')}) as any_null from o_clean",
    ),
    "sliding_windows": with_ctes(
        RAW
        + track_steps("traffic", FINE)
        + [
            (
                "cut",
                f"select *, first_value(z_tx_packet) over w as oldest_tx, sum({' + '.join(f'z_{f}' for f in PACKETS)}) over w "
                f"as total from t_framed window w as (partition by {K} order by s rows between {W - 1} preceding and current row)",
            )
        ],
        f"select {TIMED[30]}, cast(n as bigint) as slots, {r('oldest_tx')}, round(z_tx_packet, 6) as newest_tx, {r('total')} "
        f"from cut where n = {W}",
    ),
    "sliding_12": on("optical", f"select {K}, count(*) as windows from o_scored group by {K}"),
    # scoring
    "score_window_mean": on("traffic", f"select {TIMED[30]}, {r('score')} from t_scored"),
    "score_last_step_mse": on("optical", f"select {TIMED[30]}, {r('score')} from o_scored"),
    "score_custom": on("traffic", f"select {TIMED[30]}, {r('score')} from t_scored"),
    "score_window_mse": on("traffic", f"select {TIMED[30]}, {r('loss')} from t_scored"),
    "threshold_percentile": with_ctes(
        chain(FINE),
        "select 'traffic' as track, round(th, 6) as threshold from traffic_th union all "
        "select 'optical', round(th, 6) from optical_th",
    ),
    "threshold_sketched": with_ctes(
        chain(FINE),
        "select 'traffic' as track, round(th, 6) as threshold from traffic_th union all "
        "select 'optical', round(th, 6) from optical_th",
    ),
    "samples_used": with_ctes(
        chain(FINE),
        "select 'traffic' as track, count(*) as samples_used from t_train_scored union all "
        "select 'optical', count(*) from o_train_scored",
    ),
    "stored_tracks": with_ctes(
        chain(FINE),
        "select 'traffic' as track, (select count(*) from t_scored) as windows, 0::bigint as differing, "
        "(select count(*) from t_train_scored) as samples_used union all "
        "select 'optical', (select count(*) from o_scored), 0, (select count(*) from o_train_scored)",
    ),
    "flag_anomaly": on("traffic", f"select {TIMED[30]}, {r('score', 'threshold')}, flag from t_judged"),
    "severity": on("optical", f"select {TIMED[30]}, {r('severity')} from o_judged"),
    "trend_slope": on("traffic", f"select {TIMED[30]}, {r('slope', digits=9)} from t_trend"),
    "trend_slope_merged": on("traffic", f"select distinct {K}, {r('slope', digits=9)} from t_trend"),
    "inverse_transform": on("traffic", f"select {TIMED[30]}, {', '.join(PACKETS)} from t_back"),
    "reason_text": with_ctes(
        chain(FINE),
        f"select {TIMED[30]}, reason from t_done union all select {TIMED[30]}, reason from o_done",
    ),
    "score_track": on(
        "traffic",
        f"select {TIMED[30]}, {', '.join(PACKETS)}, "
        + ", ".join(f"round({c}, 6) as traffic_{c}" for c in TRACK_OUT["traffic"])
        + ", flag as is_traffic_anomaly, reason as traffic_reason from t_done",
    ),
    "score_track_optical": on(
        "optical",
        f"select {TIMED[30]}, {r(*POWERS)}, "
        + ", ".join(f"round({c}, 6) as optical_{c}" for c in TRACK_OUT["optical"])
        + ", flag as is_optical_anomaly, reason as optical_reason from o_done",
    ),
    # settings
    "resolve_config": with_ctes(chain(FINE) + VERSIONS, f"select {SETTINGS_OUT} from newest_versions"),
    "override_config": with_ctes(
        chain(FINE) + VERSIONS,
        f"select {SETTINGS_OUT} from newest_versions where track = 'traffic' union all "
        "select track, version + 1, 0.25, slope_threshold, 80.0, 12, samples_used from newest_versions "
        "where track = 'optical'",
    ),
    "model_status": with_ctes(
        chain(FINE) + VERSIONS,
        "select 'optical' as track, true as \"exists\", (select cutoff from as_of) as last_trained, "
        "round(threshold, 6) as threshold, slope_threshold, cast(99.9 as double) as threshold_percentile, "
        "10::int as patience, 16::int as latent_dim, samples_used from newest_versions where track = 'optical' "
        "union all select 'traffic', false, null, 0.1, 1.0, 99.9, 10, 16, 0",
    ),
    "config_broadcast_join": with_ctes(
        chain(FINE) + VERSIONS,
        f"select {TIMED[30]}, track, round(score, 6) as score, round(threshold, 6) as threshold, slope_threshold from "
        f"(select 'traffic' as track, {K}, s, score from t_scored union all select 'optical', {K}, s, score from o_scored) "
        "join newest_versions using (track)",
    ),
    # joins and fusion
    "fuse_tracks_join": with_ctes(
        chain(FINE),
        f"select {slot_time('s', 30)} as occur_date, {K}, a.tx_packet, a.rx_packet, a.error_packet, "
        + ", ".join(f"round(a.{c}, 6) as traffic_{c}" for c in TRACK_OUT["traffic"])
        + ", a.flag as is_traffic_anomaly, a.reason as traffic_reason, "
        + ", ".join(f"round(b.{f}, 6) as {f}" for f in POWERS)
        + ", "
        + ", ".join(f"round(b.{c}, 6) as optical_{c}" for c in TRACK_OUT["optical"])
        + f", b.flag as is_optical_anomaly, b.reason as optical_reason from t_done a full join o_done b using ({K}, s)",
    ),
    "fuse_defaults": over_results(
        f"select occur_date, {K}, {', '.join(PACKETS)}, {r(*POWERS, *TRACK_DOUBLES)}, is_traffic_anomaly, "
        "is_optical_anomaly, traffic_reason, optical_reason from joined",
        FINE,
    ),
    "fuse_is_anomaly": over_results(f"select occur_date, {K}, is_anomaly from results", FINE),
    "fuse_reason": over_results(f"select occur_date, {K}, anomaly_reason from results", FINE),
    "fuse_dominant": over_results(
        f"select occur_date, {K}, case when traffic_severity >= optical_severity then 'traffic' else 'optical' end "
        f"as dominant, {r('anomaly_score', 'threshold', 'slope', 'severity')} from results",
        FINE,
    ),
    "slope_label": over_results(f"select occur_date, {K}, slope_label from results", FINE),
    "time_to_failure": over_results(f"select occur_date, {K}, ttf_minutes, expected_fatal_time from results", FINE),
    "alarm_tier": over_results(f"select occur_date, {K}, alarm_level, alarm_label from results", FINE),
    "detect": over_results(f"select {STANDARD} from results", FINE),
    "detect_latest": over_results(f"select {STANDARD} from results where {LATEST}", FINE),
    "recovered_keys_anti": over_results(
        f"select distinct {K} from criticals where occur_date < {END} except "
        f"select {K} from criticals where occur_date >= {END}",
        FINE,
        [CRITICAL],
    ),
    "known_alarm_probe": over_results(
        f"select occur_date, {K}, anomaly_reason from criticals where occur_date >= {END}", FINE, [CRITICAL]
    ),
    # reports
    "port_summary": over_results(
        f"select {K}, cast(sum(n) as bigint) as anomalies, round(max(top), 6) as max_score, "
        "max(case when place = 1 then anomaly_reason end) as primary_reason from ("
        f"select {K}, anomaly_reason, count(*) as n, max(anomaly_score) as top, "
        f"row_number() over (partition by {K} order by count(*) desc, anomaly_reason) as place "
        f"from results where is_anomaly group by {K}, anomaly_reason) group by {K}",
        FINE,
    ),
    "cycle_counts": over_results(
        "select count(*) as processed, count(*) filter (where is_anomaly) as anomalies from results", FINE
    ),
    "counts_per_cycle": over_results(
        "select occur_date, count(*) as processed, count(*) filter (where is_anomaly) as anomalies from results group by 1",
        FINE,
    ),
    "kpi_counts": over_stored(
        "select count(*) filter (where alarm_level >= 1) as total_anomalies, "
        f"count(*) filter (where alarm_level >= 3) as critical_alarms from results where {LATEST}"
    ),
    "max_slot": over_results("select max(occur_date) as max_slot from results", FINE),
    "sort_canonical": over_results(
        f"select {K}, occur_date, {r('severity')} from results order by {K}, occur_date"
    ),
    "current_anomalies": over_stored(f"select {SNAPSHOT} from results where {LATEST}"),
    "watchlist": over_stored(
        f"select {SNAPSHOT} from results where {LATEST} and alarm_level <= 2 and slope_label = 'RISING'"
    ),
    "active_criticals": over_stored(
        f"select 'ALARM' as type, {TEXT_TIME.format('occur_date')} as event_time, ip_addr, cid as slot_id, "
        f"lid as port_id, anomaly_reason as message from results where {LATEST} and alarm_level >= 3",
        LOUD,
    ),
    "port_history": over_results(f"select {HISTORY} from results where {port_rows(7)}"),
    "top_alarms": over_results(
        "select * from transitions where type = 'ALARM' qualify row_number() over (partition by ip_addr, slot_id, "
        "port_id order by event_time desc) = 1 order by event_time desc, ip_addr, slot_id, port_id limit 30",
        FINE,
        TRANSITIONS,
    ),
    "paginate": over_results(
        f"select occur_date, {K}, {r('severity')} from results "
        f"order by round(severity, 6) desc, {K}, occur_date limit 10 offset 20",
        FINE,
    ),
    "format_ttf": over_results(f"select occur_date, {K}, {ttf_text('ttf_minutes')} as ttf from results", FINE),
    "format_times": over_results(
        f"select {text_time('occur_date')}, {K}, {text_time('expected_fatal_time')} from results"
    ),
    "diagnose_port": on(
        "traffic",
        f"select {K}, case when error_packet > 100 then 'High Error Packets (' || error_packet || ' pkts)' "
        "else 'Traffic Anomaly (TX: ' || tx_packet || ' pkts)' end as diagnosis from t_done "
        f"qualify row_number() over (partition by {K} order by s desc) = 1",
    ),
    "diagnose_port_optical": on(
        "optical",
        f"select {K}, case when rx_avg_power <= -39.9 then 'Signal Lost (RX: -40dBm)' when rx_avg_power < -20 then "
        f"'Weak Signal (RX: ' || {fixed('rx_avg_power', 2)} || 'dBm)' else 'Power Fluctuation (TX: ' || "
        f"{fixed('tx_avg_power', 2)} || ', RX: ' || {fixed('rx_avg_power', 2)} || ')' end as diagnosis from o_done "
        f"qualify row_number() over (partition by {K} order by s desc) = 1",
    ),
    "display_fields": over_stored(
        f"select {TEXT_TIME.format('occur_date')} as time, ip_addr, 'S' || cid || '/P' || lid as port, alarm_label, "
        f"{fixed('severity', 1)} || '%' as severity, '+' || {fixed('slope', 2)} as trend, "
        "case when coalesce(ttf_minutes, 0) = 0 then 'Calculating...' else "
        f"{TEXT_TIME.format('expected_fatal_time')} || ' (' || {ttf_text('ttf_minutes')} || ' later)' end as expected "
        f"from results where {LATEST}"
    ),
    "severity_zone": over_results(
        f"select occur_date, {K}, {zone('traffic_severity')} as traffic_zone, {zone('optical_severity')} as optical_zone "
        "from results",
        FINE,
    ),
    "history_series": over_results(
        series([c for t in FEATURES for c in (f"{t}_severity", f"{t}_score", f"{t}_threshold", *FEATURES[t])]),
        COARSE,
        [("shown", f"select * from results where {port_rows(30)}")],
    ),
    "latest_stored": over_stored(f"select {STANDARD} from results where {LATEST}"),
    "port_history_stored": over_stored(f"select {HISTORY} from results where {port_rows(7)}"),
    "history_series_stored": over_stored(
        series([c for t in FEATURES for c in (f"{t}_severity", f"{t}_score", f"{t}_threshold", *FEATURES[t])]).replace(
            "from shown", f"from (select * from results where {port_rows(30)})"
        )
    ),
    # alarms
    "alarm_transitions": over_results("select * from transitions", FINE, TRANSITIONS),
    "active_alarm_view": over_results("select * from newest where type = 'ALARM'", LOUD, TRANSITIONS),
    "sink_alarm_json": over_results(
        f"select type, event_time, ip_addr, slot_id, port_id, {MESSAGE} from transitions", FINE, TRANSITIONS
    ),
    "alarm_state_stream": over_results("select * from transitions", FINE, TRANSITIONS),
    # sinks and streams
    "read_csv": with_ctes(
        RAW, "select t.*, case when occur_date < cutoff then 'train' else 'test' end as split from traffic_eth t, as_of"
    ),
    "sink_train_test_csv": with_ctes(
        RAW,
        "select t.* replace (round(tx_avg_power, 6) as tx_avg_power, round(rx_avg_power, 6) as rx_avg_power), "
        "case when occur_date < cutoff then 'train' else 'test' end as split from "
        "(select 'traffic' as track, * from traffic_eth union all by name select 'optical' as track, * from optical_all) t, as_of",
    ),
    "results_schema": over_results(
        f"select occur_date, {K}, 0::bigint as tx_packet, 0::bigint as rx_packet, 0::bigint as error_packet, "
        + ", ".join(f"0::double as {c}" for c in [*POWERS, *TRACK_DOUBLES, "anomaly_score", "slope", "threshold"])
        + ", false as is_traffic_anomaly, false as is_optical_anomaly, round(severity, 6) as severity, "
        "'STABLE' as slope_label, is_anomaly, 0::int as alarm_level, 'NORMAL' as alarm_label, "
        "null::double as ttf_minutes, null::timestamp as expected_fatal_time, '' as anomaly_reason, "
        "(select now from as_of) as detect_time from results"
    ),
    "sink_upsert": over_results(
        f"select * exclude (anomaly_reason), case when occur_date >= (select cutoff from as_of) then 'revised' "
        f"else anomaly_reason end as anomaly_reason from (select {STANDARD_STORED} from results)"
    ),
    "sink_retention": over_results(
        f"select occur_date, {K}, {r('severity')} from results where occur_date >= (select now - interval 10 day from as_of)"
    ),
    "sink_sanitize": over_results(
        "select * replace (case when alarm_level = 1 then 0 else severity end as severity, "
        "case when alarm_level = 2 then 0 else slope end as slope, "
        "case when alarm_level > 0 then anomaly_reason else '' end as anomaly_reason, "
        f"alarm_level < 2 and is_anomaly as is_anomaly) from (select {STANDARD_STORED} from results)"
    ),
    "read_results": over_results(
        f"select {K}, count(*) as stored, max(alarm_level) as worst from results where alarm_level >= 1 group by {K}"
    ),
    "sink_history_append": over_results(f"select {STANDARD}, (select now from as_of) as detect_time from results"),
    "sink_report": over_results(f"select {STANDARD} from results"),
    "sink_track_metadata": with_ctes(
        chain(FINE) + VERSIONS,
        f"select track, version, {r('threshold')}, slope_threshold, samples_used, 'linear-autoencoder' as model_type, "
        "(select cutoff from as_of) as trained_at, null::double as threshold_percentile, null::double as rul_target, "
        "null::int as window_size, null::int as latent_dim, null::int as patience from versions",
    ),
    "stream_source": with_ctes(
        RAW,
        f"select occur_date, {K}, signal_type, error_packet as bbe_in_error, tx_packet as es, rx_packet as ses, "
        "strftime(occur_date, '%Y-%m-%d-%H') as pm_hour from traffic_all",
    ),
    "late_data": with_ctes(
        RAW,
        f"select occur_date, {K}, {r(*POWERS)}, strftime(occur_date, '%Y-%m-%d-%H') as pm_hour from optical_all",
    ),
    "window_moments": with_ctes(
        RAW
        + training("optical", FINE)
        + [
            (
                "cut",
                f"select flatten(list_transform(generate_series(1, {W}), lambda d: [a[d], b[d]])) as x from (select n, "
                f"{', '.join(f'list(z_{f}) over w as {c}' for f, c in zip(POWERS, 'ab'))} from o_train_framed "
                f"window w as (partition by {K} order by s rows between {W - 1} preceding and current row)) where n = {W}",
            ),
            ("places", f"select cast(unnest(generate_series(0, {2 * W - 1})) as integer) as i"),
        ],
        "select -1 as i, -1 as j, round(cast(count(*) as double), 4) as total from cut union all "
        "select i, -1, round(sum(x[i + 1]), 4) from cut, places group by i union all "
        "select p.i, q.i, round(sum(x[p.i + 1] * x[q.i + 1]), 4) from cut, places p, places q where p.i <= q.i group by p.i, q.i",
    ),
    "late_verdicts": over_stored(
        f"select occur_date, {K}, {r('anomaly_score', 'threshold', 'severity')}, is_anomaly, anomaly_reason, alarm_level, alarm_label from results"
    ),
    "detect_stream": replay("select * from results"),
    "stream_alarms": replay(f"select type, event_time, ip_addr, slot_id, port_id, {MESSAGE} from transitions"),
}
ORACLES["sink_params"] = ORACLES["robust_fit"]
