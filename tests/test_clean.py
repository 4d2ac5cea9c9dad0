from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from portvigil.functions import times as TM
from portvigil.operators import clean, windows
from portvigil.spec import OPTICAL, TRAFFIC
from tests.helpers import PORT, START, TRAFFIC_ROWS, at, optical_rows, series, traffic_rows


def test_slot_round_ties_go_to_even(spark):
    rows = [(START + timedelta(minutes=m),) for m in (7.5, 22.5, 37.5, 7.49, 52.5)]
    got = spark.createDataFrame(rows, "t timestamp_ntz").select(F.expr(TM.slot_round("t", 15))).collect()
    assert [r[0] - START for r in got] == [timedelta(minutes=m) for m in (0, 30, 30, 0, 60)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_slot_round_matches_pandas_in_any_session_zone(spark, zone):
    rng = np.random.default_rng(3)
    micros = rng.integers(-(10**15), 2 * 10**15, 500)
    # Daylight saving in New York: local times that do not exist or exist twice.
    times = list(pd.to_datetime(micros, unit="us")) + [datetime(2024, 3, 10, 2, 20), datetime(2024, 11, 3, 1, 37, 30)]
    frame = pd.DataFrame({"t": pd.Series(times).astype("datetime64[us]")})
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t.to_pydatetime(),) for t in frame.t], "t timestamp_ntz")
        got = df.select("t", F.expr(TM.slot_round("t", 15)).alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.s for r in got] == [t.to_pydatetime() for t in frame.t.dt.round("15min")]


def test_coerce_types_and_quarantine(spark):
    df = spark.createDataFrame(
        [
            ("2024-01-01 00:00:00", "a", 1, 1, "5", "x", "1"),
            ("no time", "a", 1, 1, "5", "6", "1"),
            ("2024-01-01 00:15:00", None, 1, 1, "5", "6", "1"),
            ("2024-01-01 00:30:00", "a", 1, 1, "NaN", "6", "1"),
        ],
        "occur_date string, ip_addr string, cid int, lid int, tx_packet string, rx_packet string, error_packet string",
    )
    good = clean.coerce_types(df, TRAFFIC).orderBy("occur_date").collect()
    assert [(r.tx_packet, r.rx_packet) for r in good] == [(5.0, None), (None, 6.0)]
    assert clean.quarantine(df, TRAFFIC).count() == 2


def test_dedup_takes_the_latest_reading_whole(spark):
    rows = [(0, 1.0, 10.0, 0.0), (0.2, 2.0, None, 1.0), (-0.3, 3.0, 30.0, 2.0), (1, 4.0, 40.0, 3.0)]
    got = clean.dedup_last(traffic_rows(spark, rows), TRAFFIC, 15).orderBy("slot_idx").collect()
    assert [(r.tx_packet, r.rx_packet, r.error_packet) for r in got] == [(2.0, None, 1.0), (4.0, 40.0, 3.0)]


def test_dedup_of_equal_times_does_not_depend_on_order(spark):
    rows = [(0, float(i), float(100 - i), 0.0) for i in range(50)]
    seen = set()
    for seed in range(4):
        shuffled = list(np.random.default_rng(seed).permutation(rows))
        df = traffic_rows(spark, [tuple(map(float, r)) for r in shuffled]).repartition(3)
        row = clean.dedup_last(df, TRAFFIC, 15).collect()[0]
        assert row.tx_packet + row.rx_packet == 100.0
        seen.add(row.tx_packet)
    assert len(seen) == 1


def test_dedup_combines_before_the_shuffle(spark):
    plan = clean.dedup_last(traffic_rows(spark, [(0, 1.0, 1.0, 0.0)]), TRAFFIC)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("HashAggregate") == 2 and "SortAggregate" not in physical


@pytest.mark.parametrize(
    ("values", "filled"),
    [
        ([1, None, 3], [1, 2, 3]),
        ([1, None, None, 4], [1, 2, 3, 4]),
        ([1, None, None, None, 5], [1, 2, None, 4, 5]),
        ([None, None, 3, 4], [None, 3, 3, 4]),
        ([1, 2, None, None], [1, 2, 2, None]),
        ([None, None], [None, None]),
        ([7], [7]),
    ],
)
def test_interpolation_truth_table(spark, values, filled):
    rows = [(i, None if v is None else float(v), 0.0) for i, v in enumerate(values)]
    df = clean.dedup_last(optical_rows(spark, rows), OPTICAL)
    got = series(clean.interpolate_bounded(clean.gap_fill(df, OPTICAL), OPTICAL), "tx_avg_power")
    assert got == [None if v is None else float(v) for v in filled]


@pytest.mark.parametrize("missing", [[1], [1, 2], [1, 2, 3], list(range(1, 9000))])
def test_gap_fill_makes_every_slot(spark, missing):
    last = missing[-1] + 1
    df = clean.dedup_last(optical_rows(spark, [(0, -1.0, -1.0), (last, -2.0, -2.0)]), OPTICAL)
    grid = clean.gap_fill(df, OPTICAL)
    slots = series(grid, "slot_idx")
    assert slots == list(range(slots[0], slots[0] + last + 1))
    assert grid.where("tx_avg_power is not null").count() == 2


def test_edge_fill_agrees_with_gap_fill_on_windows(spark):
    rng = np.random.default_rng(11)
    slots = np.flatnonzero(rng.random(400) < 0.8)
    rows = [
        (int(s), *(None if rng.random() < 0.05 else float(x) for x in rng.normal(-10, 2, 2))) for s in slots
    ]
    df = clean.dedup_last(optical_rows(spark, rows), OPTICAL)
    cut = []
    for fill in (clean.gap_fill, clean.edge_fill):
        grid = clean.interpolate_bounded(fill(df, OPTICAL), OPTICAL)
        scaled = windows.robust_apply(grid, OPTICAL, {f: (0.0, 1.0) for f in OPTICAL.features})
        cut.append({r.slot_idx: r.seq for r in windows.sliding_windows(scaled, OPTICAL).collect()})
    assert cut[0] == cut[1] and len(cut[0]) > 20


def test_preprocess_agrees_with_pandas(spark):
    rng = np.random.default_rng(5)
    minutes = np.sort(rng.choice(3000, 170, replace=False))
    pdf = pd.DataFrame(
        {
            "t": [START + timedelta(minutes=int(m), seconds=20) for m in minutes],
            "tx_packet": rng.integers(-5, 10**6, 170).astype(float),
            "rx_packet": rng.integers(0, 10**6, 170).astype(float),
            "error_packet": rng.integers(0, 5, 170).astype(float),
        }
    )
    pdf.loc[::17, "tx_packet"] = np.nan
    raw = spark.createDataFrame(
        [(r.t.to_pydatetime(), *PORT, *(None if np.isnan(v) else v for v in r[2:])) for r in pdf.itertuples()],
        TRAFFIC_ROWS,
    )
    got = clean.with_slot_time(clean.preprocess(raw, TRAFFIC)).orderBy("occur_date").toPandas()
    want = pdf.assign(t=pdf.t.dt.round("15min")).drop_duplicates("t", keep="last").set_index("t")
    want = np.log1p(want.clip(lower=0))
    want = want.reindex(pd.date_range(want.index.min(), want.index.max(), freq="15min"))
    want = want.interpolate("linear", limit=1, limit_direction="both")
    assert list(got.occur_date) == list(want.index)
    np.testing.assert_allclose(got[list(TRAFFIC.features)].to_numpy(float), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize(("rows", "kept"), [(23, 0), (24, 24)])
def test_quality_needs_twice_the_window(spark, rows, kept):
    df = traffic_rows(spark, [(i, 1.0, 1.0, 0.0) for i in range(rows)])
    assert clean.quality_filter(clean.dedup_last(df, TRAFFIC), TRAFFIC).count() == kept


def test_quality_dead_channel_is_kept_by_one_null(spark):
    dead = [(i, -40.0, -40.0) for i in range(30)]
    for rows, kept in ((dead, 0), ([*dead[:-1], (29, None, -40.0)], 30)):
        df = clean.dedup_last(optical_rows(spark, rows), OPTICAL)
        assert clean.quality_filter(df, OPTICAL).count() == kept
        ports = clean.valid_ports(df, clean.quality_rule(OPTICAL))
        assert clean.quality_semi(df, ports).count() == kept


def test_quality_contaminated(spark):
    base = [(i, 1.0, 1.0, 0.0) for i in range(30)]
    for bad in ((3, 1.0, 1.0, 1001.0), (3, 2e9, 1.0, 0.0), (3, None, 2e9, 0.0)):
        df = clean.dedup_last(traffic_rows(spark, [*base[:3], bad, *base[4:]]), TRAFFIC)
        assert clean.quality_filter(df, TRAFFIC).count() == 0
    assert clean.quality_filter(clean.dedup_last(traffic_rows(spark, base), TRAFFIC), TRAFFIC).count() == 30


def test_one_shuffle_by_port_serves_cleaning_and_windows(spark):
    raw = traffic_rows(spark, [(i, 1.0, 1.0, 0.0) for i in range(30)])
    grid = clean.preprocess(raw, TRAFFIC, train=True, full_grid=False)
    scaled = windows.robust_apply(grid, TRAFFIC, {f: (0.0, 1.0) for f in TRAFFIC.features})
    plan = windows.sliding_windows(scaled, TRAFFIC)._jdf.queryExecution().executedPlan().toString()
    # One exchange of pre-aggregated slots, one by port for everything after it.
    assert plan.count("Exchange hashpartitioning") == 2


def test_stray_timestamp_does_not_blow_up_scoring_grid(spark):
    rows = [(0, -5.0, -5.0), (4_000_000, -6.0, -6.0)]
    df = clean.dedup_last(optical_rows(spark, rows), OPTICAL)
    assert clean.edge_fill(df, OPTICAL).count() == 4
    assert at(4_000_000).year > 2100
