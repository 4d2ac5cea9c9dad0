"""Moments and sketches that are kept per stretch and merged."""

import math
import random

import pytest
from pyspark.sql import functions as F

from portvigil.operators import fusion, sketches, trend
from portvigil.operators.quantiles import exact_quantiles
from portvigil.spec import KEYS

JUDGED = "ip_addr string, cid int, lid int, slot_idx long, severity double"


def judged(spark, seed=5, ports=6, slots=300):
    """Severities with gaps, unknown ones, a port with one window and one without a known severity."""
    rng = random.Random(seed)
    rows = [("one", 1, 1, 40, 10.0), *(("unknown", 1, 1, s, None) for s in range(0, 90, 9))]
    for p in range(ports):
        for s in range(slots):
            if rng.random() < 0.7:
                rows.append((f"p{p}", p, 1, s, None if rng.random() < 0.1 else p * s / 7 + rng.gauss(0, 20)))
    return spark.createDataFrame(rows, JUDGED)


def by_port(df):
    return {r.ip_addr: r.slope for r in df.select("ip_addr", "slope").distinct().collect()}


@pytest.mark.parametrize("length", [1, 7, 96, 1000])
def test_merged_slopes_equal_those_of_all_windows(spark, length):
    rows = judged(spark)
    want = by_port(fusion.trend_slope(rows))
    days = trend.stretch_moments(rows, f"slot_idx div {length}")
    got = by_port(trend.slopes(trend.merge_moments(days)))
    assert got.keys() == want.keys() and got["one"] == got["unknown"] == 0.0
    assert all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-12) for p in want)


def test_merging_in_two_steps_changes_nothing(spark):
    days = trend.stretch_moments(judged(spark), "slot_idx div 8")
    weeks = trend.merge_moments(days.withColumn("week", F.expr("stretch div 5")), "week")
    once, twice = (by_port(trend.slopes(trend.merge_moments(m))) for m in (days, weeks))
    assert all(math.isclose(once[p], twice[p], rel_tol=1e-9, abs_tol=1e-12) for p in once)


def test_a_stretch_that_comes_again_replaces_itself(spark, tmp_path):
    rows, path = judged(spark), str(tmp_path / "moments")
    days = trend.stretch_moments(rows, "slot_idx div 50")
    trend.store_moments(trend.stretch_moments(rows.where("slot_idx < 120"), "slot_idx div 50"), path)
    trend.store_moments(days.where("stretch >= 2"), path)
    want, got = by_port(fusion.trend_slope(rows)), by_port(trend.stored_slopes(spark, path))
    assert all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-12) for p in want)


def test_moments_of_no_rows(spark):
    assert trend.slopes(trend.merge_moments(trend.stretch_moments(judged(spark).where("false"), "slot_idx"))).count() == 0


def test_one_exchange_by_port_merges_and_places(spark):
    from tests.helpers import plan_of

    merged = trend.merge_moments(trend.stretch_moments(judged(spark), "slot_idx div 8").repartition(3, *KEYS))
    assert plan_of(merged).count("Exchange hashpartitioning") <= 2


def scores(spark, n=40_000):
    return spark.range(n).selectExpr("id div 1000 as slot_idx", "if(id % 50 = 0, null, pow(pmod(id * 7919, 40009) / 40009D, 3)) as score")


def test_sketches_keep_to_their_error(spark):
    rows = scores(spark)
    parts = sketches.score_sketches(rows, "slot_idx div 4")
    n = rows.where("score is not null").count()
    for percentile in (1.0, 50.0, 95.0, 99.9):
        value = sketches.approximate_threshold(parts, percentile)
        share = rows.where(F.col("score") < value).count() / n
        assert abs(share - percentile / 100) <= sketches.rank_error() + 1 / n


@pytest.mark.parametrize("percentile", [0.0, 37.5, 99.0, 100.0])
def test_settled_thresholds_are_exact(spark, percentile):
    rows = scores(spark)
    want = exact_quantiles(rows, ["score"], [percentile / 100], few=50)["score"][0]
    assert sketches.settled_threshold(rows, sketches.score_sketches(rows, "slot_idx"), percentile) == want
    other = sketches.score_sketches(rows.where("slot_idx < 3").withColumn("score", F.col("score") * 9 - 4), "slot_idx")
    assert sketches.settled_threshold(rows, other, percentile) == want


def test_hints_narrow_and_do_not_decide(spark):
    rows = scores(spark)
    want = exact_quantiles(rows, ["score"], [0.3, 0.9], few=50)
    for hint in ([0.0, 1.0], [0.02, 0.03], [5.0], [-1.0, -2.0]):
        assert exact_quantiles(rows, ["score"], [0.3, 0.9], few=50, hints={"score": hint}) == want


def test_sketches_of_no_scores(spark):
    none = scores(spark).where("score is null")
    parts = sketches.score_sketches(none, "slot_idx")
    assert sketches.approximate_threshold(parts, 50.0) is None
    assert sketches.settled_threshold(none, parts, 50.0) is None
