import numpy as np
import pytest

from portvigil.operators import moments, scoring, windows
from portvigil.plans.train import train_track
from portvigil.spec import OPTICAL

from tests.helpers import START, optical_rows, series
from tests.test_windows import noise, scaled

WIDTH = 24


def vectors(df):
    return np.array([np.ravel(s) for s in series(windows.sliding_windows(df, OPTICAL), "seq")])


def test_moments_equal_those_of_the_window_table_and_merge(spark):
    rows = [r for r in noise(80, 4) if r[0] not in (30, 55)]
    df = scaled(spark, rows)
    x = vectors(df)
    found = moments.collected(moments.window_moments(df.repartition(3), OPTICAL), WIDTH)
    assert found.count == len(x) > 20
    np.testing.assert_allclose(found.sums, x.sum(axis=0), atol=1e-9)
    np.testing.assert_allclose(found.products, x.T @ x, atol=1e-9)
    parts = [moments.Moments(len(p), p.sum(axis=0), p.T @ p) for p in (x[:7], x[7:])]
    np.testing.assert_allclose((parts[0] + parts[1]).products, found.products, atol=1e-9)
    np.testing.assert_allclose(found.around(found.mean), np.cov(x.T, bias=True), atol=1e-9)


def test_no_window_no_moments(spark):
    assert moments.collected(moments.window_moments(scaled(spark, noise(11)), OPTICAL), WIDTH) is None


def test_no_window_table_and_no_further_shuffle(spark):
    plan = moments.window_moments(scaled(spark, noise(30)), OPTICAL)._jdf.queryExecution().executedPlan().toString()
    # readings by port and slot, the grid by port, and the few sums
    assert plan.count("Exchange hashpartitioning") == 3 and "collect_list" not in plan


def of(x):
    return moments.Moments(len(x), x.sum(axis=0), x.T @ x)


def test_losses_from_moments_equal_predictions_of_every_window():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8)), rng.normal(size=(90, 8)) + 1
    losses = dict(moments.masked_losses(of(x), of(y), 6, 2))
    vectors_, share = moments.components(of(x), 6)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(share, (s**2 / (s**2).sum())[:6])
    np.testing.assert_allclose(np.abs((vectors_ * vt[:6].T).sum(axis=0)), 1)
    for k in range(1, 7):
        part = vectors_[:, :k]
        coordinates = np.linalg.lstsq(part[:-2], (y - x.mean(axis=0))[:, :-2].T, rcond=None)[0]
        predicted = x.mean(axis=0)[-2:] + (part[-2:] @ coordinates).T
        assert losses[k] == pytest.approx(((y[:, -2:] - predicted) ** 2).mean())


def test_best_number_lies_inside_the_range():
    rng = np.random.default_rng(2)
    sources = rng.normal(size=(2, 24))

    def drawn(n):
        return rng.normal(size=(n, 2)) @ sources + 0.3 * rng.normal(size=(n, 24))

    losses = moments.masked_losses(of(drawn(400)), of(drawn(400)), 24, 2)
    assert moments.best_components(losses) == 2 and losses[-1][1] > 2 * losses[1][1]


def test_losses_of_whole_windows_equal_reconstructions():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)), rng.normal(size=(50, 6))
    center = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - center, full_matrices=False)
    for k, loss in moments.whole_losses(of(x), of(y), 5):
        left = (y - center) - (y - center) @ vt[:k].T @ vt[:k]
        assert loss == pytest.approx((left**2).mean())


def test_training_from_moments_equals_training_on_the_window_table(spark):
    rows = noise(120, 5)
    df = scaled(spark, rows)
    table = scoring.fit_reconstruction(windows.sliding_windows(df, OPTICAL), 4)
    model = scoring.fit_moments(moments.collected(moments.window_moments(df, OPTICAL), WIDTH), 4)
    np.testing.assert_allclose(model.mean, table.mean, atol=1e-9)
    np.testing.assert_allclose(np.abs((model.vectors * table.vectors).sum(axis=0)), 1, atol=1e-6)
    np.testing.assert_allclose(model.explained, table.explained, atol=1e-9)
    cut = windows.sliding_windows(df, OPTICAL)
    want = series(scoring.score_windows(cut, OPTICAL, table), "score")
    np.testing.assert_allclose(series(scoring.score_reconstruction(model)(df, OPTICAL, 12), "score"), want, atol=1e-9)


def repeating(n, seed):
    """A daily course in both metrics under noise: two components suffice."""
    rng = np.random.default_rng(seed)
    wave = 3 * np.sin(np.arange(n) * 2 * np.pi / 12)
    return [(i, float(-10 + w + a), float(-12 + w + b)) for i, (w, (a, b)) in enumerate(zip(wave, rng.normal(0, 0.4, (n, 2)), strict=True))]


def test_training_can_choose_inside_the_range(spark):
    train, held_out = repeating(160, 6), repeating(90, 7)
    track = train_track(optical_rows(spark, train), optical_rows(spark, held_out), OPTICAL, START, latent_dim=16, patience=16, hidden_slots=1)
    row = track.config.first()
    assert 2 <= row.latent_dim < 10
    x = vectors(scaled(spark, train, track.scaler))
    y = vectors(scaled(spark, held_out, track.scaler))
    losses = moments.masked_losses(of(x), of(y), 16, 2)
    assert row.latent_dim == moments.best_components(losses)
    assert row.final_val_loss == pytest.approx(min(v for _, v in losses))
    whole = train_track(optical_rows(spark, train), optical_rows(spark, held_out), OPTICAL, START, latent_dim=16, min_gain=0.0, patience=16)
    assert whole.config.first().latent_dim == 16  # whole windows are rebuilt better by every component


def test_training_writes_no_window_table(spark, monkeypatch):
    from portvigil.plans import train as plan

    names, inner = [], plan.materialized
    monkeypatch.setattr(plan, "materialized", lambda df, name: (names.append((name, df.columns)), inner(df, name))[1])
    train_track(optical_rows(spark, noise(60, 8)), None, OPTICAL, START, latent_dim=3)
    assert [n for n, _ in names] == ["clean", "scores"] and names[1][1] == ["score"]
