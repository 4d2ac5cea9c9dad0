import numpy as np
import pytest

from portvigil.operators import clean, quantiles, scoring, windows
from portvigil.plans.train import load_track, save_track, train_track
from portvigil.spec import OPTICAL
from tests.helpers import START, optical_rows, series

UNIT = {f: (0.0, 1.0) for f in OPTICAL.features}


def scaled(spark, rows, scaler=UNIT):
    grid = clean.preprocess(optical_rows(spark, rows), OPTICAL, full_grid=False)
    return windows.robust_apply(grid, OPTICAL, scaler)


def noise(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(-10, 2, (n, 2)))]


@pytest.mark.parametrize(("seed", "small", "accuracy"), [(0, 10, 20), (1, 50, 100), (2, 1, 10), (3, 10**6, 100)])
def test_exact_quantiles_match_numpy(spark, seed, small, accuracy):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 100, 3000), rng.integers(0, 6, 3000).astype(float)
    b[:1500] = 3.0
    rows = [(float(x), None if i % 10 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b"], probs, small, accuracy)
    kept = [r[1] for r in rows if r[1] is not None]
    np.testing.assert_allclose(got["a"], np.quantile(a, probs), rtol=1e-12)
    np.testing.assert_allclose(got["b"], np.quantile(kept, probs), rtol=1e-12)


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "a double")
    assert quantiles.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_flat_metric_gets_scale_one(spark):
    grid = clean.preprocess(optical_rows(spark, [(i, -5.0, float(i)) for i in range(9)]), OPTICAL)
    assert windows.robust_fit(grid, OPTICAL) == {"tx_avg_power": (-5.0, 1.0), "rx_avg_power": (4.0, 4.0)}


def test_scaler_survives_storage(spark, tmp_path):
    scaler = {"tx_avg_power": (-5.5, 1.25), "rx_avg_power": (0.1, 3.0)}
    windows.scaler_frame(spark, OPTICAL, scaler).write.parquet(str(tmp_path / "scaler"))
    assert windows.load_scaler(spark.read.parquet(str(tmp_path / "scaler")), OPTICAL) == scaler


def test_windows_skip_holes(spark):
    rows = [r for r in noise(40) if r[0] not in (15, 16, 17)]
    cut = windows.sliding_windows(scaled(spark, rows), OPTICAL)
    # Slots 15 and 17 are filled from their neighbours, 16 stays empty.
    first = series(clean.dedup_last(optical_rows(spark, rows), OPTICAL), "slot_idx")[0]
    ends = [s - first for s in series(cut, "slot_idx")]
    assert ends == [11, 12, 13, 14, 15, *range(28, 40)]
    assert all(len(s) == 12 and None not in np.ravel(s) for s in series(cut, "seq"))


def test_eleven_slots_make_no_window(spark):
    assert windows.sliding_windows(scaled(spark, noise(11)), OPTICAL).count() == 0


def test_window_mean_and_custom_scores_match_numpy(spark):
    rows = noise(30)
    x = np.array([r[1:] for r in rows])
    want = [np.mean((x[i] - x[i - 11 : i + 1].mean(axis=0)) ** 2) for i in range(11, 30)]
    df = scaled(spark, rows)
    np.testing.assert_allclose(series(scoring.score_window_mean(df, OPTICAL), "score"), want)
    custom = scoring.score_custom(lambda w: np.broadcast_to(w.mean(axis=1, keepdims=True), w.shape))
    np.testing.assert_allclose(series(custom(df, OPTICAL, 12), "score"), want)


def test_reconstruction_matches_numpy(spark, tmp_path):
    rows = noise(200, seed=4)
    df = scaled(spark, rows)
    cut = windows.sliding_windows(df, OPTICAL)
    model = scoring.fit_reconstruction(cut, 5)
    x = np.array([np.ravel(s) for s in series(cut, "seq")])
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)

    def rebuilt(k):
        return mean + (x - mean) @ vt[:k].T @ vt[:k]

    want = np.mean((x - rebuilt(5))[:, -2:] ** 2, axis=1)
    np.testing.assert_allclose(series(scoring.score_reconstruction(model)(df, OPTICAL, 12), "score"), want, atol=1e-9)
    losses = {r.k: r.val_loss for r in scoring.validation_loss(cut, model).collect()}
    for k in range(1, 6):
        assert losses[k] == pytest.approx(np.mean((x - rebuilt(k)) ** 2))
    per_window = series(scoring.score_window_mse(cut, model), "loss")
    np.testing.assert_allclose(per_window, np.mean((x - rebuilt(5)) ** 2, axis=1))
    model.save(spark, str(tmp_path / "model"))
    loaded = scoring.LinearAutoencoder.load(spark, str(tmp_path / "model"))
    np.testing.assert_allclose(series(scoring.score_reconstruction(loaded)(df, OPTICAL, 12), "score"), want, atol=1e-9)


def test_model_selection_stops_after_patience(spark):
    model = scoring.LinearAutoencoder(None, [], 6)
    losses = spark.createDataFrame(list(enumerate([5.0, 4.0, 4.1, 4.2, 1.0, 0.5], 1)), "k int, val_loss double")
    assert scoring.select_best_model(model, losses, patience=2)[0].k == 2
    best, loss = scoring.select_best_model(model, losses, patience=3)
    assert (best.k, loss) == (6, 0.5)
    assert scoring.select_best_model(model, losses, patience=3, min_gain=0.9)[0].k == 1


def test_training_uses_the_training_scaler_and_counts_windows(spark):
    train, held_out = noise(120, 1), [(i, a * 3, b * 3) for i, a, b in noise(60, 2)]
    track = train_track(
        optical_rows(spark, train), optical_rows(spark, held_out), OPTICAL, START, percentile=90.0, latent_dim=4, min_gain=0.0
    )
    x = np.array([r[1:] for r in train])
    np.testing.assert_allclose([c for c, _ in track.scaler.values()], np.median(x, axis=0))
    row = track.config.first()
    assert row.samples_used == 109 and row.latent_dim == 4 and row.final_val_loss > 0
    df = scaled(spark, train, track.scaler)
    scores = series(scoring.score_reconstruction(track.model)(df, OPTICAL, 12), "score")
    assert row.threshold == pytest.approx(np.quantile(scores, 0.9))


def test_training_without_windows_gives_nothing(spark):
    assert train_track(optical_rows(spark, noise(20)), None, OPTICAL, START) is None

    assert train_track(optical_rows(spark, noise(11)), None, OPTICAL, START) is None


def test_a_stored_track_scores_as_the_trained_one(spark, tmp_path):
    rows = noise(90, 3)
    track = train_track(optical_rows(spark, rows), None, OPTICAL, START, latent_dim=3)
    path = str(tmp_path / "tracks")
    assert load_track(spark, OPTICAL, path) is None
    save_track(track, OPTICAL, path)
    save_track(track, OPTICAL, path)  # a repeat replaces the version
    (tmp_path / "tracks" / "track=optical" / "version=2").mkdir()  # interrupted: no settings
    again = load_track(spark, OPTICAL, path)
    assert again.scaler == track.scaler and again.config.collect() == track.config.collect()
    df = scaled(spark, rows, track.scaler)
    want = series(scoring.score_reconstruction(track.model)(df, OPTICAL, 12), "score")
    assert series(scoring.score_reconstruction(again.model)(df, OPTICAL, 12), "score") == pytest.approx(want)
