import numpy as np
import pytest

from seriesgrove.config import COMPATIBLE_ONLY, Config
from seriesgrove.functions import models
from seriesgrove.operators import calibration, filters, search


@pytest.mark.parametrize("kind", ["mlp_2_5", "cnn_2_3", "rnn_2_4"])
def test_gradients(kind):
    rng = np.random.default_rng(1)
    t = models.Training(kernel=3, channels=3, hidden=4)
    m = models.make(kind, 9, t)
    p, x, y = m.start(rng), rng.normal(size=(6, 9)), rng.normal(size=6)
    g = m.gradient(p, x, y)
    loss = lambda: ((m.forward(p, x) - y) ** 2).mean()
    for k, v in p.items():
        for at in [tuple(rng.integers(n) for n in v.shape) for _ in range(4)]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5), (k, at)


@pytest.mark.parametrize("kind", ["mlp", "cnn", "rnn"])
def test_training_lowers_the_loss_and_repeats(kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 12))
    y = np.abs(x[:, 0]) + 0.5 * x[:, 1] + 2
    t = models.Training(epochs=60, rate=0.05, hidden=6, channels=4, clip=1.0)
    m = models.make(kind, 12, t)
    one, two = models.train(m, x, y, t), models.train(m, x, y, t)
    assert one.history[-1] < one.history[0] and one.loss == two.loss
    names, shapes, values = models.flat(one.weights)
    back = models.unflat(names, shapes, values)
    assert np.array_equal(m.forward(back, x), m.forward(one.weights, x))


def test_settings_of_models():
    s = models.ModelSetting.parse("v0_mlp_3_256_f")
    assert (s.kind, s.layers, s.width, s.precision) == ("mlp", 3, 256, "f")
    for wrong in ("san_1", "mlp_x", ""):
        with pytest.raises(ValueError):
            models.ModelSetting.parse(wrong)


def test_plateau_lowers_the_rate_and_stops():
    p = models.Plateau(models.Training(patience=2, stop_after=5), 1.0)
    stops = [p.step(1.0) for _ in range(8)]
    assert p.rate < 1.0 and stops[-1] and not stops[1]


def test_filters_train_predict_and_search(spark, sf_dir):
    from seriesgrove.plans.queries import Tables

    t = Tables(spark, sf_dir)
    training = models.Training(epochs=40, rate=0.05)
    made = filters.train_filters(t.nearest().join(t.queries, "query_id"), "mlp_2_8", training).cache()
    assert made.count() == 10
    told = filters.predict(made, t.queries, training)
    assert told.count() == 10 * t.queries.count()
    pruner = filters.pruner(made, dict.fromkeys(range(10), 1e9), training)
    index = search.Index([], None, {}, {})
    assert index.leaves == []
    assert not pruner(np.zeros((3, 64)), 1, np.zeros(3), np.ones(3)).any()
    tight = filters.pruner(made, dict.fromkeys(range(10), 0.0), training)
    assert tight(np.zeros((3, 64)), 1, np.zeros(3), np.full(3, -1.0)).all()


def test_recall_never_falls_with_alpha(spark, sf_dir):
    from seriesgrove.plans.queries import Tables

    t = Tables(spark, sf_dir)
    low = t.alphas().selectExpr("leaf_id", "batch_id", "error_i", "0.0D AS alpha")
    high = t.alphas().selectExpr("leaf_id", "batch_id", "error_i", "1e9D AS alpha")
    get = lambda a: {(r.batch_id, r.error_i): r.recall for r in calibration.batch_recall(t.batches(), t.knn(), t.predicted(), a, 5).collect()}
    a, b = get(low), get(high)
    assert all(v == 1.0 for v in b.values()) and all(a[k] <= b[k] for k in a)


def test_config():
    c = Config.parse(["--series_length=96", "--leaf_size", "10000", "--exact_search", "--filter_query_min_noise=0.4", "--filter_query_max_noise=0.1", "--learning_rate=0.05"])
    assert (c.series_length, c.leaf_size, c.exact_search, c.filter_query_min_noise, c.dim_latent) == (96, 10000, True, 0.1, 96)
    assert c.tree().leaf_size == 10000 and c.training().rate == 0.05 and c.check() == []
    assert Config(search_max_nnode=3).exact_search
    assert "series_length is required" in Config().check()
    assert Config(series_length=8, require_neurofilter=True, navigator_is_learned=True).check()
    with pytest.raises(ValueError):
        Config.parse(["--no_such_thing=1"])
    assert all(hasattr(c, n) for n in COMPATIBLE_ONLY)


def test_navigator_learns_shares():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-2, 1, (40, 6)), rng.normal(2, 1, (40, 6))])
    y = np.repeat([[0.9, 0.1], [0.1, 0.9]], 40, axis=0)
    n = models.Navigator(6, [4, 7], 16)
    losses = n.fit(x, y, epochs=300, rate=2.0)
    assert losses[-1] < 0.5 * losses[0]
    assert (n.probabilities(x).argmax(axis=1) == y.argmax(axis=1)).mean() > 0.95


def test_cubic_slopes_of_a_line_and_symmetry():
    x = np.array([0.0, 1.0, 3.0, 4.0])
    assert np.allclose(calibration.cubic_slopes(x, 2 * x + 1), 2)
    y = np.array([0.0, 1.0, 1.0, 0.0])
    s = calibration.cubic_slopes(x, y)
    assert np.allclose(s, -s[::-1])


def test_costs_are_positive():
    from seriesgrove.operators import allocation

    m = models.make("mlp_2_4", 8)
    a, b = allocation.measure_costs(8, m, m.start(np.random.default_rng(1)), rounds=3)
    assert a > 0 and b > 0
