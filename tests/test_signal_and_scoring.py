import numpy as np
import pandas as pd
import pytest

from stayline.operators import normality as N
from stayline.operators import scoring as C
from stayline.operators import signal as G
from stayline.plans.queries import predictor_weights, projector_weights, rule_layer


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(0)
    cube = rng.normal(2, 3, size=(40, 50, 12)).astype(np.float32)
    rows = [(i, cube[i].reshape(-1).tolist()) for i in range(40)] + [(40, None), (41, [])]
    return cube.astype(float), spark.createDataFrame(rows, "row_idx long, waveform array<float>")


def test_lead_stats(signals):
    cube, df = signals
    got = G.lead_stats(df, 12).orderBy("row_idx", "lead").toPandas()
    assert len(got) == 40 * 12
    assert np.allclose(got["mean"], cube.mean(axis=1).reshape(-1))
    assert np.allclose(got["std"], cube.std(axis=1).reshape(-1))


def test_signals_of_unequal_length(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0, 3.0]), (1, [4.0])], "row_idx long, waveform array<float>")
    got = G.lead_stats(df.coalesce(1), 2).orderBy("row_idx", "lead").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2.0, 1.0), (0, 1, 5.0, 0.0), (1, 0, 4.0, 0.0)]


@pytest.mark.parametrize("limit", [10_000, 20])
def test_summary(signals, limit):
    cube, df = signals
    got = {r.stat: r for r in G.stats_summary(G.lead_stats(df, 12), limit).collect()}
    for name, values in (("mean", cube.mean(axis=1)), ("std", cube.std(axis=1))):
        assert got[name]["mean"] == pytest.approx(values.mean())
        assert got[name]["std"] == pytest.approx(values.std())
        points = [got[name][f"p{p}"] for p in G.PERCENTILES]
        assert np.allclose(points, np.percentile(values, G.PERCENTILES))


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_percentiles_with_ties(spark, n):
    x = np.random.default_rng(n).integers(0, 9, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x}))
    for limit in (1000, 2):
        got = G.percentiles(df, ["g"], "x", [0, 2.5, 50, 97.5, 100], limit).first()
        assert np.allclose(got[1:], np.percentile(x, [0, 2.5, 50, 97.5, 100]))


def test_breakdown_and_verdict(signals):
    cube, df = signals
    stats = G.lead_stats(df, 12)
    rows = G.lead_breakdown(stats).orderBy("lead").collect()
    assert [r.lead_name for r in rows] == "I II III aVR aVL aVF V1 V2 V3 V4 V5 V6".split()
    assert np.allclose([r.std_of_means for r in rows], cube.mean(axis=1).std(axis=0))
    assert not G.normalization_verdict(stats).first().pre_normalized
    scaled = stats.selectExpr("mean - 2 AS mean", "std / 3 AS std")
    assert G.normalization_verdict(scaled).first().pre_normalized


def relu(x):
    return np.maximum(x, 0)


def apply(x, layer):
    return x @ layer["weight"].T + layer["bias"]


def trunk(x, w):
    x = relu(apply(x, w["input"]))
    return relu(x + apply(relu(apply(x, w["residual_in"])), w["residual_out"]))


def test_heads(spark):
    rng = np.random.default_rng(4)
    h, a = rng.normal(size=(30, 6)), rng.integers(-1, 2, (30, 5))
    rows = [(i, h[i].tolist(), a[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, h_t array<double>, a_t array<tinyint>")

    def column(out, name):
        return np.array([r[name] for r in out.orderBy("i").collect()])

    layer = rule_layer(4, 6)
    out = C.linear_head(df, layer["weight"], layer["bias"], "h_t", 7)
    assert np.allclose(column(out, "logits"), apply(h, layer))
    assert np.allclose(column(out, "probs"), 1 / (1 + np.exp(-apply(h, layer))))

    w = projector_weights(5, 3)
    emb = apply(relu(apply(relu(apply(a, w[0])), w[1])), w[2])
    df = C.action_projector(df, w)
    assert np.allclose(column(df, "action_emb"), emb)

    w = predictor_weights(9, 8, {"output": 6})
    want = apply(trunk(np.hstack([h, emb]), w), w["output"])
    assert np.allclose(column(C.dynamics_predictor(df, w), "h_t1_hat"), want)

    w = predictor_weights(6, 8, {"onset": 5, "resolution": 5})
    out = C.action_predictor(df, w, "h_t")
    assert np.allclose(column(out, "onset_logits"), apply(trunk(h, w), w["onset"]))


def test_score_loads_the_model_in_the_worker(spark):
    def make():
        scale = np.float64(3.0)
        return lambda x: x * scale

    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    got = C.score(df, make, ["x"], "y", "double", batch_size=1)
    assert sorted(r.y for r in got.collect()) == [3.0, 6.0]


def test_linear_probe_with_a_single_valued_class(spark):
    rng = np.random.default_rng(0)
    h = rng.normal(size=(200, 3))
    y = np.stack([h[:, 0] > 0, np.zeros(200), np.ones(200)], axis=1).astype(int)
    rows = [(i, h[i].tolist(), y[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, embedding array<float>, labels array<int>")
    got = np.array([r.probs for r in C.linear_probe(df, df, 3, reg=0.01).orderBy("i").collect()])
    assert ((got[:, 0] > 0.5) == (y[:, 0] == 1)).mean() > 0.97
    assert np.allclose(got[:, 1], 0) and np.allclose(got[:, 2], 1)


def test_displacement_probe(spark):
    """Its optimum is that of a plain fit by Newton's steps on the training rows; null ends score null."""
    rng = np.random.default_rng(1)
    h, h1 = rng.normal(size=(2, 300, 3))
    a = np.sign(np.round(1.2 * (h1 - h)[:, :2] + rng.normal(size=(300, 2)))).astype(int)
    rows = [(i, h[i].tolist(), h1[i].tolist(), a[i].tolist()) for i in range(300)] + [(300, None, h1[0].tolist(), [1, 0])]
    df = spark.createDataFrame(rows, "i int, h_t array<double>, h_t1 array<double>, a_t array<tinyint>")
    got = C.displacement_probe(df.where("i % 3 > 0"), df, 2, max_iter=200, reg=0.1).orderBy("i").collect()
    assert got[300].onset is None and got[300].resolution is None
    train = np.arange(300) % 3 > 0
    x = np.hstack([h1 - h, np.ones((300, 1))])
    free = np.diag([1.0, 1.0, 1.0, 0.0]) * 0.1
    for name, sign in (("onset", 1), ("resolution", -1)):
        for c in range(2):
            y, w = (a[:, c] == sign).astype(float), np.zeros(4)
            for _ in range(30):
                p = 1 / (1 + np.exp(-x[train] @ w))
                slope = x[train].T @ (p - y[train]) / train.sum() + free @ w
                w -= np.linalg.solve((x[train].T * (p * (1 - p))) @ x[train] / train.sum() + free, slope)
            assert np.allclose([r[name][c] for r in got[:300]], 1 / (1 + np.exp(-x @ w)), atol=1e-4)


def statistic(x, t_max=3.0, n_points=17):
    t = np.linspace(0, t_max, n_points)
    phi, dt = np.exp(-(t**2) / 2), t_max / (n_points - 1)
    w = np.full(n_points, 2 * dt)
    w[[0, -1]] = dt
    e = (np.cos(np.outer(x, t)).mean(0) - phi) ** 2 + np.sin(np.outer(x, t)).mean(0) ** 2
    return len(x) * (e * w * phi).sum()


def test_epps_pulley(spark):
    x = np.random.default_rng(7).normal(size=(500, 2)) * [1.0, 2.0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    got = {r.slice: r.statistic for r in N.epps_pulley(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(statistic(x[:, 0])) and got["b"] == pytest.approx(statistic(x[:, 1]))
    assert got["b"] > 10 * got["a"]
    few = N.epps_pulley(df, ["a"], 2.0, 5).first().statistic
    assert few == pytest.approx(statistic(x[:, 0], 2.0, 5))
    with pytest.raises(ValueError):
        N.epps_pulley(df, ["a"], n_points=4)


def test_sliced_epps_pulley(spark):
    x = np.random.default_rng(8).normal(size=(300, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "embedding array<double>")
    ways = N.random_directions(3, 7, 5)
    assert np.allclose(np.linalg.norm(ways, axis=1), 1)
    assert not np.allclose(ways, N.random_directions(4, 7, 5))
    want = [statistic(x @ w) for w in ways]
    got = N.slice_statistics(df.repartition(3), ways).orderBy("slice").collect()
    assert np.allclose([r.statistic for r in got], want)
    assert N.sliced_epps_pulley(df, ways).first().statistic == pytest.approx(np.mean(want))


def test_rows_of_unequal_length_are_left_out(spark):
    """Values of different rows must never be read as one embedding."""
    good = np.random.default_rng(2).normal(size=(9, 4)).tolist()
    bad = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0], [], None, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0]]
    ways = N.random_directions(1, 3, 4)
    df = spark.createDataFrame([(r,) for pair in zip(good, bad + bad) for r in pair], "embedding array<double>").coalesce(1)
    only = spark.createDataFrame([(r,) for r in good], "embedding array<double>")
    for f in (lambda d: N.slice_statistics(d, ways), lambda d: N.seeded_slice_statistics(d, 5, 4, 3)):
        assert np.allclose([r.statistic for r in f(df).orderBy("slice").collect()], [r.statistic for r in f(only).orderBy("slice").collect()])
    assert N.slice_statistics(spark.createDataFrame([(r,) for r in bad], "embedding array<double>"), ways).count() == 0


def test_seeded_directions(spark, monkeypatch):
    whole = N.counter_directions(3, 0, 1024, 16)
    assert np.allclose(np.linalg.norm(whole, axis=1), 1)
    assert np.array_equal(whole[100:140], N.counter_directions(3, 100, 40, 16))
    assert abs(whole.mean()) < 0.01 and np.abs(whole.T @ whole / 1024 * 16 - np.eye(16)).max() < 0.15
    assert not np.allclose(whole, N.counter_directions(4, 0, 1024, 16))
    draws = N.counter_uniforms(9, np.arange(200_000))
    assert abs(np.histogram(draws, 50, (0, 1))[0] - 4000).max() < 300 and abs(np.corrcoef(draws[:-1], draws[1:])[0, 1]) < 0.01
    x = np.random.default_rng(8).normal(size=(200, 16))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "embedding array<double>")
    monkeypatch.setattr(N, "DIRECTIONS_AT_ONCE", 7)
    got = N.seeded_slice_statistics(df.repartition(3), 20, 16, 3).orderBy("slice").collect()
    assert np.allclose([r.statistic for r in got], [statistic(x @ w) for w in whole[:20]])


def test_ordered_keys():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, 0.0, 5e-324, 1.0, np.nextafter(1, 2), 7e200, np.inf, np.nan])
    keys = G.ordered_keys(x)
    assert (np.diff(keys.astype(object)) > 0).all() and G.ordered_keys(np.array([-0.0]))[0] == keys[4]
    back = [G.value_of_key(int(k)) for k in keys]
    assert np.array_equal(back, x, equal_nan=True)


@pytest.mark.parametrize("limit", [0, 40, 10_000])
def test_ranks_of_awkward_values(spark, limit):
    """Values over the whole range of doubles, ties, nulls, several groups, a null group and a null-only one."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=200), 10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-300, 300, 200)), np.repeat(1.5, 200), [0.0, -0.0]])
    rows = [(None if i % 3 == 0 else i % 3, float(x)) for i, x in enumerate(values)] + [(1, None), (7, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    ranks = lambda n: [0, n // 3, n // 2, n - 1]
    got = G.select_ranks(df, ["g"], "x", ranks, limit)
    for g in (None, 1, 2):
        own = sorted(x for k, x in rows if k == g and x is not None)
        assert got[(g,)] == (len(own), {r: own[r] for r in ranks(len(own))})
    assert set(got) == {(None,), (1,), (2,)}
    assert G.percentiles(df.where("false"), ["g"], "x", [50], limit).count() == 0
    assert G.percentiles(df.where("g = 1"), [], "x", [50], limit).first()[0] == pytest.approx(np.median([x for k, x in rows if k == 1 and x is not None]))


def test_selection_moves_counts_only(spark):
    df = spark.range(5000).selectExpr("id % 2 AS g", "sqrt(id) AS x")
    text = G._digit_counts(df, ["g"], "x", 0, G.DIGIT, [0])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and all("_value" not in line for line in text.splitlines() if "Exchange" in line)
