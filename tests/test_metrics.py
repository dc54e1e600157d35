import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.operators import bootstrap as B
from stayline.operators import metrics as M


def auroc(score, target, weight=None):
    weight = np.ones(len(score)) if weight is None else weight
    p, n = target > 0, target <= 0
    w = np.outer(weight[p], weight[n])
    diff = score[p][:, None] - score[n][None, :]
    total = w.sum()
    return ((diff > 0) * w + 0.5 * (diff == 0) * w).sum() / total if total else np.nan


@pytest.fixture(scope="module")
def cells():
    """300 rows, 4 classes: coarse scores, a tie of a third of all rows, one class without positives."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(4):
        score = np.round(rng.random(300), [1, 3, 2, 2][c])
        if c == 1:
            score[rng.random(300) < 0.34] = 0.5
        target = (rng.random(300) < 0.3).astype(int) if c < 3 else np.zeros(300, int)
        rows.append(pd.DataFrame({"row": np.arange(300) * 7, "class_idx": c, "score": score, "target": target}))
    return pd.concat(rows)


@pytest.mark.parametrize("limit", [10_000, 8, 1])
def test_auroc_by_class(spark, cells, limit):
    weighted = cells.assign(w=cells.row % 5)
    df = spark.createDataFrame(weighted)
    for weight in (None, "w"):
        got = {r.class_idx: r.auroc for r in M.auroc_by_class(df, weight=weight, limit=limit).collect()}
        assert sorted(got) == [0, 1, 2]
        for c, g in weighted.groupby("class_idx"):
            if c < 3:
                w = g.w.to_numpy() if weight else None
                assert got[c] == pytest.approx(auroc(g.score.to_numpy(), g.target.to_numpy(), w))
    macro = M.macro_auroc(df, limit=limit).first()
    assert macro.classes == 3


def test_constant_score_and_single_values(spark):
    rows = [(0, 0.3, 0), (0, 0.3, 1), (1, 0.1, 1), (1, 0.2, 1), (2, 0.1, 0)]
    df = spark.createDataFrame(rows, "class_idx int, score double, target int")
    assert [tuple(r) for r in M.auroc_by_class(df).collect()] == [(0, 0.5)]


def replicate_aurocs(cells, replicates, seed):
    """The same draws in a plain loop."""
    import hashlib

    rows = np.sort(cells.row.unique())
    n = len(rows)
    out = []
    for r in range(replicates):
        keys = [f"{seed}:{k}" for k in range(r * n, (r + 1) * n)]
        idx = np.array([int(hashlib.md5(k.encode()).hexdigest()[:15], 16) % n for k in keys])
        weight = np.bincount(idx, minlength=n)
        per_class = []
        for _, g in cells.groupby("class_idx"):
            g = g.sort_values("row")
            a = auroc(g.score.to_numpy(), g.target.to_numpy(), weight)
            if not np.isnan(a):
                per_class.append(a)
        out.append(np.mean(per_class))
    return np.array(out)


@pytest.mark.parametrize(
    "method, limit", [("cells", None), ("cells", 16), ("blocks", None), ("blocks", 16), ("blocks", 2)]
)
def test_bootstrap_methods(spark, cells, method, limit):
    """The block sums themselves run in 1,024-row slices; test_block_slices makes those small."""
    want = replicate_aurocs(cells, 6, 42)
    df = spark.createDataFrame(cells)
    got = B.bootstrap_replicates(df, 6, 42, "row", method=method, limit=limit).orderBy("replicate")
    assert np.allclose([r.macro_auroc for r in got.collect()], want)
    r = B.bootstrap_auroc(df, 6, 42, "row", method=method, limit=limit).first()
    assert r["mean"] == pytest.approx(want.mean())
    assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(want, [2.5, 97.5])))


def test_replicates_without_usable_class_are_left_out(spark):
    rows = [(i, 0, float(i), int(i == 0)) for i in range(4)]
    df = spark.createDataFrame(rows, "row long, class_idx int, score double, target int")
    for method in ("cells", "blocks"):
        got = B.bootstrap_replicates(df, 40, 1, "row", method=method)
        held = {r.replicate for r in B.bootstrap_draws(df, 40, 1, "row").where("row = 0 AND weight < 4").collect()}
        assert {r.replicate for r in got.collect()} == held and 0 < len(held) < 40


def test_draws_add_up(spark):
    got = B.bootstrap_draws(spark.range(50).withColumnRenamed("id", "row_idx"), 5, 0)
    assert {r["n"] for r in got.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()} == {50}


def test_binary_baselines_equal_the_general_metric(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {"idx_t": np.arange(400), "class_idx": np.arange(400) % 3, "y_t": rng.integers(0, 2, 400), "y_t1": rng.integers(0, 2, 400)}
    )
    pdf["a_t"] = pdf.y_t1 - pdf.y_t
    df = spark.createDataFrame(pdf)
    for fn, score, target in (
        (M.carry_forward, "y_t", "y_t1"),
        (M.onset_structural, "1 - y_t", "int(a_t = 1)"),
        (M.resolution_structural, "y_t", "int(a_t = -1)"),
    ):
        general = M.auroc_by_class(df.selectExpr("class_idx", f"{score} AS score", f"{target} AS target"))
        assert {r[0]: pytest.approx(r[1]) for r in general.collect()} == {r[0]: r[1] for r in fn(df).collect()}


def test_losses(spark):
    rng = np.random.default_rng(2)
    x, y = np.append(rng.normal(size=50) * 5, [800.0, -800.0]), np.append(rng.integers(0, 2, 50), [0, 1])
    df = spark.createDataFrame(pd.DataFrame({"logit": x, "target": y}))
    softplus = np.logaddexp(0, -x)
    for w in (1.0, 46.0):
        want = ((1 - y) * x + (1 + (w - 1) * y) * softplus).mean()
        assert M.bce_with_logits(df, pos_weight=w).first().loss == pytest.approx(want)
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 4.0])], "a array<double>, b array<double>")
    assert M.mse(df, "a", "b").first().mse == 2.5
    one = [spark.range(1).select(F.lit(v)) for v in (2.0, 3.0, 5.0)]
    r = M.objective(*one, 0.25).first()
    assert (r.loss, r.loss_ratio) == (0.75 * 2 + 0.25 * 8, pytest.approx(4.0))


def test_class_balance(spark):
    rows = [(0, 1), (0, 0), (0, 0), (1, 0)]
    got = M.class_balance(spark.createDataFrame(rows, "class_idx int, target int")).orderBy("class_idx")
    assert [tuple(r) for r in got.collect()] == [(0, 1, 2, 2.0, True), (1, 0, 1, None, False)]


def test_transition_tasks(spark):
    rows = [(5, [0, 1, 1], [1, -1, 0], [0.5, 0.5, 0.25], [0.0, 0.75, 0.5])]
    schema = "idx_t long, y_t array<tinyint>, a_t array<tinyint>, onset array<double>, resolution array<double>"
    got = B.transition_task_cells(spark.createDataFrame(rows, schema)).collect()
    assert {(r.task, r.class_idx): (r.score, r.target) for r in got} == {
        ("onset", 0): (0.5, 1),
        ("onset", 1): (0.5, 0),
        ("onset", 2): (0.25, 0),
        ("resolution", 0): (0.0, 0),
        ("resolution", 1): (0.75, 1),
        ("resolution", 2): (0.5, 0),
        ("contextual", 0): (0.5, 1),
        ("contextual", 1): (0.25, 0),
        ("contextual", 2): (0.5, 1),
    }


@pytest.mark.parametrize("slice_rows", [1, 2, 7, 1000])
def test_block_slices(monkeypatch, slice_rows):
    import pyarrow as pa

    monkeypatch.setattr(B, "SLICE_ROWS", slice_rows)
    rng = np.random.default_rng(9)
    names = ["replicate", "total", "edge", "pos", "neg", "wins"]
    types = [pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
    schema = pa.schema([("class_idx", pa.int32()), *zip(names, types)])
    for levels in (1, 2, 4, 40):
        score, target = rng.integers(0, levels, 60) / 8.0, rng.integers(0, 2, 60).astype(float)
        held = [rng.integers(0, 3, rng.integers(1, 5)).tolist() for _ in range(60)]
        table = pa.table({"class_idx": pa.array([4] * 60, pa.int32()), "score": score, "target": target, "held": pa.array(held, pa.list_(pa.int16()))})
        got = B._block_sums(3, ["class_idx"], schema)(table).to_pandas()
        weight = np.array([np.bincount(h, minlength=3) for h in held])
        for r in range(3):
            w, p, n = weight[:, r], target > 0, target <= 0
            won = (score[p][:, None] > score[n]) + 0.5 * (score[p][:, None] == score[n])
            mine = got[got.replicate == r]
            all_rows = mine[mine.total].iloc[0]
            assert all_rows.wins == pytest.approx((won * np.outer(w[p], w[n])).sum())
            assert (all_rows.pos, all_rows.neg) == (w[p].sum(), w[n].sum())
            edges = mine[~mine.total].set_index("edge")
            assert sorted(edges.index) == sorted({score.min(), score.max()})
            for e, row in edges.iterrows():
                assert (row.pos, row.neg) == (w[p & (score == e)].sum(), w[n & (score == e)].sum())


def test_evaluate_transitions_methods_agree(spark):
    rng = np.random.default_rng(11)
    y, z = rng.integers(0, 2, (80, 3)), rng.integers(0, 2, (80, 3))
    p, q = np.round(rng.random((80, 3)), 1), np.round(rng.random((80, 3)), 2)
    rows = [(i * 3, y[i].tolist(), (z - y)[i].tolist(), p[i].tolist(), q[i].tolist()) for i in range(80)]
    schema = "idx_t long, y_t array<tinyint>, a_t array<tinyint>, onset array<double>, resolution array<double>"
    df = spark.createDataFrame(rows, schema)
    ids = np.arange(80) * 3
    want = {}
    tasks = {"onset": (p, z - y == 1), "resolution": (q, z - y == -1), "contextual": (y * (1 - q) + (1 - y) * p, z)}
    for task, (score, target) in tasks.items():
        cells = pd.DataFrame(
            {"row": np.repeat(ids, 3), "class_idx": np.tile(range(3), 80), "score": score.ravel(), "target": target.ravel().astype(int)}
        )
        want[task] = replicate_aurocs(cells, 4, 5)
    for method, limit in (("blocks", 10), ("cells", 10), ("blocks", None)):
        got = {r.task: r for r in B.evaluate_transitions(df, 4, 5, method=method, limit=limit).collect()}
        for task, aurocs in want.items():
            assert got[task]["mean"] == pytest.approx(aurocs.mean())
            assert (got[task].lo, got[task].hi) == pytest.approx(tuple(np.percentile(aurocs, [2.5, 97.5])))
