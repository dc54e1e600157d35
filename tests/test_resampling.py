"""Bootstrap counts from the tree of row ranges: sums, distribution, and independence of how tasks split it."""

import math

import numpy as np
import pytest

from stayline.operators import bootstrap as B, metrics as M, resampling as R


def plain_bits(seed, replicate, node, step, count):
    """The random bits of a split's step, one integer for each draw."""
    out, mask = [], (1 << 64) - 1
    for i in range(count):
        parts = {"seed": seed, "replicate": replicate, "node": node, "step": step, "word": i // 64}
        x = sum(v * R.SPREAD[k] for k, v in parts.items()) & mask
        for shift, factor in R.ROUNDS:
            x = ((x ^ (x >> shift)) * factor) & mask
        x ^= x >> R.LAST_SHIFT
        used = min(64, count - i // 64 * 64)
        out.append((x >> (64 - used)) >> (i % 64) & 1)
    return out


def plain_tree(n, seed, replicate):
    """Row counts, by one comparison of bits for each draw."""
    counts, stack = [0] * n, [(1, 0, n, n)]
    while stack:
        node, first, size, c = stack.pop()
        if size == 1 or c == 0:
            counts[first] += c if size == 1 else 0
            continue
        half = 1 << ((size - 1).bit_length() - 1)
        rest, left, won, step = half, c, 0, 0
        while left and rest:
            rest *= 2
            bit = rest >= size
            rest -= bit * size
            ones = sum(plain_bits(seed, replicate, node, step, left))
            won, left, step = won + (left - ones if bit else 0), ones if bit else left - ones, step + 1
        stack += [(2 * node, first, half, won), (2 * node + 1, first + half, size - half, c - won)]
    return counts


def weights_of(spark, n, replicates, seed, **how):
    positions = spark.range(n).withColumnRenamed("id", "pos")
    out = np.zeros((replicates, n), int)
    for r in R.held_positions(positions, replicates, seed, **how).collect():
        assert list(r["held"]) == sorted(r["held"])
        np.add.at(out[:, r["pos"]], r["held"], 1)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 333])
def test_equals_plain_loop(spark, n):
    got = weights_of(spark, n, 3, 42)
    assert got.tolist() == [plain_tree(n, 42, r) for r in range(3)]


def test_blocks_and_depth_change_nothing(spark):
    one = weights_of(spark, 1500, 7, 1)
    assert (one.sum(axis=1) == 1500).all()
    for how in ({"block": 16, "depth": 1}, {"block": 64, "depth": 3}, {"block": 2, "depth": 20}):
        assert (weights_of(spark, 1500, 7, 1, **how) == one).all()
    assert not (weights_of(spark, 1500, 7, 2) == one).all()


def test_slabs_change_nothing(monkeypatch):
    trials, key = np.array([0, 1, 63, 64, 65, 5000, 3]), np.arange(7).astype(np.uint64)
    whole = R._ones(trials, key)
    monkeypatch.setattr(R, "SLAB", 3)
    assert (R._ones(trials, key) == whole).all() and (whole <= trials).all() and abs(whole[5] - 2500) < 200


@pytest.mark.parametrize("left, size", [(1, 2), (2, 3), (4, 7), (1, 10), (999, 1000)])
def test_splits_are_binomial(left, size):
    """Counts of 40 draws over 20,000 replicates against the exact probabilities, by chi square."""
    n, trials = 20_000, 40
    full = lambda x: np.full(n, x, np.int64)
    got = R.left_draws(full(trials), full(left), full(size), np.arange(n), full(9), 5)
    p = left / size
    expected = np.array([n * math.comb(trials, k) * p**k * (1 - p) ** (trials - k) for k in range(trials + 1)])
    seen = np.bincount(got, minlength=trials + 1)
    likely = expected >= 5
    chi = ((seen[likely] - expected[likely]) ** 2 / expected[likely]).sum()
    free = likely.sum() - 1
    assert chi < free + 5 * math.sqrt(2 * free) and seen[~likely].sum() < expected[~likely].sum() + 30


def test_rows_are_alike_and_independent(spark):
    w = weights_of(spark, 37, 3000, 8)
    assert np.abs(w.mean(axis=0) - 1).max() < 0.1 and np.abs(w.var(axis=0) - 36 / 37).max() < 0.15
    apart = np.corrcoef(w.T)[~np.eye(37, dtype=bool)]
    assert abs(apart.mean() + 1 / 36) < 0.005 and np.abs(apart + 1 / 36).max() < 0.1


def test_auroc_with_tree_draws(spark):
    rng = np.random.default_rng(4)
    rows = [(i, c, float(rng.integers(0, 6)), int(rng.integers(0, 2))) for i in range(60) for c in range(2)]
    df = spark.createDataFrame(rows, "row_idx long, class_idx int, score double, target int")
    weights = B.tree_draws(df, 5, 3)
    assert {r["replicate"]: r["n"] for r in weights.groupBy("replicate").agg({"weight": "sum"}).toDF("replicate", "n").collect()} == dict.fromkeys(range(5), 60)
    want = {r["replicate"]: r["macro_auroc"] for r in M.macro_auroc(df.join(weights, "row_idx"), ["replicate"], "weight").collect()}
    got = {r["replicate"]: r["macro_auroc"] for r in B.bootstrap_replicates(df, 5, 3, method="tree", limit=7).collect()}
    assert got == pytest.approx(want)


def test_no_rows(spark):
    assert B.tree_draws(spark.createDataFrame([], "row_idx long"), 3, 1).count() == 0


def test_draws_are_not_shuffled(spark):
    """The exchanges move ranges of rows (replicate, node, first, size, count), no replicate of a row."""
    held = R.held_positions(spark.range(100_000).withColumnRenamed("id", "pos"), 50, 1)
    text = held._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in text.splitlines() if "Exchange" in x]
    assert lines and not any("pos" in x or "held" in x for x in lines)
