import numpy as np
import pandas as pd
import pytest

from stayline.operators import pairs as P

SCHEMA = "row_idx long, subject_id int, ecg_time double, ecg_no_within_stay short, fold byte"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def subject(seqs, subject_id=1, fold=3):
    return [(i, subject_id, float(i), s, fold) for i, s in enumerate(seqs)]


def links(df):
    return [(r.idx_t, r.idx_t1, r.pair_type.split("_")[0]) for r in df.orderBy("idx_t").collect()]


@pytest.mark.parametrize("limit", [100, 2])
def test_eight_recordings(spark, limit):
    rows = make(spark, subject([0, 1, 2, 0, 1, 0, 0, 1]))
    kinds = ["within", "within", "cross", "within", "cross", "cross", "within"]
    assert links(P.build_pairs(rows, limit)) == [(i, i + 1, k) for i, k in enumerate(kinds)]
    stays = [r.stay for r in P.assign_stays(rows, limit).orderBy("row_idx").collect()]
    assert stays == [0, 0, 0, 1, 1, 2, 3, 3]
    tags = P.subject_timeline(rows, 1, limit).collect()
    assert [(r.tag, r.stay) for r in tags] == [(f"x{i + 1}", s) for i, s in enumerate(stays)]


@pytest.mark.parametrize(
    "seqs, kinds, stays",
    [
        ([0, 3, 7], ["within", "within"], [0, 0, 0]),
        ([0, 2, 1], ["within", "cross"], [0, 0, 0]),
        ([1, 2, 0], ["within", "cross"], [-1, -1, 0]),
        ([1, 1], ["cross"], [-1, -1]),
        ([None, 1], ["cross"], [-1, -1]),
    ],
)
def test_unusual_numbers(spark, seqs, kinds, stays):
    rows = make(spark, subject(seqs))
    assert [k for _, _, k in links(P.build_pairs(rows))] == kinds
    assert [r.stay for r in P.assign_stays(rows).orderBy("row_idx").collect()] == stays


def test_ties_nulls_and_lone_subjects(spark):
    rows = make(
        spark,
        [
            (7, 1, 5.0, 1, 0),
            (3, 1, 5.0, 0, 0),
            (1, 1, None, 0, 0),
            (9, 2, 1.0, 0, 0),
            (10, None, 1.0, 0, 0),
            (11, None, 2.0, 1, 0),
        ],
    )
    assert links(P.build_pairs(rows)) == [(3, 7, "within"), (7, 1, "cross")]


def test_first_fold_wins(spark):
    rows = make(spark, [(0, 1, 0.0, 0, 3), (1, 1, 1.0, 1, 19), (2, 1, 2.0, 2, 19)])
    for limit in (100, 1):
        assert {r.fold for r in P.build_pairs(rows, limit).collect()} == {3}


def random_recordings(n=5000, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "row_idx": np.arange(n),
            "subject_id": np.where(rng.random(n) < 0.35, 0, rng.integers(1, 400, n)),
            "ecg_time": rng.integers(0, 200, n).astype(float),
            "ecg_no_within_stay": rng.integers(0, 4, n),
            "fold": rng.integers(0, 20, n),
        }
    )


def brute_pairs(pdf):
    out = []
    for s, g in pdf.sort_values(["ecg_time", "row_idx"]).groupby("subject_id"):
        idx, seq = g.row_idx.tolist(), g.ecg_no_within_stay.tolist()
        for i in range(len(g) - 1):
            kind = "within_stay" if seq[i] < seq[i + 1] else "cross_stay"
            out.append((idx[i], idx[i + 1], s, g.fold.iloc[0], kind))
    return sorted(out)


@pytest.mark.parametrize("limit", [10_000, 50])
def test_dominant_subject(spark, limit):
    pdf = random_recordings()
    rows = spark.createDataFrame(pdf)
    assert sorted(map(tuple, P.build_pairs(rows, limit).collect())) == brute_pairs(pdf)


def test_select_subjects(spark):
    a, b, c = subject([0, 1, 0, 0], 1), subject([0, 0, 1, 0], 2), subject([0, 0, 0, 0], 3)
    d, e = subject([0, 1, 0, 1, 0, 1], 4), subject([0, 1], 5)
    rows = [(i, *r[1:]) for i, r in enumerate(a + b + c + d + e)]
    got = P.select_subjects(make(spark, rows), n=10).collect()
    assert [(r.subject_id, r.stays, r["rows"]) for r in got] == [(4, 3, 6), (1, 3, 4), (2, 3, 4)]


def test_no_pair_types(spark):
    pairs = P.build_pairs(make(spark, subject([0, 1])))
    with pytest.raises(ValueError):
        P.filter_pairs(pairs, "train", [])
    with pytest.raises(ValueError):
        P.filter_pairs(pairs, "all", ["cross_stay"])
