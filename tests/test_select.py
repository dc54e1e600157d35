import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.functions import draw
from stayline.operators import select as D


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(
        F.col("id").alias("row_idx"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 101).cast("int").alias("subject_id"),
        (F.col("id") % 20).cast("tinyint").alias("fold"),
        (F.col("id") % 4).cast("smallint").alias("ecg_no_within_stay"),
    )


def test_splits_cover_all_rows_once(rows):
    parts = {s: D.split(rows, s).count() for s in ("train", "val", "test")}
    assert parts == {"train": 2700, "val": 150, "test": 150}
    with pytest.raises(ValueError):
        D.split(rows, "dev")
    assert D.select_mode(rows, "triage").count() == 750
    assert D.select_mode(rows, "monitoring").count() == 3000
    with pytest.raises(ValueError):
        D.select_mode(rows, "pair")


@pytest.mark.parametrize("frac, n", [(0.25, 25), (0.0001, 1), (0.999, 100)])
def test_subject_fraction(rows, frac, n):
    kept = D.subject_fraction(rows, frac, seed=4)
    subjects = {r[0] for r in kept.select("subject_id").distinct().collect()}
    assert len(subjects) == n
    assert kept.count() == rows.where(F.col("subject_id").isin(list(subjects))).count()
    other = {r[0] for r in D.subject_fraction(rows, frac, seed=5).select("subject_id").distinct().collect()}
    assert n > 90 or subjects != other


def test_whole_fraction_keeps_all(rows):
    assert D.subject_fraction(rows, 1.0).count() == 3000


def test_fraction_of_nothing(rows):
    assert D.subject_fraction(rows.where("false"), 0.5).count() == 0


@pytest.mark.parametrize("n", [1, 700, 3000, 9000])
@pytest.mark.parametrize("slice_rows", [10_000, 1, 0])
def test_sample_without_replacement(rows, n, slice_rows, monkeypatch):
    monkeypatch.setattr(D, "SLICE_ROWS", slice_rows)
    drawn = rows.select("row_idx", draw("row_idx", 1).alias("d")).orderBy("d").limit(n)
    want = {r.row_idx for r in drawn.collect()}
    assert {r.row_idx for r in D.sample_rows(rows, n, seed=1).collect()} == want
    got = [r.row_idx for r in D.sample_rows(rows, n, seed=1).collect()]
    assert len(got) == len(set(got)) == min(n, 3000)


def test_sample_with_replacement(rows):
    got = D.sample_rows(rows, 5000, seed=1, replace=True).toPandas()
    assert sorted(got.pos) == list(range(5000)) and got.row_idx.nunique() < 3000


def test_sample_per_group(rows):
    got = D.sample_per_group(rows, "subject_id", 3, seed=2).groupBy("subject_id").count().collect()
    assert len(got) == 101 and {r["count"] for r in got} == {3}


def test_take_rows(spark, rows):
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, 7)], "pos long, row_idx long")
    got = D.take_rows(rows, ids, ["subject_id"]).collect()
    assert [(r.pos, r.row_idx) for r in got] == [(0, 7), (1, 3), (2, 7)]


def test_batches(rows):
    got = D.assign_batches(rows, 256, shuffle=True, seed=3).toPandas().sort_values("pos")
    assert len(got) == 11 * 256 and (got.pos.to_numpy() == np.arange(len(got))).all()
    assert (got.batch == got.pos // 256).all() and not got.row_idx.is_monotonic_increasing
    kept = D.assign_batches(rows, 256, shuffle=True, seed=3, drop_last=False)
    assert kept.count() == 3000
    plain = D.assign_batches(rows, 256).toPandas().sort_values("pos")
    assert (plain.row_idx.to_numpy() == np.arange(3000)).all()
