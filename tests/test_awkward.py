"""Nulls, wrong lengths, empty tables, clashing names and small limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.functions import arrays
from stayline.operators import bootstrap as B
from stayline.operators import metrics as M
from stayline.operators import normality as N
from stayline.operators import ordered as O
from stayline.operators import scoring as G
from stayline.operators import select as D
from stayline.operators.lineage import shared_folder

SIGNALS = [
    (0, [float(i) for i in range(6)]),
    (1, [1.0, 2.0, 3.0, 4.0, 5.0]),
    (2, [float(i) for i in range(100, 107)]),
    (3, None),
    (4, []),
    (5, [float(i) for i in range(10, 16)]),
    (6, [1.0, None, 3.0, 4.0, 5.0, 6.0]),
]


def test_both_layouts_agree_on_wrong_lengths(spark):
    df = spark.createDataFrame(SIGNALS, "id int, s array<float>").coalesce(1)
    short = arrays.lead_major("s", 3, 2)
    for zscore in (False, True):
        long = arrays.lead_major_batch(3, 2, zscore)("s")
        first = arrays.zscore_leads(F.transform(short, lambda x: x.cast("array<double>"))) if zscore else short
        rows = df.select("id", first.alias("a"), long.alias("b")).orderBy("id").collect()
        for r in rows:
            assert (r["a"] is None) == (r["b"] is None) == (r["id"] in (1, 2, 3, 4))
            for x, y in zip(r["a"] or [], r["b"] or []):
                assert [v is None for v in x] == [v is None for v in y]
                assert all(v is None or v == pytest.approx(w, abs=1e-6) for v, w in zip(x, y))
    assert rows[5]["b"] is not None and df.select(arrays.lead_major_batch(3, 2)("s").alias("b")).first()["b"] == [[0, 2, 4], [1, 3, 5]]


@pytest.mark.parametrize("long", [False, True])
def test_batches_of_nulls_only(spark, long):
    df = spark.createDataFrame([(i, None) for i in range(5)], "id int, s array<float>")
    turn = arrays.lead_major_batch(3, 2)("s") if long else arrays.lead_major("s", 3, 2)
    assert [r["x"] for r in df.select(turn.alias("x")).collect()] == [None] * 5
    assert N.sliced_epps_pulley(df, np.ones((2, 6)), "s").collect() is not None


def test_null_targets_count_nowhere(spark):
    rows = [(i, 0, i / 10, [0, 1, None][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_idx smallint, class_idx int, score double, target int")
    known = df.where("target IS NOT NULL")
    assert M.auroc_by_class(df).collect() == M.auroc_by_class(known).collect()
    for method in ("blocks", "cells"):
        got = B.bootstrap_replicates(df, 4, 3, method=method, limit=8).orderBy("replicate").collect()
        assert len(got) == 4 and all(0 <= r["macro_auroc"] <= 1 for r in got)


def test_small_integers_and_dates_as_group_keys(spark):
    rows = [(i, i % 2, i / 10, int(i * 7 % 3 > 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "row_idx long, class_idx smallint, score double, target int")
    df = df.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("row_idx").cast("int") % 2))
    blocks, cells = (
        B.bootstrap_replicates(df, 3, 1, group=["day"], method=m).orderBy("day", "replicate").collect() for m in ("blocks", "cells")
    )
    assert [r["macro_auroc"] for r in blocks] == pytest.approx([r["macro_auroc"] for r in cells])


def test_blocks_stay_small_at_a_thousand_limits(spark):
    df = spark.range(64_000).withColumn("g", F.lit(0))
    cut, _ = O.cut_groups(df, ["g"], ["id"], 64)
    sizes = cut.groupBy("_chunk").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 4 * 64 and sizes[1] >= 400


def test_existing_names_are_refused(spark):
    df = spark.range(5).withColumn("row_idx", F.lit(1))
    with pytest.raises(ValueError):
        O.row_positions(df, [], ["id"], "row_idx")
    with pytest.raises(ValueError):
        O.positions_joined(df.withColumn("cells", F.array("id")), ["id"], "row_idx")


def test_draws_with_replacement_need_no_dense_ids(spark):
    df = spark.range(100, 200).withColumnRenamed("id", "row_idx")
    got = D.sample_rows(df, 50, seed=4, replace=True).collect()
    assert len(got) == 50 and {r["pos"] for r in got} == set(range(50))
    assert all(100 <= r["row_idx"] < 200 for r in got) and len({r["row_idx"] for r in got}) > 20
    assert D.sample_rows(df.limit(0), 5, replace=True).collect() == []


def test_null_and_short_inputs_score_null(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [3.0]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    got = {r["id"]: r for r in G.linear_head(df, np.ones((3, 2)), np.zeros(3)).collect()}
    assert got[0]["logits"] == [3.0] * 3 and got[3]["probs"] == [0.5] * 3
    assert got[1]["logits"] is None and got[2]["probs"] is None
    empty = df.where("id = 1")
    assert [r["logits"] for r in G.linear_head(empty, np.ones((3, 2)), np.zeros(3)).collect()] == [None]


def test_probe_reaches_the_optimum_in_a_bounded_number_of_jobs(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 2, (300, 5))
    y[:, 4] = 0
    rows = [(a.tolist(), b.tolist()) for a, b in zip(x, y)] + [(None, y[0].tolist()), (x[0, :2].tolist(), y[0].tolist())]
    df = spark.createDataFrame(rows, "embedding array<double>, labels array<int>")
    fitted = G.fit_probe(df, 4, "embedding", "labels", 100, 0.01)
    assert (fitted == 0).all()  # labels of another length than the classes are left out
    fitted = G.fit_probe(df, 5, "embedding", "labels", 60, 0.01)
    wide = np.concatenate([x, np.ones((300, 1))], axis=1)
    slope = (G.sigmoid(wide @ fitted.T) - y).T @ wide / 300 + 0.01 * fitted * np.array([1, 1, 1, 1, 0])
    assert np.abs(slope[:4]).max() < 1e-5 and fitted[4, -1] < -4


def test_a_cluster_has_to_name_the_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return None

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError):
        shared_folder(Session)
