"""Cut groups give the same results as whole ones, also with ties, nulls and one dominant group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.operators.ordered import cut_groups, row_positions, running


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 6000
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 300, n))
    time = rng.integers(0, 40, n).astype(float)
    pdf = pd.DataFrame(
        {"g": group, "t": time, "id": rng.permutation(n), "v": rng.integers(0, 9, n)}
    )
    df = spark.createDataFrame(pdf)
    return df.withColumn("t", F.when(F.col("id") % 50 != 0, F.col("t"))), pdf


def expected(pdf):
    pdf = pdf.copy()
    pdf.loc[pdf.id % 50 == 0, "t"] = np.inf
    pdf = pdf.sort_values(["g", "t", "id"])
    pdf["before"] = pdf.groupby("g").v.cumsum() - pdf.v
    pdf["pos"] = pdf.groupby("g").cumcount()
    return pdf.set_index("id")[["before", "pos"]].sort_index()


@pytest.mark.parametrize("limit", [10_000, 64, 1])
def test_running_in_groups(skewed, limit):
    df, pdf = skewed
    got = running(df, ["g"], ["t", "id"], {"before": F.col("v"), "pos": F.lit(1)}, limit).toPandas()
    got = got.set_index("id")[["before", "pos"]].sort_index()
    assert (got == expected(pdf)).all().all()


@pytest.mark.parametrize("limit", [10_000, 64])
def test_positions_over_all_rows(skewed, limit):
    df, pdf = skewed
    got = row_positions(df, [], ["id"], "pos", limit).toPandas()
    assert (got.sort_values("id").pos.to_numpy() == np.arange(len(pdf))).all()


def test_chunks_are_small_and_in_order(skewed):
    df, _ = skewed
    cut, hot = cut_groups(df, ["g"], ["t", "id"], 64)
    sizes = cut.groupBy("g", "_chunk").count().toPandas()
    assert sizes["count"].max() < 64 * 4
    assert hot.select("g").distinct().count() < 60
    top = cut.where("g = 0").toPandas()
    top["t"] = top.t.fillna(np.inf)
    assert top.sort_values(["t", "id"])._chunk.is_monotonic_increasing


def test_small_groups_stay_whole(skewed):
    df, _ = skewed
    cut, hot = cut_groups(df, ["g"], ["t", "id"], 10_000)
    assert hot is None and cut.select("_chunk").distinct().count() == 1
