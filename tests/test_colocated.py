"""Fetching both ends of pairs in one place: same rows as the joins, one shuffle of the cells or none."""

import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import colocated as C, pairs as P
from stayline.plans import views as V
from stayline.sources import tables as R

SF = "/root/testdata/sf0.001"
COLUMNS = ["icd", "waveform"]


@pytest.fixture(scope="module")
def skewed(spark):
    """One subject with half of all rows, tied and null times, and a null subject."""
    draw = random.Random(3)
    rows = []
    for i in range(1200):
        subject = 1 if draw.random() < 0.5 else draw.randint(2, 40)
        time = None if i % 37 == 0 else float(draw.randint(0, 60))
        rows.append((i, i, None if i % 101 == 0 else subject, time, draw.randint(0, 3), subject % 20, [f"c{i % 3}"], [i % 2], [i / 7, float(i)]))
    ddl = "row_idx long, study_id int, subject_id int, ecg_time double, ecg_no_within_stay short, fold byte, icd_raw array<string>, icd array<byte>, waveform array<float>"
    return spark.createDataFrame(rows, ddl)


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)


@pytest.mark.parametrize("limit", [10_000, 50, 7, 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_joins(skewed, limit, how):
    index = P.build_pairs(skewed)
    same(C.fetch_pairs_together(index, skewed, COLUMNS, how, limit), P.fetch_pairs(index, skewed, COLUMNS, how))


@pytest.mark.parametrize("limit", [10_000, 9])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_repeated_missing_and_far_pairs(spark, skewed, limit, how):
    """Pairs that occur twice, whose ends are not stored, or that lead far over a cut subject."""
    index = P.build_pairs(skewed).withColumn("extra", F.col("idx_t") % 3)
    ids = [r["row_idx"] for r in skewed.where("subject_id = 1").orderBy("ecg_time", "row_idx").collect()]
    far = [(ids[i], ids[j], 1, 1, "cross_stay", 0) for i, j in ((0, 300), (300, 0), (5, 5), (10, 12))]
    gone = [(10**6, ids[0], 1, 1, "cross_stay", 1), (ids[0], 10**6, 1, 1, "cross_stay", 1), (10**6, 10**7, 3, 1, "cross_stay", 1)]
    more = spark.createDataFrame(far + gone, index.select("idx_t", "idx_t1", "subject_id", "fold", "pair_type", F.col("extra").cast("long")).schema)
    index = index.withColumn("extra", F.col("extra").cast("long")).unionByName(more).unionByName(index.where("extra = 1"))
    same(C.fetch_pairs_together(index, skewed, COLUMNS, how, limit), P.fetch_pairs(index, skewed, COLUMNS, how))


def test_empty_tables(skewed):
    index = P.build_pairs(skewed)
    assert C.fetch_pairs_together(index.where("false"), skewed, COLUMNS).count() == 0
    assert C.fetch_pairs_together(index, skewed.where("false"), COLUMNS).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wide_exchanges(df):
    """Exchanges whose input or output carries the cells."""
    found, stack, seen = [], [df._jdf.queryExecution().executedPlan()], set()
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.inputPlan())
            continue
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
        text = node.output().toString()
        if "Exchange" in node.nodeName() and node.id() not in seen and ("waveform" in text or "_cells" in text):
            seen.add(node.id())
            found.append(node.nodeName())
    return found


@pytest.mark.parametrize("limit", [10_000, 20])
def test_cells_move_once(spark, tmp_path, skewed, limit):
    skewed.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    index = P.build_pairs(rows)
    index.write.parquet(str(tmp_path / "pairs"))
    found = C.fetch_pairs_together(spark.read.parquet(str(tmp_path / "pairs")), rows, COLUMNS, limit=limit)
    assert wide_exchanges(found) == ["Exchange"]


@pytest.mark.parametrize("limit", [10_000, 20])
def test_linked_table_needs_no_shuffle(spark, tmp_path, skewed, limit):
    name = f"linked_test_{limit}"
    C.write_linked(skewed, name, 6, str(tmp_path / name), limit)
    found = C.read_linked_pairs(spark, name, COLUMNS)
    assert "Exchange" not in plan(found)
    same(found, P.fetch_pairs(P.build_pairs(skewed), skewed, COLUMNS))
    own = spark.table(name).where("NOT copied")
    assert own.count() == skewed.where("subject_id IS NOT NULL").count()
    chosen = C.read_linked_pairs(spark, name, COLUMNS, "val", ["within_stay"])
    index = P.build_pairs(skewed).where("fold = 18 AND pair_type = 'within_stay'")
    same(chosen, P.fetch_pairs(index, skewed, COLUMNS))


def test_chunks_spread_a_dominant_subject(spark, tmp_path, skewed):
    C.write_linked(skewed, "linked_spread", 4, str(tmp_path / "spread"), 20)
    sizes = [r["count"] for r in spark.table("linked_spread").where("subject_id = 1").groupBy("_chunk").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 100


def test_given_tables(spark):
    rows, index = V.recordings(spark, SF), V.pairs(spark, SF)
    same(C.fetch_pairs_together(index, rows, COLUMNS, limit=9), P.fetch_pairs(index, rows, COLUMNS))
    assert R.read_recordings(spark, V.shared_dir(spark, "recordings", SF)).count() == 1000
