"""Batches that can be written again, look-up that reads what it needs, comparison by ranges, and the check of a build."""

import random

import pytest
from pyspark.sql import functions as F

from stayline.functions import reshape_frames
from stayline.operators import assemble as A, quality as Q
from stayline.plans import views as V
from stayline.sources import tables as R

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["row_idx"] for r in df.select("row_idx").collect())


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    rows, path = V.recordings(spark, SF), str(tmp_path / "batches")
    first, second = rows.where("row_idx < 300"), rows.where("row_idx >= 300")
    R.append_batch(first, path, "a")
    R.append_batch(second, path, "b-1")
    R.append_batch(first, path, "a")
    assert ids(R.read_batches(spark, path)) == ids(rows)
    R.append_batch(first.where("fold > 9"), path, "a")
    want = rows.where("row_idx >= 300 OR fold > 9")
    got = R.read_batches(spark, path)
    assert ids(got) == ids(want) and got.schema == rows.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_broken_write_is_not_read(spark, tmp_path):
    rows, path = V.recordings(spark, SF), str(tmp_path / "batches")
    assert R.read_batches(spark, path).count() == 0
    R.append_batch(rows.where("row_idx < 500"), path, "a")
    R.append_batch(rows.where("row_idx >= 500"), path, "b")
    (tmp_path / "batches" / "batch=b" / "_SUCCESS").unlink()
    assert R.committed_batches(spark, path) == ["a"]
    assert ids(R.read_batches(spark, path)) == ids(rows.where("row_idx < 500"))
    R.append_batch(rows.where("row_idx >= 500"), path, "b")
    assert ids(R.read_batches(spark, path)) == ids(rows)


def test_batches_are_pruned(spark, tmp_path):
    path = str(tmp_path / "batches")
    R.append_batch(V.recordings(spark, SF), path, "a")
    df = R.read_batches(spark, path, ["row_idx"], "fold = 19")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in text and "waveform" not in text
    assert ids(df) == ids(V.recordings(spark, SF).where("fold = 19"))


def test_batch_names(spark, tmp_path):
    for name in ("", "a/b", "..", "x=1"):
        with pytest.raises(ValueError):
            R.append_batch(V.recordings(spark, SF), str(tmp_path), name)


def rows_read(df):
    """Rows that the scans of an executed query gave."""
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            stack.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return total


def test_look_up_reads_in_proportion_to_the_ids(spark, tmp_path):
    path = str(tmp_path / "clustered")
    rows = spark.range(100_000).selectExpr("id AS row_idx", "id * 3 AS v", "array(id, id) AS cells")
    R.write_clustered(rows, path, 1000)
    for n in (1, 5, 20):
        wanted = [random.Random(n).randrange(100_000) for _ in range(n)]
        asked = spark.createDataFrame(list(enumerate([*wanted, wanted[0], None, 10**7])), "pos long, row_idx long")
        found = R.take_stored_rows(spark, path, asked)
        got = [tuple(r) for r in found.select("pos", "row_idx", "v", "cells").collect()]
        assert got == [(i, x, 3 * x, [x, x]) for i, x in enumerate([*wanted, wanted[0]])]
        executed = R.take_stored_rows(spark, path, asked)
        executed.collect()
        assert rows_read(executed) <= 1000 * n
    assert R.take_stored_rows(spark, path, asked.where("false")).count() == 0
    assert sorted(R.take_stored_rows(spark, path, asked, ["v"]).columns) == ["pos", "row_idx", "v"]


def changed(df, share, seed):
    hit = F.pmod(F.xxhash64("row_idx", F.lit(seed)), F.lit(1000)) < share
    return df.withColumn("v", F.when(hit, F.lit(None)).otherwise(F.col("v"))).where(~((F.col("row_idx") % 997 == 5) & F.lit(share > 0)))


@pytest.mark.parametrize("ranges, rows", [(16, 50), (4, 1), (1024, 100_000)])
@pytest.mark.parametrize("share", [0, 1, 300])
def test_ranges_find_what_the_whole_comparison_finds(spark, ranges, rows, share):
    a = spark.range(3000).selectExpr("id * 7 - 900 AS row_idx", "id % 5 AS v", "array(id, null) AS w")
    b = changed(a, share, 1).unionAll(spark.createDataFrame([(10**6, 1, [1])], a.schema))
    for x, y in ((a, b), (b, a), (a, a), (a.where("false"), b), (a.where("false"), a.where("false"))):
        got = Q.compare_by_ranges(x, y, "row_idx", ["v", "w"], ranges, rows).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, Q.compare_tables(x, y, "row_idx", ["v", "w"]).collect()))


def test_null_keys_are_findings(spark):
    a = spark.createDataFrame([(1, 1), (None, 2)], "row_idx long, v int")
    assert [tuple(r) for r in Q.compare_by_ranges(a, a.where("row_idx = 1"), "row_idx", ["v"]).collect()] == [(None, "only_a")]


def build(spark, folder):
    rows = V.recordings(spark, SF)
    meta = rows.select("row_idx", "study_id", "subject_id", "ecg_no_within_stay", "fold", F.col("row_idx").alias("h5_index"))
    waves = rows.select(F.col("row_idx").alias("src_index"), "ecg_time", reshape_frames("waveform", V.LEADS).alias("frames"))
    labels = rows.select(F.col("row_idx").alias("src_index"), F.col("icd").alias("labels"))
    A.build_tables(meta, waves, labels, V.VOCABULARY, folder)
    return meta, waves, labels


def test_a_sound_build_has_no_findings(spark, tmp_path):
    inputs = build(spark, str(tmp_path))
    for sample in (None, 20):
        assert A.verify_build(str(tmp_path), *inputs, V.VOCABULARY, sample).collect() == []


def test_a_damaged_build_is_found_out(spark, tmp_path):
    meta, waves, labels = build(spark, str(tmp_path))
    moved = labels.withColumn("labels", F.when(F.col("src_index") == 7, F.reverse("labels")).otherwise(F.col("labels")))
    pairs = spark.read.parquet(f"{tmp_path}/pairs").where("idx_t % 2 = 0").collect()
    R.write_pairs(spark.createDataFrame(pairs).withColumn("pair_type", F.lit("within_stay")), f"{tmp_path}/pairs")
    found = {(r["check"], r["finding"]): r["rows"] for r in A.verify_build(str(tmp_path), meta.where("row_idx <> 9"), waves, moved, V.VOCABULARY).collect()}
    assert found[("counts", "recordings")] == 1000 and found[("cells", "only_a")] == 1
    assert sum(n for (check, _), n in found.items() if check == "cells") == 2
    assert found[("pairs", "number does not rise")] > 100


def test_every_kind_of_damage_is_found_as_by_the_whole_comparison(spark, tmp_path):
    meta, waves, labels = build(spark, str(tmp_path))
    at, index = F.col("row_idx"), F.col("src_index")

    def damaged(df, column, **by_id):
        value, key = F.col(column), index if "src_index" in df.columns else at
        for i, change in by_id.items():
            value = F.when(key == int(i[1:]), change).otherwise(value)
        return df.withColumn(column, value)

    frames, vector = F.col("frames"), F.col("labels")
    turned = damaged(waves, "frames", _1=F.reverse(frames), _2=F.lit(None), _3=F.slice(frames, 1, 15), _4=F.slice(frames, 1, 0), _5=F.transform(frames, F.reverse))
    turned = damaged(turned, "ecg_time", _6=F.lit(None), _7=F.lit(0.0)).where(index != 8)
    moved = damaged(labels, "labels", _9=F.reverse(vector), _10=F.lit(None), _11=F.slice(vector, 1, 7), _12=F.transform(vector, lambda y: (y * 2).cast("tinyint")))
    other = damaged(damaged(meta, "subject_id", _13=F.lit(-1)), "ecg_no_within_stay", _14=F.lit(None).cast("smallint"), _1=F.lit(99).cast("smallint"))
    other = other.where(at != 15).unionByName(other.where(at == 16).withColumn("row_idx", F.lit(10**6).cast("long")))
    stored = R.read_recordings(spark, str(tmp_path / "recordings"))
    cells = ["subject_id", "ecg_time", "ecg_no_within_stay", "fold", "icd_raw", "icd", "waveform"]
    for sample in (None, 400):
        wanted = Q.compare_tables(stored, A.assemble_recordings(other, turned, moved, V.VOCABULARY), "row_idx", cells, sample)
        counted = {r["difference"]: r["count"] for r in wanted.groupBy("difference").count().collect()}
        found = A.verify_build(str(tmp_path), other, turned, moved, V.VOCABULARY, sample).where("check = 'cells'").collect()
        assert {r["finding"]: r["rows"] for r in found} == counted
        assert sample or {"only_a", "only_b", "subject_id", "ecg_time", "ecg_no_within_stay", "icd_raw", "icd", "waveform"} == counted.keys()
