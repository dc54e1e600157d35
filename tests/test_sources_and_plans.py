"""Round trips of the stored tables, and the plans that a large run depends on."""

import json

import pytest
from pyspark.sql import functions as F

from stayline import schema as S
from stayline import sources as R
from stayline.operators import assemble as A
from stayline.operators import pairs as P
from stayline.operators import select as D
from stayline.plans import views as V

SF = "/root/testdata/sf0.001"


def plan(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    return V.shared_dir(spark, "recordings", SF), V.recordings(spark, SF)


def test_metadata_keeps_file_order(spark, tmp_path):
    path = str(tmp_path / "meta")
    rows = spark.range(5000).selectExpr(
        "id % 7 other", "id study_id", "id % 9 subject_id", "id % 3 ecg_no_within_stay", "id % 20 fold", "4999 - id h5_index"
    )
    rows.repartitionByRange(3, "study_id").sortWithinPartitions("study_id").write.csv(path, header=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = R.read_metadata(spark, path)
        assert df.rdd.getNumPartitions() > 5
        got = df.orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.row_idx, r.study_id, r.h5_index) for r in got] == [(i, i, 4999 - i) for i in range(5000)]
    assert df.schema["fold"].dataType.simpleString() == "tinyint"


def test_metadata_needs_its_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text("study_id,fold\n1,2\n")
    with pytest.raises(ValueError):
        R.read_metadata(spark, str(tmp_path / "m.csv"))


def test_metadata_single_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "subject_id,study_id,fold,ecg_no_within_stay,h5_index\n5,1,2,0,9\n6,3,19,1,8\n"
    )
    got = R.read_metadata(spark, str(tmp_path / "m.csv")).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 0, 2, 9), (1, 3, 6, 1, 19, 8)]


def test_vocabulary_round_trip(spark, tmp_path):
    path = str(tmp_path / "v")
    assert R.save_vocabulary(spark, [b"I48", "E11"], path) == ["I48", "E11"]
    assert R.load_vocabulary(spark, path) == ["I48", "E11"]
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps(["x", "y", "x"], indent=1))
    with pytest.raises(ValueError):
        R.load_vocabulary(spark, str(plain))


def test_recordings_round_trip(spark, stored, tmp_path):
    path = str(tmp_path / "r")
    rows = stored[1]
    R.write_recordings(rows.where("fold < 12"), path)
    R.write_recordings(rows.where("fold >= 12"), path, "append", gather=False)
    again = R.read_recordings(spark, path)
    assert again.schema.simpleString() == S.RECORDINGS.simpleString()
    assert again.exceptAll(rows).isEmpty() and rows.exceptAll(again).isEmpty()
    with pytest.raises(ValueError):
        R.write_recordings(rows, path, "ignore")


def test_assembly_joins_the_frames_once(spark, stored):
    rows = stored[1]
    meta = rows.selectExpr("row_idx", "study_id", "subject_id", "ecg_no_within_stay", "fold", "row_idx AS h5_index")
    waves = rows.selectExpr("row_idx AS src_index", "ecg_time", "array(waveform) AS frames")
    labels = rows.selectExpr("row_idx AS src_index", "icd AS labels")
    built = A.assemble_recordings(meta, waves, labels, V.VOCABULARY)
    want = rows.withColumn("icd_raw", F.array_intersect("icd_raw", F.array(*[F.lit(c) for c in V.VOCABULARY])))
    cols = ["row_idx", "icd", "waveform", "ecg_time", "fold"]
    assert built.count() == rows.count()
    assert built.select(cols).exceptAll(want.select(cols)).isEmpty()


def test_scan_reads_only_what_is_asked_for(spark, stored):
    df = R.read_recordings(spark, stored[0], ["row_idx", "subject_id"], "fold = 19 AND ecg_no_within_stay = 0")
    text = plan(df)
    assert "PartitionFilters: [isnotnull(fold" in text and "EqualTo(ecg_no_within_stay,0)" in text
    assert "waveform" not in text and "icd" not in text


def test_pairing_is_one_shuffle_of_narrow_columns(spark, stored):
    text = plan(P.build_pairs(stored[1]))
    assert text.count("Exchange") == 1 and "hashpartitioning(subject_id" in text
    assert "waveform" not in text and "icd" not in text


def shuffled_rows_of(spark, df, column):
    """Rows that pass through shuffles of the given column, as the finished plan counted them."""
    total, seen = 0, set()
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
        for hop in ("executedPlan", "plan"):
            if node.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "ResultQueryStage", "BroadcastQueryStage"):
                try:
                    stack.append(getattr(node, hop)())
                except Exception:
                    continue
        if node.nodeName() == "Exchange" and node.id() not in seen and column in node.output().toString():
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
    return total


def test_only_paired_recordings_are_shuffled(spark, stored, tmp_path):
    path = str(tmp_path / "chosen")
    V.pairs(spark, SF).where("fold = 19 AND pair_type = 'cross_stay'").write.parquet(path)
    chosen = spark.read.parquet(path)
    found = P.fetch_pairs(chosen, stored[1], ["waveform"])
    rows = found.collect()
    assert len(rows) == 25
    assert shuffled_rows_of(spark, found, "waveform") <= 4 * len(rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(P.fetch_pairs(chosen, stored[1], ["waveform"]).collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_global_order_has_no_single_task_and_moves_no_cells(spark, stored):
    rows = stored[1].select("study_id", "subject_id", "ecg_time", "waveform")
    for df in (A.with_row_index(rows, ["subject_id", "ecg_time", "study_id"]), D.assign_batches(stored[1], 256, shuffle=True, drop_last=False)):
        text = plan(df)
        assert "SinglePartition" not in text
        assert not any("waveform" in line for line in text.splitlines() if "rangepartitioning" in line)


def test_splitting_and_sampling_do_not_shuffle(spark, stored):
    for df in (
        D.subject_fraction(D.split(stored[1], "train"), 0.3),
        D.sample_rows(stored[1], 50, seed=1),
    ):
        assert "Exchange" not in plan(df)


def test_bucketed_recordings_are_not_shuffled(spark, stored, tmp_path):
    pairs = V.pairs(spark, SF)
    for threshold in ("10485760", "-1"):
        name = f"bucketed_{threshold.strip('-')}"
        R.write_bucketed(stored[1], name, "row_idx", 8, str(tmp_path / name))
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            text = plan(P.fetch_pairs(pairs, spark.table(name), ["waveform"]))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning(row_idx" in line]
        assert not any("waveform" in line for line in exchanges)
    sound = P.fetch_pairs(pairs, spark.table("bucketed_1"), ["icd"]).count()
    assert sound == pairs.count()
