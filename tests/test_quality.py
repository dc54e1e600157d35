import pytest
from pyspark.sql import functions as F

from stayline.functions import encode_labels
from stayline.operators import quality as Q
from stayline.operators.pairs import build_pairs

VOCAB = ["a", "b", "c"]


@pytest.fixture(scope="module")
def recs(spark):
    rows = [
        (0, 1, 0.0, 0, 0, ["a"]),
        (1, 1, 1.0, 1, 0, ["a", "b"]),
        (2, 1, 2.0, 0, 0, ["c"]),
        (3, 2, 0.0, 0, 18, []),
        (4, 2, 1.0, 0, 18, ["b", "b"]),
        (5, 3, 1.0, 0, 19, ["a", "c"]),
    ]
    schema = "row_idx long, subject_id int, ecg_time double, ecg_no_within_stay short, fold byte, icd_raw array<string>"
    df = spark.createDataFrame(rows, schema)
    wave = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (i + F.col("row_idx")).cast("float"))
    return df.withColumn("icd", encode_labels("icd_raw", VOCAB)).withColumn("waveform", wave)


@pytest.fixture(scope="module")
def pairs(recs):
    return build_pairs(recs)


def test_sound_tables_have_no_findings(recs, pairs):
    assert all(r.ok for r in Q.check_counts(recs, pairs, recs, {"pairs": 3}).collect())
    assert Q.check_schema(recs, recs.columns, {"icd": 3, "waveform": 4}).count() == 0
    assert Q.compare_tables(recs, recs, "row_idx", ["waveform", "icd"]).count() == 0
    assert Q.check_reencode(recs, VOCAB).count() == 0
    assert Q.stray_codes(recs, VOCAB).count() == 0
    assert Q.check_pair_rules(pairs, recs).count() == 0
    assert Q.check_stay_agreement(pairs, recs).where("mismatch").count() == 0
    assert Q.skipped_stays(pairs, recs).count() == 0


def test_counts(recs, pairs):
    got = Q.check_counts(recs, pairs.where("false"), expected={"recordings": 7}).collect()
    assert [(r.table, r.rows, r.expected, r.ok) for r in got] == [
        ("recordings", 6, 7, False),
        ("pairs", 0, None, False),
    ]


def test_wrong_label_bit(recs):
    bit = F.transform("icd", lambda v, i: F.when(i == 0, 1 - v).otherwise(v).cast("tinyint"))
    bad = recs.withColumn("icd", F.when(F.col("row_idx") == 4, bit).otherwise(F.col("icd")))
    assert [r.row_idx for r in Q.check_reencode(bad, VOCAB).collect()] == [4]


def test_short_array_and_missing_column(recs):
    short = F.when(F.col("row_idx") == 2, F.slice("waveform", 1, 3)).otherwise(F.col("waveform"))
    bad = recs.withColumn("waveform", short).drop("fold")
    got = Q.check_schema(bad, recs.columns, {"icd": 3, "waveform": 4, "fold": 1}).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        map(str, [("missing column", "fold", None, None), ("array length", "waveform", 3, 1)])
    )


def test_changed_sample(recs):
    wave = F.when(F.col("row_idx") == 3, F.reverse("waveform")).otherwise(F.col("waveform"))
    bad = recs.withColumn("waveform", wave).where("row_idx <> 5")
    got = {r.row_idx: r.difference for r in Q.compare_tables(recs, bad, "row_idx", ["icd", "waveform"]).collect()}
    assert got == {3: "waveform", 5: "only_a"}
    back = Q.compare_tables(bad, recs, "row_idx", ["icd"]).collect()
    assert [(r.row_idx, r.difference) for r in back] == [(5, "only_b")]
    assert Q.compare_tables(recs, bad, "row_idx", ["waveform"], n=6).count() == 2
    assert Q.compare_tables(recs, bad, "row_idx", ["waveform"], n=1).count() <= 1


def test_stray_codes(spark):
    rows = [(["a", "x"],), (["x"],), (None,), ([],), ([None],)]
    df = spark.createDataFrame(rows, "icd_raw array<string>")
    got = {(r.finding, r.code): r["rows"] for r in Q.stray_codes(df, VOCAB).collect()}
    assert got == {("stray code", "x"): 2, ("null list", None): 1, ("stray code", None): 1}


def test_pair_rules(spark, recs):
    rows = [
        (0, 1, "cross_stay"),
        (1, 2, "within_stay"),
        (2, 4, "cross_stay"),
        (4, 99, "cross_stay"),
        (0, 1, "within_stay"),
    ]
    bad = spark.createDataFrame(rows, "idx_t long, idx_t1 long, pair_type string")
    got = {(r.idx_t, r.idx_t1): r.broken_rule for r in Q.check_pair_rules(bad, recs).collect()}
    assert got == {
        (0, 1): "number rises",
        (1, 2): "number does not rise",
        (2, 4): "subject changes",
        (4, 99): "missing recording",
    }


def test_reset_that_is_not_to_zero(spark):
    rows = [(0, 1, 0.0, 0, 0), (1, 1, 1.0, 2, 0), (2, 1, 2.0, 1, 0)]
    recs = spark.createDataFrame(
        rows, "row_idx long, subject_id int, ecg_time double, ecg_no_within_stay short, fold byte"
    )
    got = Q.check_stay_agreement(build_pairs(recs), recs).where("mismatch").collect()
    assert [(r.idx_t, r.idx_t1) for r in got] == [(1, 2)]


def test_values(spark):
    rows = [([0, 1, -1], [0.5, float("nan")]), ([2, 0, None], [None, 0.1]), ([1], [0.2])]
    df = spark.createDataFrame(rows, "a_t array<int>, p array<double>")
    got = {r.column: r.bad_values for r in Q.check_values(df, "a_t", ["p"]).collect()}
    assert got == {"a_t": 2, "p": 2}


def test_split_sizes_and_profile(recs):
    got = {r.split: (r.monitoring, r.triage) for r in Q.check_split_sizes(recs).collect()}
    assert got == {"train": (3, 2), "val": (2, 2), "test": (1, 1)}
    rows = {r.column: r for r in Q.profile_columns(recs).collect()}
    assert rows["icd_raw"].min_length == 0 and rows["icd_raw"].max_length == 2
    assert rows["waveform"].type == "array<float>" and rows["fold"].non_null == 6
    assert rows["fold"].min_length is None
