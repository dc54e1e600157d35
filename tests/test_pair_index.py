"""The stored pair index: updates equal a rebuild, and untouched buckets keep their files."""

import pytest
from pyspark.sql import functions as F

from stayline.operators import pair_index as I
from stayline.operators.pairs import build_pairs
from stayline.plans import views as V

SF = "/root/testdata/sf0.001"


def pairs_of(df):
    return sorted(map(tuple, df.select("idx_t", "idx_t1", "subject_id", "fold", "pair_type").collect()))


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_updates_equal_a_rebuild(spark, tmp_path, limit):
    """Late rows stand before, between and after a subject's others, so that pairs and folds change."""
    rows, path = V.recordings(spark, SF), str(tmp_path)
    late = "subject_id % 5 = 1 AND row_idx % 2 = 0"
    more = "subject_id % 9 = 2 AND row_idx % 4 = 1"
    now = rows.where(f"NOT ({late}) AND NOT ({more})")
    I.update_pair_index(spark, path, now, buckets=32, limit=limit)
    assert pairs_of(I.read_pair_index(spark, path)) == pairs_of(build_pairs(now))
    for new in (late, more):
        now = now.union(rows.where(new if new == late else f"{new} AND NOT ({late})"))
        I.update_pair_index(spark, path, now, rows.where(new), limit=limit)
        assert pairs_of(I.read_pair_index(spark, path)) == pairs_of(build_pairs(now))
    assert pairs_of(I.read_pair_index(spark, path)) == pairs_of(build_pairs(rows))
    assert I.drop_superseded(spark, path) > 0 and I.drop_superseded(spark, path) == 0
    assert pairs_of(I.read_pair_index(spark, path)) == pairs_of(build_pairs(rows))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    rows, path = V.recordings(spark, SF), str(tmp_path)
    subject = rows.groupBy("subject_id").count().orderBy(F.desc("count"), "subject_id").first()["subject_id"]
    new = rows.where(F.col("subject_id") == subject).orderBy("row_idx").limit(1)
    I.update_pair_index(spark, path, rows.join(new.select("row_idx"), "row_idx", "left_anti"), buckets=16)
    before, folders = files(tmp_path), I.bucket_folders(spark, path)[0]
    touched = I.update_pair_index(spark, path, rows, new)
    after = I.bucket_folders(spark, path)[0]
    assert len(touched) == 1 and {b for b in after if after[b] != folders.get(b)} == touched
    assert before.items() <= files(tmp_path).items()
    read = I.read_pair_index(spark, path).inputFiles()
    assert sum("version=0" in f for f in read) and {"version=1" in f for f in read} == {True, False}


def test_a_broken_update_is_not_read_and_is_done_again(spark, tmp_path):
    rows, path = V.recordings(spark, SF), str(tmp_path)
    I.update_pair_index(spark, path, rows.where("row_idx % 3 > 0"), buckets=8)
    old = pairs_of(I.read_pair_index(spark, path))
    I.update_pair_index(spark, path, rows, rows.where("row_idx % 3 = 0"))
    (tmp_path / "version=1" / "_SUCCESS").unlink()
    assert pairs_of(I.read_pair_index(spark, path)) == old
    for _ in range(2):
        I.update_pair_index(spark, path, rows, rows.where("row_idx % 3 = 0"))
        assert pairs_of(I.read_pair_index(spark, path)) == pairs_of(build_pairs(rows))
    assert I.committed_versions(spark, path) == [0, 1, 2]


def test_empty_and_null(spark, tmp_path):
    rows, path = V.recordings(spark, SF), str(tmp_path)
    assert I.read_pair_index(spark, path).count() == 0
    I.update_pair_index(spark, path, rows.limit(0))
    assert I.read_pair_index(spark, path).count() == 0
    assert I.update_pair_index(spark, path, rows, rows.limit(0)) == set()
    nobody = rows.limit(3).withColumn("subject_id", F.lit(None).cast(rows.schema["subject_id"].dataType))
    assert I.update_pair_index(spark, path, rows.union(nobody), nobody) == set()
    I.update_pair_index(spark, path, rows.union(nobody), rows.union(nobody))
    assert pairs_of(I.read_pair_index(spark, path)) == pairs_of(build_pairs(rows))
