"""A stored pair index that follows appended recordings without a rebuild.

Pairs are stored by subject bucket. An update links only the subjects that got
recordings and writes their buckets under a new version; all other buckets keep
their files. A version counts once its write has been committed, so readers see
the index before or after an update, and an update that broke is done again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import PAIRS, conform
from .lineage import store
from .ordered import HOT_ROWS
from .pairs import build_pairs

BUCKETS = 256
#: A bucket's folder names the number of buckets too, so that no reader or update need be told.
FOLDER = re.compile(r"version=(\d+)/bucket_of_(\d+)=(\d+)$")


def bucket_of(buckets: int) -> Column:
    """The bucket of a subject, the same for every type its number is stored with."""
    return F.pmod(F.xxhash64(F.col("subject_id").cast("long")), F.lit(buckets))


def _found(spark: SparkSession, pattern: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath().toString() for f in found or []]


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose write has been committed, ascending."""
    return sorted(int(re.search(r"version=(\d+)/_SUCCESS$", f)[1]) for f in _found(spark, f"{path}/version=*/_SUCCESS"))


def bucket_folders(spark: SparkSession, path: str) -> tuple[dict[int, str], int | None]:
    """The folder that counts for each bucket, from the last committed version that has it, and the number of buckets."""
    committed = set(committed_versions(spark, path))
    last: dict[int, tuple[int, str]] = {}
    buckets = None
    for folder in _found(spark, f"{path}/version=*/bucket_of_*=*"):
        version, of, bucket = map(int, FOLDER.search(folder).groups())
        if version in committed:
            buckets = of
            last[bucket] = max(last.get(bucket, (-1, "")), (version, f"{path}/version={version}/bucket_of_{of}={bucket}"))
    return {bucket: folder for bucket, (_, folder) in last.items()}, buckets


def read_pair_index(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """Pairs of the index, of the buckets ``only`` if given. A path without an index has none."""
    folders = bucket_folders(spark, path)[0]
    chosen = [f for b, f in sorted(folders.items()) if only is None or b in only]
    return spark.read.schema(PAIRS).parquet(*chosen) if chosen else spark.createDataFrame([], PAIRS)


def update_pair_index(
    spark: SparkSession, path: str, recordings: DataFrame, new: DataFrame | None = None, buckets: int = BUCKETS, limit: int = HOT_ROWS
) -> set[int]:
    """Bring the index up to date with ``recordings``, of which ``new`` were appended; returns the buckets written.

    Without ``new``, or without an index, all subjects are linked. ``new`` needs only the subjects; repeated
    and null subjects, and rows that an earlier update has seen, do no harm. ``buckets`` holds for a first build;
    later updates keep its number. Recordings are only ever added: for changed or deleted ones, build again.
    """
    buckets = bucket_folders(spark, path)[1] or buckets
    versions = committed_versions(spark, path)
    part = f"bucket_of_{buckets}"
    if new is None or not versions:
        pairs = build_pairs(recordings, limit)
        touched = set(range(buckets))
    else:
        subjects = store(new.select("subject_id").where("subject_id IS NOT NULL").distinct(), "new-subjects")
        touched = {r["bucket"] for r in subjects.select(bucket_of(buckets).alias("bucket")).distinct().collect()}
        if not touched:
            return set()
        linked = build_pairs(recordings.join(subjects, "subject_id", "left_semi"), limit)
        others = read_pair_index(spark, path, touched).join(subjects, "subject_id", "left_anti")
        pairs = conform(linked, PAIRS).unionByName(conform(others, PAIRS))
    version = max(versions, default=-1) + 1
    rows = conform(pairs, PAIRS).withColumn(part, bucket_of(buckets))
    rows.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(f"{path}/version={version}")
    return touched


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Delete bucket folders that a later version has replaced, once nobody reads or updates the index; their number."""
    counted = set(bucket_folders(spark, path)[0].values())
    old = [f for f in _found(spark, f"{path}/version=*/bucket_of_*=*") if not any(f.endswith(c.removeprefix(path)) for c in counted)]
    for folder in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)
