"""Readers and writers of the stored tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..schema import METADATA, PAIRS, RECORDINGS, conform

CLUSTER_ROWS = 4_096  # rows of a folder of a clustered table
MOST_FOLDERS = 2_048  # of a clustered table; beyond that folders hold more rows
CLUSTER_MARK = "_div_"


def read_metadata(spark: SparkSession, path: str, schema: T.StructType = METADATA) -> DataFrame:
    """Header CSV of recording metadata, columns by name, with ``row_idx`` = place in the file.

    A row's place is the rows in earlier file blocks plus its place in its own
    block, so numbering takes one count per block and no sort of the rows.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    block = ["_path", "_start"]
    rows = raw.select(
        *[f.name for f in schema],
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    in_file_order = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*block)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .select(
            *block, "_first", F.coalesce(F.sum("_n").over(in_file_order), F.lit(0)).alias("_before")
        )
    )
    # One row per block of the scan: bounded by file bytes / spark.sql.files.maxPartitionBytes.
    return rows.join(F.broadcast(blocks), block).select(
        (F.col("_before") + F.col("_id") - F.col("_first")).alias("row_idx"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema],
    )


def read_recordings(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """Stored recordings; unread columns and folds ruled out by ``where`` are not touched."""
    df = spark.read.schema(RECORDINGS).parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*(columns or RECORDINGS.fieldNames()))


def read_array_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, key: str = "src_index"
) -> DataFrame:
    """Array cells keyed by source index."""
    df = spark.read.parquet(path)
    if key not in df.columns:
        raise ValueError(f"no column {key!r} in {path}")
    return df.select(key, *columns) if columns else df


def write_recordings(df: DataFrame, path: str, mode: str = "overwrite", gather: bool = True) -> None:
    """Write by fold; ``mode`` is ``overwrite`` for the first write and ``append`` for more.

    ``gather`` first brings a fold's rows together in evenly sized partitions,
    so that files are large; without it every task writes a file per fold.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode: {mode!r}")
    out = conform(df, RECORDINGS)
    if gather:
        out = out.hint("rebalance", "fold")
    out.write.mode(mode).partitionBy("fold").parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Add a chunk of recordings under a name of its own; writing the same chunk again replaces it.

    Each batch is a folder of its own that counts once its write has been committed, so a write that broke
    leaves nothing that `read_batches` would read, and is simply done again.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, - and _: {batch!r}")
    conform(df, RECORDINGS).write.mode("overwrite").partitionBy("fold").parquet(f"{path}/batch={batch}")


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """The names of the batches whose write has been committed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS"))
    return sorted(m.getPath().getParent().getName().removeprefix("batch=") for m in marks)


def read_batches(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | str | None = None
) -> DataFrame:
    """Recordings of all committed batches; unread columns and folds ruled out by ``where`` are not touched."""
    names = committed_batches(spark, path)
    if not names:
        return spark.createDataFrame([], RECORDINGS).select(*(columns or RECORDINGS.fieldNames()))
    schema = T.StructType([*RECORDINGS.fields, T.StructField("batch", T.StringType())])
    df = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/batch={n}" for n in names])
    if where is not None:
        df = df.where(where)
    return df.select(*(columns or RECORDINGS.fieldNames()))


def folder_rows(df: DataFrame, key: str, rows: int) -> int:
    """Positions of a folder: ``rows``, doubled until some MOST_FOLDERS folders, as far as a sketch can tell, are not empty."""
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    span = 0 if ends["low"] is None else ends["high"] - ends["low"] + 1
    widths = [rows]
    while span > widths[-1] * MOST_FOLDERS:
        widths.append(2 * widths[-1])
    if len(widths) == 1:
        return rows
    folders = df.agg(*[F.approx_count_distinct(F.floor(F.col(key) / w)).alias(f"w{w}") for w in widths]).first()
    return next((w for w in widths if folders[f"w{w}"] <= MOST_FOLDERS), widths[-1])


def write_clustered(df: DataFrame, path: str, rows: int = CLUSTER_ROWS, key: str = "row_idx") -> None:
    """Write a table in folders of ``rows`` consecutive positions each, sorted, for `take_stored_rows`.

    Large tables get larger folders, some MOST_FOLDERS in all: files cost time each, however small. The folders'
    column is named after the key and their size, so readers need not be told.
    """
    wide = folder_rows(df, key, rows)
    part = f"{key}{CLUSTER_MARK}{wide}"
    placed = df.withColumn(part, F.floor(F.col(key) / wide).cast("long"))
    placed.repartitionByRange(part).sortWithinPartitions(part, key).write.mode("overwrite").partitionBy(part).parquet(path)


def take_stored_rows(spark: SparkSession, path: str, ids: DataFrame, columns: Sequence[str] | None = None, key: str = "row_idx") -> DataFrame:
    """Rows of a clustered table by position: ``ids`` holds (pos, key), repeats allowed; ordered by pos.

    The folders that hold any of the ids are found first, and no other is read: what is read is in proportion
    to the ids. Their numbers come to the driver: some MOST_FOLDERS at most, as `write_clustered` makes no more.
    """
    df = spark.read.parquet(path)
    (part,) = [c for c in df.columns if c.startswith(f"{key}{CLUSTER_MARK}")]
    rows = int(part.removeprefix(f"{key}{CLUSTER_MARK}"))
    found = ids.where(F.col(key).isNotNull()).select(F.floor(F.col(key) / rows).cast("long").alias("part")).distinct()
    cells = df.where(F.col(part).isin([r["part"] for r in found.collect()]))
    cells = cells.select(key, *(columns or [c for c in df.columns if c not in (key, part)]))
    return ids.select("pos", key).join(cells, key).orderBy("pos")


def write_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, path: str, mode: str = "overwrite"
) -> None:
    """Write a table laid out by ``key``, so that later joins on it do not shuffle its wide cells."""
    (
        df.repartition(buckets, key)
        .write.mode(mode)
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Replace the pair index; the recordings stay as they are."""
    conform(pairs, PAIRS).write.mode("overwrite").parquet(path)


def save_vocabulary(spark: SparkSession, codes: Sequence[str | bytes], path: str) -> list[str]:
    """Write the code list as JSON; a code's place is its class index."""
    text = [c.decode() if isinstance(c, bytes) else str(c) for c in codes]
    spark.createDataFrame([(json.dumps(text),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)
    return text


def vocabulary_frame(spark: SparkSession, path: str) -> DataFrame:
    """(class_idx, code) of a stored vocabulary."""
    codes = F.from_json("value", "array<string>")
    return spark.read.text(path, wholetext=True).select(F.posexplode(codes).alias("class_idx", "code"))


def load_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """A stored vocabulary as a list: one entry per label class."""
    rows = vocabulary_frame(spark, path).orderBy("class_idx").collect()
    codes = [r["code"] for r in rows]
    if len(set(codes)) != len(codes):
        raise ValueError("the vocabulary holds a code twice")
    return codes
