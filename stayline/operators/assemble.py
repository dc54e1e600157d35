"""Building the recordings table from its inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.arrays import flatten_frames
from ..functions.labels import decode_labels, encode_labels
from ..schema import PAIRS, RECORDINGS, conform
from ..sources import tables
from . import quality
from .ordered import positions_joined
from .pairs import build_pairs

ARRAYS = [f.name for f in RECORDINGS if isinstance(f.dataType, T.ArrayType)]
DIGESTED = T.StructType([T.StructField(f.name, quality.DIGEST if f.name in ARRAYS else f.dataType) for f in RECORDINGS])


def assemble_recordings(
    meta: DataFrame, waves: DataFrame, labels: DataFrame, vocab: Sequence[str], src: str = "h5_index"
) -> DataFrame:
    """Join metadata to its signal and label arrays on the source index and type the result.

    ``waves`` is (src_index, ecg_time, frames), ``labels`` is (src_index, labels).
    The narrow tables are joined first, so the signals take part in one join only, flat and typed as they are stored.
    """
    arrays = {"icd_raw": decode_labels("labels", vocab), "icd": F.col("labels")}
    return conform(_meet(meta, _stored_signals(waves), labels, src).withColumns(arrays), RECORDINGS)


def _digested_recordings(
    meta: DataFrame, waves: DataFrame, labels: DataFrame, vocab: Sequence[str], src: str = "h5_index"
) -> DataFrame:
    """As `assemble_recordings`, with its digest in place of each array, made before anything moves."""
    signals = _stored_signals(waves).withColumn("waveform", quality.digest(F.col("waveform")))
    arrays = {"icd_raw": decode_labels("labels", vocab), "icd": F.col("labels")}
    vectors = labels.select(
        "src_index", *[quality.digest(c.cast(RECORDINGS[n].dataType)).alias(n) for n, c in arrays.items()]
    )
    return conform(_meet(meta, signals, vectors, src), DIGESTED)


def _stored_signals(waves: DataFrame) -> DataFrame:
    flat = flatten_frames("frames").cast(RECORDINGS["waveform"].dataType)
    return waves.select("src_index", "ecg_time", flat.alias("waveform"))


def _meet(meta: DataFrame, signals: DataFrame, labels: DataFrame, src: str) -> DataFrame:
    narrow = meta.withColumnRenamed(src, "src_index").join(labels, "src_index")
    return narrow.join(signals, "src_index")


def with_row_index(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add ``row_idx``, the dense 0-based position in ``order_by``, which must order all rows."""
    return positions_joined(df, order_by, "row_idx")


def build_tables(
    metadata: DataFrame | None,
    waves: DataFrame | None,
    labels: DataFrame | None,
    vocab: Sequence[str],
    folder: str,
    pairs_only: bool = False,
) -> DataFrame:
    """The whole build: recordings, vocabulary, pair index; returns (table, kind, rows) of what is stored.

    Writes ``recordings``, ``pairs`` and ``vocabulary`` below ``folder``. With ``pairs_only`` the stored
    recordings stay as they are and only the pair index is made anew.
    """
    spark = SparkSession.active()
    recordings = f"{folder}/recordings"
    if not pairs_only:
        rows = assemble_recordings(metadata, waves, labels, vocab)
        tables.write_recordings(rows, recordings)
        tables.save_vocabulary(spark, vocab, f"{folder}/vocabulary")
    stored = tables.read_recordings(spark, recordings, ["row_idx", "subject_id", "ecg_time", "ecg_no_within_stay", "fold"])
    tables.write_pairs(build_pairs(stored), f"{folder}/pairs")
    pairs = spark.read.schema(PAIRS).parquet(f"{folder}/pairs")
    count = F.count(F.lit(1)).alias("rows")
    kinds = pairs.groupBy(F.col("pair_type").alias("kind")).agg(count).select(F.lit("pairs").alias("table"), "kind", "rows")
    splits = quality.check_split_sizes(stored).select(F.lit("recordings").alias("table"), F.col("split").alias("kind"), F.col("monitoring").alias("rows"))
    return splits.unionByName(kinds)


def verify_build(
    folder: str, metadata: DataFrame, waves: DataFrame, labels: DataFrame, vocab: Sequence[str], sample: int | None = None, seed: int = 0
) -> DataFrame:
    """What is wrong with a build: (check, finding, rows), without rows where nothing is.

    Row counts of both tables (``counts``), missing columns and array lengths (``schema``), recordings that
    differ from their inputs in any cell (``cells``; with ``sample`` that many, drawn by a hash of the id),
    label vectors that their codes do not give (``labels``) and pairs that break a rule (``pairs``).
    Arrays stay where they are, in the stored table and in the inputs; their digests move, and move once.
    """
    spark = SparkSession.active()
    stored = tables.read_recordings(spark, f"{folder}/recordings")
    pairs = spark.read.schema(PAIRS).parquet(f"{folder}/pairs")
    wanted = _digested_recordings(metadata, waves, labels, vocab)
    cells = ["subject_id", "ecg_time", "ecg_no_within_stay", "fold", "icd_raw", "icd", "waveform"]
    digested = stored.withColumns({c: quality.digest(F.col(c)) for c in ARRAYS})
    counts = quality.check_counts(stored, pairs, metadata).where("NOT ok")
    schema = quality.check_schema(stored, RECORDINGS.fieldNames(), {"icd": len(vocab)})
    differing = quality.compare_narrow_tables(digested, wanted, "row_idx", cells, sample, seed)
    wrong = quality.check_reencode(stored, vocab)
    broken = quality.check_pair_rules(pairs, stored)
    rows = F.count(F.lit(1)).alias("rows")
    parts = [
        counts.select(F.lit("counts").alias("check"), F.col("table").alias("finding"), "rows"),
        schema.select(F.lit("schema").alias("check"), F.concat_ws(" ", "finding", "column", "length").alias("finding"), "rows"),
        differing.groupBy(F.col("difference").alias("finding")).agg(rows).select(F.lit("cells").alias("check"), "finding", "rows"),
        wrong.agg(rows).where("rows > 0").select(F.lit("labels").alias("check"), F.lit("vector").alias("finding"), "rows"),
        broken.groupBy(F.col("broken_rule").alias("finding")).agg(rows).select(F.lit("pairs").alias("check"), "finding", "rows"),
    ]
    return reduce(DataFrame.unionByName, parts)


def add_label_column(df: DataFrame, name: str, vocab: Sequence[str]) -> DataFrame:
    """Add a label vector derived from ``icd_raw`` under another vocabulary."""
    return df.withColumn(name, encode_labels("icd_raw", vocab))


def explode_labels(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Vector to one row per class: (id, class_idx, y)."""
    return df.select(id_col, F.posexplode(vec).alias("class_idx", "y"))
