"""The stored tables of this library, derived from the given tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import encode_labels, transition_vector
from ..operators.colocated import fetch_pairs_together, write_linked
from ..operators.lineage import shared_folder
from ..operators.ordered import row_positions
from ..operators.pairs import build_pairs, pair_labels
from ..operators.select import split
from ..schema import PAIRS
from ..sources import read_recordings, write_pairs, write_recordings

# Fixed values. The codes error and k4 occur in the data and are left out on purpose.
VOCABULARY = ["click", "purchase", "signup", "view", "k0", "k1", "k2", "k3"]
CLASSES = len(VOCABULARY)
STEPS, LEADS = 16, 4
LINKED_BUCKETS = 16

_written: set[str] = set()


def shared_dir(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A folder for tables that queries write: below the folder all executors share."""
    tag = zlib.crc32(sf_dir.encode())
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/stayline/{app}/{name}-{tag:08x}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch_seconds(ts_type: T.DataType):
    if isinstance(ts_type, T.TimestampNTZType):
        since = "(ts - timestamp_ntz'1970-01-01 00:00:00')"
        return F.expr(f"cast(cast({since} as interval second) as decimal(20, 6))").cast("double")
    return F.unix_micros("ts") / 1e6


def derive_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings from events: a user is a subject and one calendar day is a stay."""
    events = table(spark, sf_dir, "events")
    user = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    rows = events.select(
        F.col("event_id").alias("row_idx"),
        F.col("event_id").alias("study_id"),
        user.alias("subject_id"),
        _epoch_seconds(events.schema["ts"].dataType).alias("ecg_time"),
        F.col("ts").cast("date").alias("day"),
        (19 - user % 20).cast("tinyint").alias("fold"),
        F.array("event_type", F.concat(F.lit("k"), k.cast("string"))).alias("icd_raw"),
    )
    rows = row_positions(rows, ["subject_id", "day"], ["ecg_time", "row_idx"], "ecg_no_within_stay")
    signals = table(spark, sf_dir, "embeddings")
    n = signals.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        rows.withColumn("icd", encode_labels("icd_raw", VOCABULARY))
        .withColumn("vec_id", F.col("row_idx") % n)
        .join(signals.select("vec_id", F.col("embedding").alias("waveform")), "vec_id")
        .drop("vec_id", "day")
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored recordings table, written on first use."""
    path = shared_dir(spark, "recordings", sf_dir)
    if path not in _written:
        write_recordings(derive_recordings(spark, sf_dir), path)
        _written.add(path)
    return read_recordings(spark, path)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pair index, written on first use."""
    path = shared_dir(spark, "pairs", sf_dir)
    if path not in _written:
        write_pairs(build_pairs(recordings(spark, sf_dir)), path)
        _written.add(path)
    return spark.read.schema(PAIRS).parquet(path)


def linked_table(spark: SparkSession, sf_dir: str) -> str:
    """The name of the recordings table that is bucketed by subject with links, written on first use."""
    path = shared_dir(spark, "linked", sf_dir)
    name = f"linked_{zlib.crc32(path.encode()):08x}"
    if path not in _written:
        write_linked(recordings(spark, sf_dir), name, LINKED_BUCKETS, path)
        _written.add(path)
    return name


def chosen_test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-stay pairs of the test split."""
    return split(pairs(spark, sf_dir), "test").where(F.col("pair_type") == "cross_stay")


def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-stay pairs of the test split with y_t, y_t1 and a_t."""
    return pair_labels(chosen_test_pairs(spark, sf_dir), recordings(spark, sf_dir))


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with y_t, y_t1 and a_t."""
    return pair_labels(pairs(spark, sf_dir), recordings(spark, sf_dir))


def pseudo_score(id_col: str, id_factor: int, class_col, class_factor: int):
    """A fixed score in [0, 1) of a row and class, with ties."""
    return ((F.col(id_col) * id_factor + class_col * class_factor) % 1000) / 1000.0


def predictions(spark: SparkSession, sf_dir: str, of=test_pairs) -> DataFrame:
    """Pairs, by default those of the test, with probability vectors ``onset`` and ``resolution``."""
    classes = F.sequence(F.lit(0), F.lit(CLASSES - 1))
    return of(spark, sf_dir).withColumns(
        {
            "onset": F.transform(classes, lambda c: pseudo_score("idx_t", 7919, c, 101)),
            "resolution": F.transform(classes, lambda c: pseudo_score("idx_t", 104729, c, 211)),
        }
    )


def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, class_idx, score, target) of all recordings and classes."""
    return (
        recordings(spark, sf_dir)
        .select("row_idx", F.posexplode("icd").alias("class_idx", "target"))
        .withColumn("score", pseudo_score("row_idx", 7919, F.col("class_idx"), 101))
    )


def embedding_pairs(spark: SparkSession, sf_dir: str, chosen: DataFrame | None = None) -> DataFrame:
    """Pairs, all or those ``chosen``, with the embeddings h_t and h_t1 and the transition a_t of their ends.

    The embeddings move once, to their subject; choosing pairs here keeps those of other pairs where they are.
    """
    chosen = pairs(spark, sf_dir) if chosen is None else chosen
    ends = fetch_pairs_together(chosen, recordings(spark, sf_dir), ["waveform", "icd"])
    return ends.select(
        "idx_t",
        "fold",
        F.col("waveform_t").alias("h_t"),
        F.col("waveform_t1").alias("h_t1"),
        F.col("icd_t").alias("y_t"),
        transition_vector("icd_t", "icd_t1").alias("a_t"),
    )
