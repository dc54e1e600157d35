"""Consecutive recordings of a subject, and hospital stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.labels import decode_labels, transition_vector
from ..schema import CROSS_STAY, WITHIN_STAY
from .ordered import HOT_ROWS, ascending, chunk_of, find_borders, running

TIME_ORDER = ["ecg_time", "row_idx"]


def build_pairs(recordings: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Link each recording of a subject to the next one in time.

    ``within_stay`` if the number in the stay rises, ``cross_stay`` otherwise;
    the fold is that of the subject's first recording. Reads five narrow columns.
    """
    rows = recordings.where(F.col("subject_id").isNotNull()).select(
        "subject_id", "ecg_time", "row_idx", F.col("ecg_no_within_stay").alias("seq"), "fold"
    )
    subject = ["subject_id"]
    borders = find_borders(rows, subject, TIME_ORDER, limit, ["row_idx", "seq", "fold"])
    if borders is None:
        cut = rows.withColumn("_chunk", F.lit(0))
    else:
        cut = rows.join(borders, subject, "left").withColumn("_chunk", chunk_of(TIME_ORDER))
    in_time = Window.partitionBy("subject_id", "_chunk").orderBy(*ascending(TIME_ORDER))
    linked = cut.select(
        "subject_id",
        "_chunk",
        "row_idx",
        "seq",
        F.lead(F.struct("row_idx", "seq")).over(in_time).alias("after"),
        F.first("fold").over(in_time).alias("fold"),
    )
    if borders is not None:
        # The last row of a chunk is followed by the border row that opens the next one.
        opening = F.get("_borders", F.col("_chunk"))
        linked = linked.join(borders, subject, "left").withColumns(
            {
                "after": F.coalesce("after", F.struct(opening["row_idx"], opening["seq"])),
                "fold": F.coalesce("_first.fold", "fold"),
            }
        )
    rises = F.col("seq") < F.col("after.seq")
    return linked.where(F.col("after.row_idx").isNotNull()).select(
        F.col("row_idx").alias("idx_t"),
        F.col("after.row_idx").alias("idx_t1"),
        "subject_id",
        "fold",
        F.when(rises, WITHIN_STAY).otherwise(CROSS_STAY).alias("pair_type"),
    )


def pair_type_counts(pairs: DataFrame) -> DataFrame:
    """Pairs per type."""
    return pairs.groupBy("pair_type").agg(F.count(F.lit(1)).alias("pairs"))


def assign_stays(recordings: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Add ``stay``: one more at each recording numbered 0, starting from -1."""
    opens = F.when(F.col("ecg_no_within_stay") == 0, 1).otherwise(0).cast("long")
    rows = recordings.where(F.col("subject_id").isNotNull())
    before = running(rows, ["subject_id"], TIME_ORDER, {"_opened": opens}, limit)
    return before.withColumn("stay", F.col("_opened") + opens - 1).drop("_opened")


def select_subjects(
    recordings: DataFrame,
    n: int = 1,
    min_stays: int = 3,
    max_stays: int = 5,
    min_per_stay: int = 2,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """The n subjects with most (stays, rows) whose stays are in range; ties by subject."""
    narrow = recordings.select("subject_id", "ecg_time", "row_idx", "ecg_no_within_stay")
    return (
        assign_stays(narrow, limit)
        .groupBy("subject_id", "stay")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("subject_id")
        .agg(
            F.count(F.lit(1)).alias("stays"),
            F.max("rows").alias("max_per_stay"),
            F.sum("rows").alias("rows"),
        )
        .where(F.col("stays").between(min_stays, max_stays) & (F.col("max_per_stay") >= min_per_stay))
        .orderBy(F.desc("stays"), F.desc("rows"), "subject_id")
        .limit(n)
    )


def subject_timeline(recordings: DataFrame, subject: int, limit: int = HOT_ROWS) -> DataFrame:
    """One subject's recordings in time order with stay and a running tag x1, x2, ..."""
    rows = recordings.where(F.col("subject_id") == subject)
    opens = F.when(F.col("ecg_no_within_stay") == 0, 1).otherwise(0).cast("long")
    steps = {"_pos": F.lit(1).cast("long"), "_opened": opens}
    return (
        running(rows, ["subject_id"], TIME_ORDER, steps, limit)
        .withColumn("stay", F.col("_opened") + opens - 1)
        .withColumn("tag", F.concat(F.lit("x"), (F.col("_pos") + 1).cast("string")))
        .orderBy("_pos")
        .drop("_pos", "_opened")
    )


def filter_pairs(pairs: DataFrame, split_name: str, pair_types: Sequence[str]) -> DataFrame:
    """Ids and subject of the pairs of one split and the given types."""
    from .select import split

    if not pair_types:
        raise ValueError("no pair types given")
    return (
        split(pairs, split_name)
        .where(F.col("pair_type").isin(list(pair_types)))
        .select("idx_t", "idx_t1", "subject_id")
    )


def fetch_pairs(
    pairs: DataFrame, recordings: DataFrame, columns: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Bring ``columns`` of both ends to each pair, as ``<name>_t`` and ``<name>_t1``.

    Recordings outside the pairs are dropped by their ids first: stored pairs of a known small size are
    broadcast for it, and larger ones are met where the cells are shuffled by ``row_idx`` anyway. Both
    joins read that one shuffle; a table bucketed by ``row_idx`` needs none. What the first join found
    moves once more, to the later end of its pair.
    """
    members = pairs.select(F.explode(F.array("idx_t", "idx_t1")).alias("row_idx")).distinct()
    cells = recordings.select("row_idx", *columns).join(members, "row_idx", "left_semi")

    def end(suffix: str) -> DataFrame:
        return cells.select(
            F.col("row_idx").alias(f"idx_{suffix}"), *[F.col(c).alias(f"{c}_{suffix}") for c in columns]
        )

    return pairs.join(end("t"), "idx_t", how).join(end("t1"), "idx_t1", how)


def pair_labels(pairs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Pairs with label vectors ``y_t``, ``y_t1`` and the transition ``a_t``."""
    return (
        fetch_pairs(pairs, recordings, ["icd"])
        .withColumnsRenamed({"icd_t": "y_t", "icd_t1": "y_t1"})
        .withColumn("a_t", transition_vector("y_t", "y_t1"))
    )


def describe_pairs(pairs: DataFrame, recordings: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """Readable report: studies, times and codes at both ends, codes that came and went."""
    ends = fetch_pairs(pairs, recordings, ["study_id", "ecg_time", "icd_raw", "icd"])
    change = transition_vector("icd_t", "icd_t1")
    onset = F.transform(change, lambda a: (a == 1).cast("tinyint"))
    gone = F.transform(change, lambda a: (a == -1).cast("tinyint"))
    return ends.select(
        "idx_t",
        "idx_t1",
        "subject_id",
        "pair_type",
        "study_id_t",
        "study_id_t1",
        "ecg_time_t",
        "ecg_time_t1",
        F.col("icd_raw_t").alias("codes_t"),
        F.col("icd_raw_t1").alias("codes_t1"),
        decode_labels(onset, vocab).alias("onset_codes"),
        decode_labels(gone, vocab).alias("resolved_codes"),
    )
