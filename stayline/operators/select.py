"""Splits, row selection, sampling and batching. Draws are keyed hashes, so they repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import DRAW_BITS, draw
from .ordered import ascending, positions_joined, row_positions

# Folds of the splits.
TRAIN_LAST_FOLD, VAL_FOLD, TEST_FOLD = 17, 18, 19

SLICE_BITS, SLICE_ROWS = 12, 10_000


def split(df: DataFrame, name: str) -> DataFrame:
    """Rows of ``train`` (folds up to 17), ``val`` (18) or ``test`` (19)."""
    rules = {
        "train": F.col("fold") <= TRAIN_LAST_FOLD,
        "val": F.col("fold") == VAL_FOLD,
        "test": F.col("fold") == TEST_FOLD,
    }
    if name not in rules:
        raise ValueError(f"unknown split: {name!r}")
    return df.where(rules[name])


def select_mode(df: DataFrame, mode: str) -> DataFrame:
    """``triage``: the first recording of each stay; ``monitoring``: all."""
    if mode == "triage":
        return df.where(F.col("ecg_no_within_stay") == 0)
    if mode == "monitoring":
        return df
    raise ValueError(f"unknown mode: {mode!r}")


def first_by_draw(
    df: DataFrame, ids: DataFrame, id_col: str, wanted: Callable[[int], int], seed: int
) -> DataFrame:
    """Rows of ``df`` whose id has one of the smallest draws over ``ids``, wanted(count) of them.

    Small jobs find the last draw that is kept: histograms of the draws' leading
    bits until few ids are left in the slice it lies in. The rows are only filtered.
    """
    drawn = ids.select(draw(F.col(id_col), seed).alias("_draw"), id_col)
    within, left = drawn, None
    for bits in range(SLICE_BITS, DRAW_BITS + 1, SLICE_BITS):
        part = F.shiftright("_draw", DRAW_BITS - bits)
        # At most 2**SLICE_BITS rows, as the bits above are the same for all.
        slices = within.groupBy(part.alias("_slice")).agg(F.count(F.lit(1)).alias("_n")).collect()
        if left is None:
            left = wanted(sum(r["_n"] for r in slices))
            if left <= 0:
                return df.where(F.lit(False))
        for number, n in sorted((r["_slice"], r["_n"]) for r in slices):
            if left <= n:
                break
            left -= n
        within = drawn.where(part == number)
        if n <= SLICE_ROWS:
            break
    last = within.orderBy("_draw", id_col).offset(left - 1).limit(1).first()
    own = draw(F.col(id_col), seed)
    return df.where((own < last["_draw"]) | ((own == last["_draw"]) & (F.col(id_col) <= last[id_col])))


def subject_fraction(df: DataFrame, frac: float, seed: int = 0) -> DataFrame:
    """Whole subjects, max(1, int(subjects * frac)) of them, without replacement."""
    if frac >= 1.0:
        return df
    subjects = df.where(F.col("subject_id").isNotNull()).select("subject_id").distinct()
    return first_by_draw(df, subjects, "subject_id", lambda n: min(n, max(1, int(n * frac))), seed)


def take_rows(df: DataFrame, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows by position: ``ids`` holds (pos, row_idx), repeats allowed; ordered by pos."""
    cells = df.select("row_idx", *(columns or [c for c in df.columns if c != "row_idx"]))
    return ids.select("pos", "row_idx").join(cells, "row_idx").orderBy("pos")


def sample_rows(df: DataFrame, n: int, seed: int = 0, replace: bool = False) -> DataFrame:
    """n rows by ``row_idx``, which must be unique. With replacement each draw takes one of the positions
    in the order of ``row_idx``, and the result has the draw's number in ``pos``; no rows give none."""
    if not replace:
        return first_by_draw(df, df.select("row_idx"), "row_idx", lambda rows: min(n, rows), seed)
    places = row_positions(df.select("row_idx"), [], ["row_idx"], "_place")
    total = F.nullif(places.agg(F.count(F.lit(1)).alias("_n")).scalar(), F.lit(0))
    picks = df.sparkSession.range(n).select(F.col("id").alias("pos"), (draw(F.col("id"), seed) % total).alias("_place"))
    return picks.join(places, "_place").drop("_place").join(df, "row_idx")


def sample_per_group(
    df: DataFrame, group: str, n: int, seed: int = 0, id_col: str = "row_idx", salts: int | None = None
) -> DataFrame:
    """n rows of each group. The first round ranks within hash slices of a group, by default as many as
    there are shuffle partitions, so a large group is spread out and the second round sees at most
    salts * n rows of it."""
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_draw", id_col]
    drawn = df.withColumn("_draw", draw(F.col(id_col), seed)).withColumn(
        "_slice", F.pmod(F.col("_draw"), F.lit(salts))
    )
    by_slice = Window.partitionBy(group, "_slice").orderBy(*ascending(order))
    by_group = Window.partitionBy(group).orderBy(*ascending(order))
    return (
        drawn.withColumn("_rank", F.row_number().over(by_slice))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(by_group))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_slice", "_draw")
    )


def assign_batches(
    df: DataFrame,
    size: int,
    shuffle: bool = False,
    seed: int = 0,
    drop_last: bool | None = None,
) -> DataFrame:
    """Add ``pos`` (place in the epoch) and ``batch``; a short last batch is dropped when shuffling."""
    drop_last = shuffle if drop_last is None else drop_last
    order = ["_draw", "row_idx"] if shuffle else ["row_idx"]
    drawn = df.withColumn("_draw", draw(F.col("row_idx"), seed)) if shuffle else df
    out = positions_joined(drawn, order, "pos")
    out = out.withColumn("batch", F.floor(F.col("pos") / size).cast("long"))
    if drop_last:
        full = df.agg(F.floor(F.count(F.lit(1)) / size).cast("long").alias("_full")).scalar()
        out = out.where(F.col("batch") < full)
    return out.drop("_draw")
