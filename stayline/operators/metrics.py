"""Metrics and losses over predictions in long form: one row per (recording or pair, class)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import squared_error
from ..functions.labels import transition_targets
from .lineage import cut_lineage
from .ordered import HOT_ROWS, running


def _sums_in_order(keys: list[str], names: list[str]) -> Callable:
    """Rows of a partition in order of keys and score -> per key the positives, negatives and wins among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []
        key = score = None
        p = n = wins = tied_p = tied_n = 0.0

        def closed():
            return p + tied_p, n + tied_n, wins + tied_p * (n + 0.5 * tied_n)

        for batch in batches:
            if not batch.num_rows:
                continue
            value, hit = (batch.column(i).to_numpy(zero_copy_only=False) for i in (len(keys), len(keys) + 1))
            other = np.zeros(len(hit), bool)
            other[0] = True
            for i in range(len(keys)):
                column = batch.column(i)
                other[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            value = value.astype(float)
            apart = other.copy()
            apart[1:] |= (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))
            starts = np.flatnonzero(apart)
            pos = np.add.reduceat(hit.astype(float), starts)
            neg = np.diff(np.append(starts, len(hit))) - pos
            bounds = [*np.flatnonzero(other[starts]), len(starts)]
            for low, high in zip(bounds, bounds[1:]):
                at, here_p, here_n = starts[low:high], pos[low:high], neg[low:high]
                here = tuple(batch.column(i)[int(at[0])].as_py() for i in range(len(keys)))
                first = value[at[0]]
                if here != key:
                    if key is not None:
                        done.append((*key, *closed()))
                    key, p, n, wins = here, 0.0, 0.0, 0.0
                elif first == score or (np.isnan(first) and np.isnan(score)):  # the score goes on from the batch before
                    here_p[0] += tied_p
                    here_n[0] += tied_n
                else:
                    p, n, wins = closed()
                below = n + np.cumsum(here_n[:-1]) - here_n[:-1]
                wins += (here_p[:-1] * (below + 0.5 * here_n[:-1])).sum()
                p, n = p + here_p[:-1].sum(), n + here_n[:-1].sum()
                score, tied_p, tied_n = value[at[-1]], here_p[-1], here_n[-1]
        if key is not None:
            done.append((*key, *closed()))
            kinds = [batch.schema.field(i).type for i in range(len(keys))] + [pa.float64()] * 3
            columns = [pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int32()), *columns], names=names)

    return run


def _wins_by_ranges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wins, p, n) with one shuffle: rows are dealt by ranges of key and score, so that equal scores lie
    together, each task sums its own, and what is below comes from the sums of the earlier tasks."""
    score = F.when(F.col("score").isNotNull(), F.col("score").cast("double")).otherwise(F.lit(float("nan")))
    rows = cut_lineage(cells.where("target IS NOT NULL").select(*keys, score.alias("score"), (F.col("target") > 0).alias("hit")))
    by = [*keys, "score"]
    names = ["_part", *keys, "p", "n", "wins"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(["_part int", *[f"{k} {kinds[k]}" for k in keys], "p double", "n double", "wins double"])
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_sums_in_order(keys, names), out)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(earlier), F.lit(0.0))
    won = cut_lineage(parts).withColumn("won", F.col("wins") + F.col("p") * below)
    return won.groupBy(*keys).agg(F.sum("won").alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))


def auroc_by_class(
    cells: DataFrame, group: Sequence[str] = (), weight: str | None = None, limit: int = HOT_ROWS, many_scores: bool = False
) -> DataFrame:
    """AUROC per class from (class_idx, score, target); ties count one half.

    Rows without a target and classes with a single target value are left out. Rows of equal score are
    summed before they move and the sums are kept, so that scores which come
    from a model are computed once; the ranks are running totals. With ``many_scores``, for scores of which
    hardly any two are equal, rows move once and are not summed before; a null score then counts as NaN. Group keys
    must not be null.
    """
    keys = [*group, "class_idx"]
    if many_scores:
        if weight:
            raise ValueError("many_scores goes without weights")
        sums = _wins_by_ranges(cells, keys).where((F.col("p") > 0) & (F.col("n") > 0))
        return sums.select(*keys, (F.col("wins") / (F.col("p") * F.col("n"))).alias("auroc"))
    w = F.col(weight) if weight else F.lit(1).cast("long")
    positive = F.col("target") > 0
    counts = cells.where("target IS NOT NULL").groupBy(*keys, "score").agg(
        F.sum(F.when(positive, w).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(w)).alias("neg"),
    )
    counts = cut_lineage(counts)
    ranked = running(counts, keys, ["score"], {"below": F.col("neg")}, limit, few_groups=True)
    wins = F.col("pos") * (F.col("below") + F.lit(0.5) * F.col("neg"))
    return (
        ranked.groupBy(*keys)
        .agg(
            F.sum(wins).alias("wins"),
            F.sum("pos").cast("double").alias("p"),
            F.sum("neg").cast("double").alias("n"),
        )
        .where((F.col("p") > 0) & (F.col("n") > 0))
        .select(*keys, (F.col("wins") / (F.col("p") * F.col("n"))).alias("auroc"))
    )


def macro_auroc(
    cells: DataFrame, group: Sequence[str] = (), weight: str | None = None, limit: int = HOT_ROWS, many_scores: bool = False
) -> DataFrame:
    """Mean AUROC over the usable classes."""
    return (
        auroc_by_class(cells, group, weight, limit, many_scores)
        .groupBy(*group)
        .agg(F.avg("auroc").alias("macro_auroc"), F.count(F.lit(1)).alias("classes"))
    )


def prediction_cells(df: DataFrame, row: str, scores: str, targets: str) -> DataFrame:
    """Score and target vectors to (row, class_idx, score, target)."""
    zipped = F.arrays_zip(F.col(scores).alias("score"), F.col(targets).alias("target"))
    return df.select(row, F.posexplode(zipped).alias("class_idx", "v")).select(
        row, "class_idx", "v.score", "v.target"
    )


def pair_cells(labelled_pairs: DataFrame) -> DataFrame:
    """Pairs with y_t, y_t1 and a_t vectors to one row per pair and class."""
    zipped = F.arrays_zip("y_t", "y_t1", "a_t")
    return labelled_pairs.select("idx_t", F.posexplode(zipped).alias("class_idx", "v")).select(
        "idx_t", "class_idx", "v.y_t", "v.y_t1", "v.a_t"
    )


def binary_auroc(cells: DataFrame, score: Column, target: Column) -> DataFrame:
    """AUROC per class of a 0/1 score: (1 + hit rate - false alarm rate) / 2, from four counts."""
    hit, alarm = (score == 1) & (target == 1), (score == 1) & (target == 0)
    counts = cells.groupBy("class_idx").agg(
        F.count_if(target == 1).alias("p"),
        F.count_if(target == 0).alias("n"),
        F.count_if(hit).alias("hits"),
        F.count_if(alarm).alias("alarms"),
    )
    usable = counts.where((F.col("p") > 0) & (F.col("n") > 0))
    auroc = (1.0 + F.col("hits") / F.col("p") - F.col("alarms") / F.col("n")) / 2.0
    return usable.select("class_idx", auroc.alias("auroc"))


def carry_forward(cells: DataFrame) -> DataFrame:
    """Current label as score for the next label."""
    return binary_auroc(cells, F.col("y_t"), F.col("y_t1"))


def onset_structural(cells: DataFrame) -> DataFrame:
    """Absence of the label as score for its onset."""
    return binary_auroc(cells, 1 - F.col("y_t"), (F.col("a_t") == 1).cast("int"))


def resolution_structural(cells: DataFrame) -> DataFrame:
    """Presence of the label as score for its resolution."""
    return binary_auroc(cells, F.col("y_t"), (F.col("a_t") == -1).cast("int"))


def weighted_bce(logit: str, target: str, pos_weight: float) -> Column:
    """Weighted logistic loss of a cell, in the form that does not overflow."""
    x, y = F.col(logit), F.col(target).cast("double")
    softplus = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return (1.0 - y) * x + (1.0 + (pos_weight - 1.0) * y) * softplus


def bce_with_logits(
    cells: DataFrame, logit: str = "logit", target: str = "target", pos_weight: float = 1.0
) -> DataFrame:
    """Mean weighted logistic loss."""
    return cells.agg(F.avg(weighted_bce(logit, target, pos_weight)).alias("loss"))


def two_head_loss(
    df: DataFrame, onset_weight: float, resolution_weight: float, change: str = "a_t"
) -> DataFrame:
    """(onset_loss, resolution_loss, loss): weighted logistic losses of both heads against the transition
    vector, and their sum, from (onset_logits, resolution_logits, a_t). Rows with a null vector are left out."""
    onset, resolution = transition_targets(change)
    whole = df.where("onset_logits IS NOT NULL AND resolution_logits IS NOT NULL").where(F.col(change).isNotNull())
    both = F.arrays_zip(
        F.col("onset_logits").alias("onset_logit"),
        F.col("resolution_logits").alias("resolution_logit"),
        onset.alias("onset"),
        resolution.alias("resolution"),
    )
    cells = whole.select(F.inline(both))
    return cells.agg(
        F.avg(weighted_bce("onset_logit", "onset", onset_weight)).alias("onset_loss"),
        F.avg(weighted_bce("resolution_logit", "resolution", resolution_weight)).alias("resolution_loss"),
    ).withColumn("loss", F.col("onset_loss") + F.col("resolution_loss"))


def mse(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared difference of two array columns over rows and dimensions."""
    return df.agg((F.sum(squared_error(a, b)) / F.sum(F.size(a))).alias("mse"))


def objective(pred: DataFrame, reg_t: DataFrame, reg_t1: DataFrame, lam: float) -> DataFrame:
    """(1 - lam) pred + lam (reg_t + reg_t1) and the ratio of the parts, from one-row tables."""
    spark = pred.sparkSession
    parts = spark.range(1).select(
        pred.scalar().alias("pred_loss"), (reg_t.scalar() + reg_t1.scalar()).alias("reg_loss")
    )
    p, r = F.col("pred_loss"), F.col("reg_loss")
    return parts.select(
        "pred_loss",
        "reg_loss",
        ((1.0 - lam) * p + lam * r).alias("loss"),
        (r / (p + 1e-8)).alias("loss_ratio"),
    )


def class_balance(cells: DataFrame, target: str = "target") -> DataFrame:
    """Positives and negatives per class, and negatives per positive."""
    y = F.col(target)
    counts = cells.groupBy("class_idx").agg(
        F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives")
    )
    ratio = F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
    usable = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return counts.withColumns({"pos_weight": ratio, "usable": usable})
