"""Bootstrap intervals of the macro AUROC. All classes of a replicate share its draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.hashing import draw
from ..functions.labels import contextual_prediction, next_labels, transition_targets
from .lineage import cut_lineage
from .metrics import macro_auroc, prediction_cells
from .ordered import HOT_ROWS, row_positions, running_by_ranges
from .resampling import held_positions
from .scoring import linear_head, transition_probabilities

BLOCK_ROWS = 4_096  # rows of one class and score range that a task gets together
SLICE_ROWS = 1_024  # rows it weighs at once
DRAWS_PER_TASK = 4_000_000


def _positions(rows: DataFrame, row: str) -> DataFrame:
    return cut_lineage(row_positions(rows.select(row).distinct(), [], [row], "pos"))


def _draws(positions: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, pos): draw k = replicate * n + i takes position draw(k) mod n."""
    rows = positions.count()
    n = F.lit(rows)
    k = F.col("replicate") * n + F.col("i")
    # The positions are few and lie together; their draws are many, so they are spread out first.
    spread = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = max(spread, rows * replicates // DRAWS_PER_TASK)
    return positions.repartition(spread, "pos").select(
        F.col("pos").alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"),
    ).select("replicate", (draw(k, seed) % n).alias("pos"))


def bootstrap_draws(rows: DataFrame, replicates: int, seed: int, row: str = "row_idx") -> DataFrame:
    """How often each replicate holds each row: (replicate, row, weight). Rows not drawn are absent."""
    positions = _positions(rows, row)
    drawn = _draws(positions, replicates, seed)
    return (
        drawn.groupBy("replicate", "pos")
        .agg(F.count(F.lit(1)).alias("weight"))
        .join(positions, "pos")
        .select("replicate", row, "weight")
    )


def _by_cells(cells, replicates, seed, row, group, limit):
    weights = bootstrap_draws(cells, replicates, seed, row)
    return macro_auroc(cells.join(weights, row), [*group, "replicate"], "weight", limit)


def _block_sums(replicates: int, names: list[str], schema: pa.Schema):
    """Per replicate: the block's positives, negatives and wins, and the two first of its edge scores."""

    def counts(held: pa.ListArray, rank: np.ndarray, scores: int) -> np.ndarray:
        slot = np.repeat(rank, held.value_lengths().to_numpy()) * replicates + held.flatten().to_numpy()
        return np.bincount(slot, minlength=scores * replicates).reshape(scores, replicates).astype(float)

    def sums(table: pa.Table) -> pa.Table:
        score, target = table["score"].to_numpy(), table["target"].to_numpy() > 0
        held = table["held"].combine_chunks()
        order = np.argsort(score, kind="stable")
        pos, neg, wins = (np.zeros(replicates) for _ in range(3))
        first = last = None  # (score, positives, negatives) of the edge scores
        for start in range(0, len(order), SLICE_ROWS):
            rows = order[start : start + SLICE_ROWS]
            scores, rank = np.unique(score[rows], return_inverse=True)
            hit = target[rows]
            p = counts(held.take(pa.array(rows[hit])), rank[hit], len(scores))
            n = counts(held.take(pa.array(rows[~hit])), rank[~hit], len(scores))
            below = neg + np.cumsum(n, axis=0) - n
            if last and last[0] == scores[0]:  # the score goes on from the slice before
                wins += 0.5 * (last[1] * n[0] - p[0] * last[2])
                again = (scores[0], last[1] + p[0], last[2] + n[0])
                first = again if first[0] == scores[0] else first
            else:
                again = (scores[0], p[0], n[0])
                first = first or again
            last = again if len(scores) == 1 else (scores[-1], p[-1], n[-1])
            wins += (p * (below + 0.5 * n)).sum(axis=0)
            pos += p.sum(axis=0)
            neg += n.sum(axis=0)
        parts = [(None, pos, neg, wins)]
        for edge in (first, last) if first[0] != last[0] else (first,):
            parts.append((*edge, np.zeros(replicates)))
        rows = len(parts) * replicates
        columns = [pa.array([table[n][0].as_py()] * rows, schema.field(n).type) for n in names]
        edge = pa.array(np.repeat([0.0 if p[0] is None else p[0] for p in parts], replicates))
        total = pa.array(np.repeat([p[0] is None for p in parts], replicates))
        values = [pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2, 3)]
        ids = pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(parts)))
        return pa.Table.from_arrays([*columns, ids, total, edge, *values], schema=schema)

    return sums


def _listed_draws(positions: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(pos, held) of the draws by counter."""
    number = "smallint" if replicates < 2**15 else "int"
    drawn = _draws(positions, replicates, seed)
    return drawn.groupBy("pos").agg(F.collect_list(F.col("replicate").cast(number)).alias("held"))


def tree_draws(rows: DataFrame, replicates: int, seed: int, row: str = "row_idx") -> DataFrame:
    """As `bootstrap_draws` with the draws of `held_positions`, of which none is shuffled."""
    positions = _positions(rows, row)
    held = held_positions(positions, replicates, seed).join(positions, "pos")
    counts = F.transform(
        F.array_distinct("held"), lambda r: F.struct(r.cast("int").alias("replicate"), F.size(F.filter("held", lambda x: x == r)).cast("long").alias("weight"))
    )
    return held.select(row, F.inline(counts)).select("replicate", row, "weight")


def _by_blocks(cells, replicates, seed, row, group, block_rows, draws=_listed_draws):
    """Rank by score within the class, weigh whole blocks for all replicates, and join the blocks' sums.

    Ranks come from a range partitioning by class and score, so blocks are of one size however many rows a
    class has, and no row holds more for it. Inside a block ties count one half. Across blocks a negative in an earlier
    block counts one and in a later block nothing; where it has the positive's
    score, which is then an edge score of both blocks, both are set to one half.
    """
    positions = _positions(cells, row)
    held = draws(positions, replicates, seed).join(positions, "pos").select(row, "held")
    keys = [*group, "class_idx"]
    narrow = cells.select(
        *keys, row, F.col("score").cast("double").alias("score"), F.col("target").cast("double").alias("target")
    )
    one = F.lit(1).cast("long")
    ranked = running_by_ranges(narrow.where("target IS NOT NULL"), keys, ["score", row], {"_rank": one})
    cut = ranked.withColumn("_chunk", F.floor(F.col("_rank") / block_rows)).drop("_rank")
    names = [*keys, "_chunk"]
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    out = ", ".join(f"{n} {kinds[n]}" for n in names)
    out += ", replicate int, total boolean, edge double, pos double, neg double, wins double"
    key_schema = to_arrow_schema(cut.select(*names).schema)
    schema = pa.schema(
        [(n, key_schema.field(n).type) for n in names]
        + [("replicate", pa.int32()), ("total", pa.bool_()), ("edge", pa.float64())]
        + [(n, pa.float64()) for n in ("pos", "neg", "wins")]
    )
    sums = cut.join(held, row).groupBy(*names).applyInArrow(_block_sums(replicates, names, schema), out)
    earlier = (
        Window.partitionBy(*keys, "replicate", "total", "edge")
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    above = F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    under = F.col("neg") * F.coalesce(F.sum("pos").over(earlier), F.lit(0.0))
    across = F.when(F.col("total"), above).otherwise(0.5 * (under - above))
    per_class = (
        sums.withColumn("won", F.col("wins") + across)
        .groupBy(*keys, "replicate")
        .agg(
            F.sum("won").alias("won"),
            F.sum(F.when(F.col("total"), F.col("pos"))).alias("p"),
            F.sum(F.when(F.col("total"), F.col("neg"))).alias("n"),
        )
        .where((F.col("p") > 0) & (F.col("n") > 0))
    )
    return per_class.groupBy(*group, "replicate").agg(
        F.avg(F.col("won") / (F.col("p") * F.col("n"))).alias("macro_auroc"),
        F.count(F.lit(1)).alias("classes"),
    )


def bootstrap_replicates(
    cells: DataFrame,
    replicates: int,
    seed: int,
    row: str = "row_idx",
    group: Sequence[str] = (),
    method: str = "blocks",
    limit: int | None = None,
) -> DataFrame:
    """Macro AUROC per replicate from (row, class_idx, score, target).

    ``blocks`` moves every cell once with its replicate list and suits continuous
    scores; ``cells`` sums (replicate, class, score) on the map side and suits
    scores of few values. ``tree`` is ``blocks`` with the draws of `held_positions`: other draws, of which
    none is made or moved for itself, for many rows and replicates. Replicates without a usable class are absent.
    """
    cells = cut_lineage(cells.select(*group, row, "class_idx", "score", "target"))
    if method == "blocks":
        return _by_blocks(cells, replicates, seed, row, list(group), limit or BLOCK_ROWS)
    if method == "tree":
        return _by_blocks(cells, replicates, seed, row, list(group), limit or BLOCK_ROWS, held_positions)
    if method == "cells":
        return _by_cells(cells, replicates, seed, row, list(group), limit or HOT_ROWS)
    raise ValueError(f"unknown method: {method!r}")


def bootstrap_auroc(
    cells: DataFrame,
    replicates: int,
    seed: int,
    row: str = "row_idx",
    group: Sequence[str] = (),
    method: str = "blocks",
    limit: int | None = None,
) -> DataFrame:
    """Mean and 95 % interval of the macro AUROC over the replicates."""
    per_replicate = bootstrap_replicates(cells, replicates, seed, row, group, method, limit)
    points = F.percentile("macro_auroc", F.array(F.lit(0.025), F.lit(0.975)))
    return (
        per_replicate.groupBy(*group)
        .agg(
            F.avg("macro_auroc").alias("mean"),
            points.alias("_points"),
            F.count(F.lit(1)).alias("replicates"),
        )
        .select(
            *group,
            "mean",
            F.col("_points")[0].alias("lo"),
            F.col("_points")[1].alias("hi"),
            "replicates",
        )
    )


def transition_task_cells(predictions: DataFrame, row: str = "idx_t") -> DataFrame:
    """(row, task, class_idx, score, target) of the onset, resolution and contextual tasks.

    ``predictions`` has y_t, a_t and the probability vectors onset and resolution.
    """
    onset, resolution = transition_targets("a_t")
    tasks = {
        "onset": (F.col("onset"), onset),
        "resolution": (F.col("resolution"), resolution),
        "contextual": (
            contextual_prediction("y_t", "onset", "resolution"),
            next_labels("y_t", "a_t"),
        ),
    }
    parts = F.array(
        *[
            F.struct(F.lit(t).alias("task"), F.arrays_zip(s.alias("score"), y.alias("target")).alias("v"))
            for t, (s, y) in tasks.items()
        ]
    )
    return (
        predictions.select(row, F.explode(parts).alias("t"))
        .select(row, "t.task", F.posexplode("t.v").alias("class_idx", "v"))
        .select(row, "task", "class_idx", "v.score", "v.target")
    )


def evaluate_labels(
    recordings: DataFrame,
    layer: Mapping[str, np.ndarray],
    replicates: int,
    seed: int,
    features: str = "embedding",
    labels: str = "icd",
    row: str = "row_idx",
    method: str = "blocks",
    digits: int | None = None,
) -> DataFrame:
    """Macro AUROC with interval of a linear head on the embeddings of single recordings.

    ``layer`` has weight and bias. Rows with null or wrong-sized embeddings, or without labels, are left
    out. ``digits`` rounds the probabilities, so that scores which differ by the order of a sum only count as ties.
    """
    scored = linear_head(recordings.select(row, features, labels), layer["weight"], layer["bias"], features)
    scored = scored.where(F.col("probs").isNotNull() & F.col(labels).isNotNull())
    if digits is not None:
        scored = scored.withColumn("probs", F.transform("probs", lambda p: F.round(p, digits)))
    return bootstrap_auroc(prediction_cells(scored, row, "probs", labels), replicates, seed, row, method=method)


def evaluate_transitions(
    predictions: DataFrame,
    replicates: int,
    seed: int,
    row: str = "idx_t",
    method: str = "blocks",
    limit: int | None = None,
) -> DataFrame:
    """AUROC with interval per task, on the same draws for all three."""
    return bootstrap_auroc(
        transition_task_cells(predictions, row), replicates, seed, row, ["task"], method, limit
    )


def evaluate_inverse(
    pairs: DataFrame,
    weights: Mapping[str, Mapping[str, np.ndarray]],
    replicates: int,
    seed: int,
    row: str = "idx_t",
    method: str = "blocks",
    digits: int | None = None,
) -> DataFrame:
    """AUROC with interval per task, from embeddings: displacement, both heads, probabilities, draws.

    ``pairs`` has h_t, h_t1, y_t and a_t. ``digits`` rounds the probabilities, so that scores which
    differ by the order of a sum only count as ties.
    """
    scored = transition_probabilities(pairs, weights).select(row, "y_t", "a_t", "onset", "resolution")
    scored = scored.where("onset IS NOT NULL AND resolution IS NOT NULL")
    if digits is not None:
        scored = scored.withColumns({n: F.transform(n, lambda p: F.round(p, digits)) for n in ("onset", "resolution")})
    return evaluate_transitions(scored, replicates, seed, row, method)
