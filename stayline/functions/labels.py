"""Label vectors: codes to 0/1 vectors and back, and the change between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _codes(vocab: Sequence[str]) -> Column:
    if not vocab:
        raise ValueError("the vocabulary is empty")
    if len(set(vocab)) != len(vocab):
        raise ValueError("the vocabulary holds a code twice")
    return F.array(*[F.lit(c) for c in vocab])


def encode_labels(codes: Column | str, vocab: Sequence[str]) -> Column:
    """Code list to 0/1 vector in vocabulary order; codes outside it count for nothing."""
    codes = _column(codes)
    vec = F.transform(
        _codes(vocab), lambda c: F.coalesce(F.array_contains(codes, c), F.lit(False)).cast("tinyint")
    )
    return F.when(codes.isNotNull(), vec)


def decode_labels(vec: Column | str, vocab: Sequence[str]) -> Column:
    """Vector to the codes at its non-zero positions, in vocabulary order."""
    vec = _column(vec)
    return F.when(vec.isNotNull(), F.filter(_codes(vocab), lambda c, i: F.get(vec, i) != 0))


def transition_vector(y_t: Column | str, y_t1: Column | str) -> Column:
    """-1 where a label goes, +1 where it comes, 0 elsewhere."""
    return F.zip_with(
        _column(y_t),
        _column(y_t1),
        lambda a, b: F.greatest(
            F.least(b.cast("smallint") - a.cast("smallint"), F.lit(1)), F.lit(-1)
        ).cast("tinyint"),
    )


def next_labels(y_t: Column | str, a_t: Column | str) -> Column:
    """Labels after the transition, kept in 0..1."""
    return F.zip_with(
        _column(y_t),
        _column(a_t),
        lambda y, a: F.greatest(
            F.least(y.cast("smallint") + a.cast("smallint"), F.lit(1)), F.lit(0)
        ).cast("tinyint"),
    )


def transition_targets(a_t: Column | str) -> tuple[Column, Column]:
    """0/1 vectors (onset, resolution) of a transition vector."""
    a_t = _column(a_t)
    onset = F.transform(a_t, lambda a: (a == 1).cast("tinyint"))
    resolution = F.transform(a_t, lambda a: (a == -1).cast("tinyint"))
    return onset, resolution


def contextual_prediction(y_t: Column | str, onset: Column | str, resolution: Column | str) -> Column:
    """P(label at t+1) = y(1 - p_resolution) + (1 - y)p_onset, element by element."""
    flips = F.arrays_zip(
        _column(y_t).alias("y"), _column(onset).alias("on"), _column(resolution).alias("off")
    )
    return F.transform(
        flips, lambda e: e["y"] * (1.0 - e["off"]) + (1.0 - e["y"]) * e["on"]
    )
