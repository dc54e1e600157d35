"""Model inputs: single recordings or pairs of one split, signals lead-major."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import lead_major_batch
from ..functions.labels import transition_vector
from ..schema import CROSS_STAY, WITHIN_STAY
from .pairs import fetch_pairs, filter_pairs
from .select import select_mode, split, subject_fraction

# Samples per lead and leads of a full recording.
STEPS, LEADS = 5000, 12


def _as_float(vec: str) -> Column:
    return F.transform(vec, lambda v: v.cast("float"))


def single_samples(
    recordings: DataFrame,
    split_name: str,
    mode: str = "triage",
    train_frac: float = 1.0,
    seed: int = 0,
    steps: int = STEPS,
    leads: int = LEADS,
    ordered: bool = False,
) -> DataFrame:
    """(row_idx, waveform, label) of one split; in ``train`` of a fraction of its subjects.

    ``ordered`` sorts the samples by ``row_idx``, which moves their signals.
    """
    rows = split(recordings, split_name)
    if split_name == "train":
        rows = subject_fraction(rows, train_frac, seed)
    rows = select_mode(rows, mode)
    return (rows.orderBy("row_idx") if ordered else rows).select(
        "row_idx",
        lead_major_batch(steps, leads)("waveform").alias("waveform"),
        _as_float("icd").alias("label"),
    )


def pair_samples(
    pairs: DataFrame,
    recordings: DataFrame,
    split_name: str,
    pair_types: Sequence[str] = (WITHIN_STAY, CROSS_STAY),
    train_frac: float = 1.0,
    seed: int = 0,
    steps: int = STEPS,
    leads: int = LEADS,
) -> DataFrame:
    """(idx_t, idx_t1, x_t, x_t1, y_t, a_t); the fraction is of subjects that have such pairs."""
    chosen = filter_pairs(pairs, split_name, pair_types)
    if split_name == "train":
        chosen = subject_fraction(chosen, train_frac, seed)
    by_lead = lead_major_batch(steps, leads)
    return fetch_pairs(chosen, recordings, ["waveform", "icd"]).select(
        "idx_t",
        "idx_t1",
        by_lead("waveform_t").alias("x_t"),
        by_lead("waveform_t1").alias("x_t1"),
        _as_float("icd_t").alias("y_t"),
        transition_vector("icd_t", "icd_t1").alias("a_t"),
    )
