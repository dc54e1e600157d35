"""Numeric arrays as cells. Signals are stored time-major: sample t of lead l is flat[t*L + l]."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flatten_frames(frames: Column | str) -> Column:
    """(T, L) nested to flat T*L."""
    return F.flatten(_column(frames))


def reshape_frames(flat: Column | str, leads: int) -> Column:
    """Flat T*L to (T, L) nested."""
    flat = _column(flat)
    frames = (F.size(flat) / leads).cast("int")

    def frame(t: Column) -> Column:
        return F.array(*[F.get(flat, t * leads + lead) for lead in range(leads)])

    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), frame)).when(
        flat.isNotNull(), F.array().cast("array<array<float>>")
    )


def reshape_frames_batch(leads: int):
    """The same frames, by the same rules, from whole Arrow batches: samples are not touched one by one."""

    @F.arrow_udf("array<array<float>>")
    def nest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            frames = lengths // leads
            values = column.flatten()
            if (lengths % leads).any():
                place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                values = values.filter(pa.array(place < np.repeat(frames * leads, lengths)))
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(values) // leads + 1) * leads, pa.int32()), values)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            bounds = pa.array(np.concatenate([[0], np.cumsum(frames)]), pa.int32(), mask=np.append(missing, False))
            yield pa.ListArray.from_arrays(bounds, inner)

    return nest


def lead_major(flat: Column | str, steps: int, leads: int) -> Column:
    """Flat time-major signal to ``leads`` arrays of ``steps`` samples; null unless it has steps * leads values."""
    flat = _column(flat)
    return F.when(
        F.size(flat) == steps * leads,
        F.transform(
            F.sequence(F.lit(0), F.lit(leads - 1)),
            lambda lead: F.transform(
                F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.get(flat, t * leads + lead)
            ),
        ),
    )


def _nested(cube: np.ndarray, missing: np.ndarray | None, present: np.ndarray) -> pa.Array:
    """(n, L, T) values as list<list<float>>, null where a row is not present or a value is missing."""
    n, leads, steps = cube.shape
    inner = pa.ListArray.from_arrays(
        pa.array(np.arange(n * leads + 1) * steps, pa.int32()),
        pa.array(cube.reshape(-1), pa.float32(), mask=None if missing is None else missing.reshape(-1)),
    )
    starts = np.concatenate([[0], np.cumsum(present * leads)])
    bounds = pa.array(starts, pa.int32(), mask=np.append(~present, False))
    return pa.ListArray.from_arrays(bounds, inner)


def lead_major_batch(steps: int, leads: int, zscore: bool = False):
    """The same layout, by the same rules, for long signals: whole Arrow batches, one NumPy transposition each.

    With ``zscore`` each lead is centred and divided by max(sample std, 1e-6); a lead that misses a value is all null.
    """

    @F.arrow_udf("array<array<float>>")
    def turn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            present = lengths == steps * leads
            values = column.filter(pa.array(present)).flatten()

            def by_lead(flat: np.ndarray) -> np.ndarray:
                return np.ascontiguousarray(flat.reshape(-1, steps, leads).transpose(0, 2, 1))

            cube = by_lead(values.to_numpy(zero_copy_only=False))
            missing = by_lead(values.is_null().to_numpy(zero_copy_only=False)) if values.null_count else None
            if zscore:
                wide = cube.astype(np.float64)
                centred = wide - wide.mean(axis=2, keepdims=True)
                spread = wide.std(axis=2, ddof=1, keepdims=True)
                cube = centred / np.maximum(spread, 1e-6)
                missing = missing if missing is None else missing.any(axis=2, keepdims=True) | np.zeros_like(missing)
            yield _nested(np.ascontiguousarray(cube, dtype=np.float32), missing, present)

    return turn


def zscore_leads(by_lead: Column | str) -> Column:
    """Centre each lead of a lead-major signal and divide by max(sample std, 1e-6)."""

    def scale(lead: Column) -> Column:
        n = F.size(lead)
        mean = F.aggregate(lead, F.lit(0.0), lambda s, x: s + x) / n
        squares = F.aggregate(lead, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        return F.transform(lead, lambda x: (x - mean) / F.greatest(F.sqrt(squares / (n - 1)), F.lit(1e-6)))

    return F.transform(_column(by_lead), scale)


def displacement(h_t: Column | str, h_t1: Column | str) -> Column:
    """h(t+1) - h(t), element by element."""
    return F.zip_with(_column(h_t), _column(h_t1), lambda a, b: b - a)


def squared_error(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(
        F.zip_with(_column(a), _column(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
        F.lit(0.0),
        lambda s, d: s + d,
    )
