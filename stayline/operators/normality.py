"""Epps-Pulley distance of one-dimensional projections from the standard normal."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import DRAW_BITS

# The mixing of counters to 32 random bits.
SEED_STEP = 0x9E3779B1
MIXING = [(16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 0x27D4EB2F)]
LAST_SHIFT = 15
MASK = (1 << 32) - 1

ROWS_AT_ONCE = 2_048
DIRECTIONS_AT_ONCE = 256


def quadrature(t_max: float, n_points: int) -> list[tuple[float, float, float]]:
    """(t, normal characteristic function, weight) of the trapezoid rule over both signs of t."""
    if n_points < 3 or n_points % 2 == 0:
        raise ValueError("n_points must be odd and at least 3")
    step = t_max / (n_points - 1)
    out = []
    for i in range(n_points):
        phi = math.exp(-0.5 * (i * step) ** 2)
        end = i in (0, n_points - 1)
        out.append((i * step, phi, (1 if end else 2) * step * phi))
    return out


def epps_pulley(
    df: DataFrame, cols: Sequence[str], t_max: float = 3.0, n_points: int = 17
) -> DataFrame:
    """(slice, statistic) per projection column."""
    points = quadrature(t_max, n_points)
    x = F.col("x")
    slices = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("double").alias("x")) for c in cols])
        ).alias("s")
    ).select("s.slice", "s.x")
    means = slices.groupBy("slice").agg(
        F.count("x").alias("n"),
        *[F.avg(F.cos(x * t)).alias(f"c{i}") for i, (t, _, _) in enumerate(points)],
        *[F.avg(F.sin(x * t)).alias(f"s{i}") for i, (t, _, _) in enumerate(points)],
    )
    total: Column = F.lit(0.0)
    for i, (_, phi, weight) in enumerate(points):
        c, s = F.col(f"c{i}"), F.col(f"s{i}")
        total = total + weight * ((c - phi) * (c - phi) + s * s)
    return means.select("slice", (F.col("n") * total).alias("statistic"))


def _uniform(seed: int, key: str) -> float:
    digits = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[: DRAW_BITS // 4]
    return (int(digits, 16) + 0.5) / 2.0**DRAW_BITS


def random_directions(seed: int, slices: int, dim: int) -> np.ndarray:
    """(slices, dim) unit vectors, normal draws by the Box-Muller rule from keyed hashes."""
    raw = np.empty((slices, dim))
    for s in range(slices):
        for d in range(dim):
            u, v = _uniform(seed, f"{s}:{d}:u"), _uniform(seed, f"{s}:{d}:v")
            raw[s, d] = math.sqrt(-2.0 * math.log(u)) * math.cos(2.0 * math.pi * v)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def counter_uniforms(seed: int, counters: np.ndarray) -> np.ndarray:
    """Uniform draws in (0, 1) fixed by the seed and a counter below 2^32, by three multiply-and-shift rounds."""
    x = (counters.astype(np.uint64) + np.uint64(seed % (1 << 16)) * np.uint64(SEED_STEP)) & np.uint64(MASK)
    for shift, factor in MIXING:
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(MASK)
    x ^= x >> np.uint64(LAST_SHIFT)
    return (x.astype(np.float64) + 0.5) / 2.0**32


def counter_directions(seed: int, first: int, count: int, dim: int) -> np.ndarray:
    """(count, dim) unit vectors, the directions ``first`` and on of a seed: whichever task makes them, they are
    the same. Normal draws by the Box-Muller rule, two counters each."""
    if (first + count) * dim * 2 > 1 << 32:
        raise ValueError("more draws than counters")
    place = np.arange(first * dim, (first + count) * dim, dtype=np.uint64) * np.uint64(2)
    u, v = counter_uniforms(seed, place), counter_uniforms(seed, place + np.uint64(1))
    raw = (np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)).reshape(count, dim)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _whole_rows(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of the lists of that length without a null or a number that is not finite."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    cells = column.filter(fits)
    x = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), dim)
    return x[np.isfinite(x).all(axis=1)]


def _statistics(
    df: DataFrame, col: str, dim: int, blocks: Callable[[], Iterable[np.ndarray]], slices: int, t_max: float, n_points: int
) -> DataFrame:
    """(slice, statistic); ``blocks`` gives the directions, some at a time, in the tasks."""
    points = quadrature(t_max, n_points)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [np.asarray(b, dtype=np.float64).T for b in blocks()]
        n = 0
        cos, sin = np.zeros((slices, len(points))), np.zeros((slices, len(points)))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = _whole_rows(batch.column(0).slice(start, ROWS_AT_ONCE), dim)
                n += len(rows)
                at = 0
                for across in ways:
                    x, here = rows @ across, slice(at, at + across.shape[1])
                    for i, (t, _, _) in enumerate(points):
                        cos[here, i] += np.cos(x * t).sum(axis=0)
                        sin[here, i] += np.sin(x * t).sum(axis=0)
                    at = here.stop
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(slices, dtype=np.int32), len(points))),
                    pa.array(np.tile(np.arange(len(points), dtype=np.int32), slices)),
                    pa.array(np.full(slices * len(points), n, dtype=np.int64)),
                    pa.array(cos.reshape(-1)),
                    pa.array(sin.reshape(-1)),
                ],
                names=["slice", "point", "n", "cos", "sin"],
            )

    parts = df.select(col).mapInArrow(sums, "slice int, point int, n long, cos double, sin double")
    phi = F.get(F.array(*[F.lit(p) for _, p, _ in points]), F.col("point"))
    weight = F.get(F.array(*[F.lit(w) for _, _, w in points]), F.col("point"))
    c, s = F.col("cos") / F.col("n") - phi, F.col("sin") / F.col("n")
    return (
        parts.groupBy("slice", "point")
        .agg(F.sum("n").alias("n"), F.sum("cos").alias("cos"), F.sum("sin").alias("sin"))
        .groupBy("slice")
        .agg((F.first("n") * F.sum(weight * (c * c + s * s))).alias("statistic"))
    )


def slice_statistics(
    df: DataFrame,
    directions: np.ndarray,
    col: str = "embedding",
    t_max: float = 3.0,
    n_points: int = 17,
) -> DataFrame:
    """(slice, statistic) of the embeddings along each of the given directions.

    Each task adds up cos and sin over all its batches and sends one row per (slice, point), so the shuffle
    does not grow with the rows. Embeddings that are null, of another length than the directions, or hold a
    null or a number that is not finite are left out.
    """
    ways = np.asarray(directions, dtype=np.float64)
    return _statistics(df, col, ways.shape[1], lambda: [ways], len(ways), t_max, n_points)


def seeded_slice_statistics(
    df: DataFrame,
    slices: int,
    dim: int,
    seed: int = 0,
    col: str = "embedding",
    t_max: float = 3.0,
    n_points: int = 17,
) -> DataFrame:
    """As `slice_statistics` along ``slices`` directions of a seed (`counter_directions`), made in the tasks a
    block at a time; nothing of their size passes through the driver."""

    def blocks() -> Iterator[np.ndarray]:
        for first in range(0, slices, DIRECTIONS_AT_ONCE):
            yield counter_directions(seed, first, min(DIRECTIONS_AT_ONCE, slices - first), dim)

    return _statistics(df, col, dim, blocks, slices, t_max, n_points)


def sliced_epps_pulley(
    df: DataFrame,
    directions: np.ndarray,
    col: str = "embedding",
    t_max: float = 3.0,
    n_points: int = 17,
) -> DataFrame:
    """Mean of the statistic over the directions."""
    stats = slice_statistics(df, directions, col, t_max, n_points)
    return stats.agg(F.avg("statistic").alias("statistic"))
