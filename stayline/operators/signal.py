"""Statistics of the signals."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..schema import LEADS
from .lineage import store

# Fixed values.
PERCENTILES = [1, 5, 25, 50, 75, 95, 99]
TOLERANCE = 0.05

KEY_BITS = 64
DIGIT = 12  # bits of a key that one round of the radix selection counts by
FEW = 10_000  # values in question that are counted by all their remaining bits
ROWS_AT_ONCE = 64  # signals widened to float64 together


def _moments(x: np.ndarray, sizes: np.ndarray, leads: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population std, (rows, leads), of signals laid end to end; NaN without samples."""
    if len(sizes) and sizes[0] and sizes[0] % leads == 0 and (sizes == sizes[0]).all():
        cube = x.reshape(len(sizes), -1, leads)
        return cube.mean(axis=1), cube.std(axis=1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot = row * leads + at % leads
    n = np.bincount(slot, minlength=len(sizes) * leads)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.bincount(slot, x, len(n)) / n
        std = np.sqrt(np.bincount(slot, (x - mean[slot]) ** 2, len(n)) / n)
    return mean.reshape(-1, leads), std.reshape(-1, leads)


def lead_stats(df: DataFrame, leads: int, key: str = "row_idx", signal: str = "waveform") -> DataFrame:
    """(key, lead, mean, std) per recording and lead, population std.

    Signals go to Python as Arrow buffers and come back as two numbers per lead.
    """

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                part = part.filter(pc.greater(pc.fill_null(pc.list_value_length(part.column(1)), 0), 0))
                cells = part.column(1)
                sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
                x = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                mean, std = _moments(x, sizes, leads)
                keep = ~np.isnan(mean.reshape(-1)) | np.repeat(sizes >= leads, leads)
                rows = pa.array(np.repeat(np.arange(len(sizes)), leads)[keep], pa.int64())
                lead = np.tile(np.arange(leads, dtype=np.int32), len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows),
                        pa.array(lead[keep]),
                        pa.array(mean.reshape(-1)[keep]),
                        pa.array(std.reshape(-1)[keep]),
                    ],
                    names=[key, "lead", "mean", "std"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, signal).mapInArrow(stats, f"{key} {kind}, lead int, mean double, std double")


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers in the order of doubles: -0.0 as 0.0, NaN above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def value_of_key(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return struct.unpack("<d", bits.to_bytes(8, "little"))[0]


def _digit_counts(
    df: DataFrame, group: Sequence[str], value: str, known: int, digit: int, prefixes: Sequence[int]
) -> DataFrame:
    """(group, _prefix, _digit, _n): rows by the next ``digit`` bits of their key, after ``known`` bits that are
    among the prefixes. Tasks send counts only."""
    names, wanted = list(group), np.array(sorted(set(prefixes)), np.uint64)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = ordered_keys(batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.float64))
            prefix = key >> np.uint64(KEY_BITS - known) if known else np.zeros(len(key), np.uint64)
            held = np.isin(prefix, wanted)
            place = (key >> np.uint64(KEY_BITS - known - digit)) & np.uint64((1 << digit) - 1)
            columns = [c.filter(pa.array(held)) for c in batch.columns[: len(names)]]
            columns += [pa.array(prefix[held].astype(np.int64)), pa.array(place[held].astype(np.int64))]
            rows = pa.Table.from_arrays(columns, names=[*names, "_prefix", "_digit"])
            summed = rows.group_by([*names, "_prefix", "_digit"], use_threads=False).aggregate([([], "count_all")])
            yield from summed.rename_columns([*names, "_prefix", "_digit", "_n"]).to_batches()

    kinds = [f"{g} {df.schema[g].dataType.simpleString()}" for g in names]
    ddl = ", ".join([*kinds, "_prefix long", "_digit long", "_n long"])
    rows = df.where(F.col(value).isNotNull()).select(*names, F.col(value).cast("double").alias("_value"))
    parts = rows.mapInArrow(counts, ddl)
    return parts.groupBy(*names, "_prefix", "_digit").agg(F.sum("_n").alias("_n"))


def select_ranks(
    df: DataFrame, group: Sequence[str], value: str, ranks: Callable[[int], Sequence[int]], limit: int = FEW
) -> dict[tuple, tuple[int, dict[int, float]]]:
    """Per group: its rows with a value, and the values at the 0-based ``ranks(rows)``.

    Radix selection: counts by the leading 12 bits of the values' ordered keys tell in which of them each
    rank lies; only values with those bits are counted by the next 12, and so on. When no more than ``limit``
    values are in question their remaining bits are taken at once. Only counts are shuffled, and the driver
    gets 4,096 of them at most for a group and rank. ``df`` is read once a round, six times at most. For a
    bounded number of groups and ranks.
    """
    names = list(group)

    def counted(known: int, digit: int, prefixes: Sequence[int]) -> dict[tuple, list[tuple[int, int]]]:
        """(digit, rows) ascending by group and prefix."""
        out: dict[tuple, list[tuple[int, int]]] = {}
        for r in _digit_counts(df, names, value, known, digit, prefixes).collect():
            out.setdefault((tuple(r[g] for g in names), r["_prefix"]), []).append((r["_digit"], r["_n"]))
        return {k: sorted(v) for k, v in out.items()}

    known, width, counts = 0, DIGIT, counted(0, DIGIT, [0])
    sizes = {g: sum(n for _, n in digits) for (g, _), digits in counts.items()}
    found: dict[tuple, dict[int, float]] = {g: {} for g in sizes}
    # Group, rank asked for, bits known so far, rank among the values with those bits.
    asked = [(g, rank, 0, rank) for g, n in sizes.items() for rank in sorted(set(ranks(n)))]
    while asked:
        held, after = {}, []
        for g, rank, prefix, place in asked:
            for digit, n in counts[g, prefix]:
                if place < n:
                    break
                place -= n
            after.append((g, rank, prefix << width | digit, place))
            held[g, prefix, digit] = n
        asked, known = after, known + width
        if known == KEY_BITS:
            for g, rank, key, _ in asked:
                found[g][rank] = value_of_key(key)
            break
        width = KEY_BITS - known if sum(held.values()) <= limit else min(DIGIT, KEY_BITS - known)
        counts = counted(known, width, [prefix for _, _, prefix, _ in asked])
    return {g: (n, found[g]) for g, n in sizes.items()}


def percentiles(
    df: DataFrame, group: Sequence[str], value: str, points: Sequence[float], limit: int = FEW
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column ``p<point>`` each (2.5: ``p2_5``).

    By `select_ranks`: no table of the values and no task with all values of a group. For a bounded
    number of groups; ``df`` is read a few times, so store it if it is dear.
    """

    def ends(n: int) -> list[int]:
        places = [(n - 1) * (p / 100.0) for p in points]
        return [end for place in places for end in (math.floor(place), math.ceil(place))]

    rows = []
    for g, (n, at) in select_ranks(df, group, value, ends, limit).items():
        cells = []
        for p in points:
            place = (n - 1) * (p / 100.0)
            lo, hi = at[math.floor(place)], at[math.ceil(place)]
            cells.append(lo + (hi - lo) * (place - math.floor(place)))
        rows.append((*g, *cells))
    schema = T.StructType([df.schema[g] for g in group])
    for p in points:
        schema = schema.add(f"p{p}".replace(".", "_"), T.DoubleType())
    return df.sparkSession.createDataFrame(rows, schema)


def stats_summary(stats: DataFrame, limit: int = FEW) -> DataFrame:
    """Mean, std and percentiles of all lead means and of all lead stds (``stat``).

    The two numbers a lead are stored once, so that signals are read once.
    """
    each = [F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in ("mean", "std")]
    kept = store(stats.select(F.inline(F.array(*each))).where("value IS NOT NULL"), "lead-stats")
    overall = kept.groupBy("stat").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return overall.join(percentiles(kept, ["stat"], "value", PERCENTILES, limit), "stat")


def lead_breakdown(stats: DataFrame, names: Sequence[str] = LEADS) -> DataFrame:
    """Per lead: mean and std of its means and of its stds."""
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("lead"))
    return (
        stats.groupBy("lead")
        .agg(
            F.avg("mean").alias("mean_of_means"),
            F.stddev_pop("mean").alias("std_of_means"),
            F.avg("std").alias("mean_of_stds"),
            F.stddev_pop("std").alias("std_of_stds"),
        )
        .withColumn("lead_name", named)
    )


def normalization_verdict(stats: DataFrame) -> DataFrame:
    """Whether the signals look normalised already: mean near 0 and std near 1 overall."""
    offset, stretch = F.abs(F.avg("mean")), F.abs(F.avg("std") - 1.0)
    return stats.agg(offset.alias("mean_offset"), stretch.alias("std_offset")).withColumn(
        "pre_normalized", (F.col("mean_offset") < TOLERANCE) & (F.col("std_offset") < TOLERANCE)
    )
