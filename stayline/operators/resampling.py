"""Bootstrap counts from a tree of row ranges: no draw is made or moved for itself.

A resample of n rows with replacement gives a range of rows a number of draws; of these the left half gets
a binomial number, the right half the rest, and so on down to single rows. Each split is fixed by the seed, the
replicate and the range, so whichever task makes it, it is the same. Binomial numbers are exact and
need whole numbers only: a draw goes left if its random bits, read as a fraction, are below the share of the left
half. All draws of a range are compared bit by bit together, 64 of them in a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 1_024  # rows of the ranges that a task splits down to single rows
DEPTH = 6  # levels that a task splits larger ranges by
SLAB = 1 << 16  # words of random bits made at once

# Odd factors that spread the parts of a key, and the rounds of mixing 64 bits.
SPREAD = {"seed": 0x9E3779B97F4A7C15, "replicate": 0xD1342543DE82EF95, "node": 0xAF251AF3B0F025B5, "step": 0xC6BC279692B5CC83, "word": 0xDA942042E4DD58B5}
ROUNDS = [(30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)]
LAST_SHIFT = 31
WORD_BITS = 64


def _u64(x) -> np.ndarray:
    return np.asarray(x).astype(np.uint64)


def _mixed(key: np.ndarray) -> np.ndarray:
    for shift, factor in ROUNDS:
        key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
    return key ^ (key >> np.uint64(LAST_SHIFT))


def _ones(trials: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many of the next random bits, one for each trial, are 1."""
    out = np.zeros(len(trials), np.int64)
    words = -(-trials // WORD_BITS)
    ends = np.cumsum(words)
    for start in range(0, int(ends[-1]) if len(ends) else 0, SLAB):
        at = np.arange(start, min(start + SLAB, int(ends[-1])))
        which = np.searchsorted(ends, at, "right")
        word = at - (ends[which] - words[which])
        left = np.minimum(trials[which] - word * WORD_BITS, WORD_BITS).astype(np.uint64)
        bits = _mixed(key[which] + _u64(word) * np.uint64(SPREAD["word"]))
        out += np.bincount(which, np.bitwise_count(bits >> (np.uint64(WORD_BITS) - left)), len(trials)).astype(np.int64)
    return out


def left_draws(count: np.ndarray, left: np.ndarray, size: np.ndarray, replicate: np.ndarray, node: np.ndarray, seed: int) -> np.ndarray:
    """How many of ``count`` draws among ``size`` rows fall on the first ``left`` of them: binomial, exactly."""
    key = _u64(seed % (1 << 32)) * np.uint64(SPREAD["seed"]) + _u64(replicate) * np.uint64(SPREAD["replicate"])
    key = key + _u64(node) * np.uint64(SPREAD["node"])
    open_, rest, won = count.copy(), left.copy(), np.zeros(len(count), np.int64)
    step = 0
    while len(go := np.flatnonzero((open_ > 0) & (rest > 0))):
        rest[go] *= 2  # the next bit of left / size
        bit = rest[go] >= size[go]
        rest[go] -= bit * size[go]
        ones = _ones(open_[go], key[go] + np.uint64(step * SPREAD["step"] & (1 << 64) - 1))
        zeros = open_[go] - ones
        won[go] += np.where(bit, zeros, 0)
        open_[go] = np.where(bit, ones, zeros)
        step += 1
    return won


def left_size(size: np.ndarray) -> np.ndarray:
    """Rows of the left half: the largest power of two below the size."""
    return np.int64(1) << (np.frexp(size.astype(np.float64) - 1)[1].astype(np.int64) - 1)


def _split(ranges: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """Halves of the ranges (replicate, node, first, size, count) that have draws."""
    replicate, node, first, size, count = ranges
    half = left_size(size)
    won = left_draws(count, half, size, replicate, node, seed)
    both = [
        np.concatenate([replicate, replicate]),
        np.concatenate([2 * node, 2 * node + 1]),
        np.concatenate([first, first + half]),
        np.concatenate([half, size - half]),
        np.concatenate([won, count - won]),
    ]
    drawn = both[4] > 0
    return [x[drawn] for x in both]


NAMES = ["replicate", "node", "first", "size", "count"]


def _expand(seed: int, until: int, depth: int) -> Callable:
    """Splits ranges above ``until`` rows, at most ``depth`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(NAMES))]
            for _ in range(depth):
                large = ranges[3] > until
                if not large.any():
                    break
                halves = _split([x[large] for x in ranges], seed)
                ranges = [np.concatenate([x[~large], h]) for x, h in zip(ranges, halves)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ranges], names=NAMES)

    return run


def _leaves(seed: int, kind: pa.DataType) -> Callable:
    """Blocks with all their replicates to (pos, held): the replicates that hold a row, as often as they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                ranges = [np.array([r[n] for r in block], np.int64) for n in NAMES]
                while (large := ranges[3] > 1).any():
                    halves = _split([x[large] for x in ranges], seed)
                    ranges = [np.concatenate([x[~large], h]) for x, h in zip(ranges, halves)]
                replicate, _, first, _, count = ranges
                order = np.lexsort((replicate, first))
                pos, starts = np.unique(first[order], return_index=True)
                held = np.repeat(replicate[order], count[order])
                drawn = np.add.reduceat(count[order], starts) if len(pos) else np.empty(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(drawn)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(held, kind))
                yield pa.RecordBatch.from_arrays([pa.array(pos), lists], names=["pos", "held"])

    return run


def held_positions(positions: DataFrame, replicates: int, seed: int, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """(pos, held): for each position 0..n-1 that any replicate draws, the replicates as often as they draw it.

    Shuffled are the ranges of ``block`` rows, one for each replicate, and never a draw. Every replicate's
    counts add up to n.
    """
    n, spark = positions.count(), positions.sparkSession
    number = "smallint" if replicates < 2**15 else "int"
    ddl = ", ".join(f"{x} long" for x in NAMES)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = spark.range(0, replicates if n else 0, 1, min(tasks, replicates)).selectExpr(
        "id AS replicate", "1L AS node", "0L AS first", f"{n}L AS size", f"{n}L AS count"
    )
    levels = max(0, (max(n, 1) - 1).bit_length() - (block.bit_length() - 1))
    for done in range(0, levels, depth):
        if done:
            ranges = ranges.repartition("replicate", "first")
        ranges = ranges.mapInArrow(_expand(seed, block, depth), ddl)
    blocks = ranges.groupBy("first").agg(F.collect_list(F.struct(*NAMES)).alias("block"))
    kind = pa.int16() if number == "smallint" else pa.int32()
    return blocks.select("block").mapInArrow(_leaves(seed, kind), f"pos long, held array<{number}>")
