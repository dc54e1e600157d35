"""Compression of vectors to short codes: one codebook for each part, trained in whole numbers.

A part lies in a cell of a coarse grid. An entry of the codebook that is farther from every point of the
cell's box than another entry cannot be nearest to any of them; the entries that are left are remembered by
the cell's hash, and only they are compared with the parts in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import store
from .words import arrow_schema, batch_of, trimmed

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CELL = 256  # the width of a grid cell, in scaled units
EDGE = 127  # cells at -EDGE and EDGE are open to the outside
LARGEST = 1 << 27  # scaled components are below this, so that squared distances are exact in 64 bits
MEMO_CELLS = 1 << 16  # cells of one part that a task remembers; it starts anew when they are more
ROWS_AT_ONCE = 4096


class Grid:
    """Nearest entries of one part's codebook."""

    def __init__(self, codebook: np.ndarray):
        self.book = codebook  # (entries, width)
        self.memo: dict[bytes, int] = {}
        self.candidates = np.empty((0, len(codebook)), np.int64)  # of each remembered cell, ascending
        self.counts = np.empty(0, np.int64)
        # Squared distances of a box along one axis, by axis, place of the cell and entry: of its near and far side.
        low = (np.arange(-EDGE, EDGE + 1) * CELL)[None, :, None]
        high, entry = low + CELL - 1, codebook.T[:, None, :]
        gap = np.maximum(np.maximum(low - entry, entry - high), 0)
        reach = np.maximum(np.abs(entry - low), np.abs(high - entry))
        self.near, self.far = gap * gap, reach * reach

    def candidates_of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries not dominated across the box of each cell, first in the row, and how many they are.

        An entry goes if its least distance to the box is above the smallest greatest distance; of equal ones
        both stay, so ties are decided by the exact comparison.
        """
        place = cells.astype(np.int64) + EDGE
        least = sum(side[place[:, axis]] for axis, side in enumerate(self.near))
        greatest = sum(side[place[:, axis]] for axis, side in enumerate(self.far))
        held = least <= greatest.min(axis=1, keepdims=True)
        held[(np.abs(cells) >= EDGE).any(axis=1)] = True  # a box without an end
        order = np.cumsum(held, axis=1) - 1
        entries = np.zeros(held.shape, np.int64)
        cell, entry = np.nonzero(held)
        entries[cell, order[cell, entry]] = entry
        return entries, held.sum(axis=1)

    def rows_of(self, cells: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """Where the candidates of each of the (distinct) cells stand; new cells are added."""
        if len(self.memo) + len(keys) > MEMO_CELLS:
            self.memo.clear()
            self.candidates, self.counts = self.candidates[:0], self.counts[:0]
        new = [i for i, k in enumerate(keys) if k not in self.memo]
        if new:
            entries, counts = self.candidates_of(cells[new])
            self.memo.update(zip([keys[i] for i in new], range(len(self.counts), len(self.counts) + len(new))))
            self.candidates = np.concatenate([self.candidates, entries])
            self.counts = np.concatenate([self.counts, counts])
        return np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part; of equal distances the lower entry."""
        n, width = parts.shape
        cells = np.clip(parts // CELL, -EDGE, EDGE).astype(np.int8)
        whole = np.ascontiguousarray(cells).view(np.dtype((np.void, width))).reshape(n)
        _, first, of = np.unique(whole, return_index=True, return_inverse=True)
        row = self.rows_of(cells[first], whole[first].tolist())[of]
        best, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        counts = self.counts[row]
        for k in range(int(counts.max(initial=0))):
            left = np.flatnonzero(counts > k)
            entry = self.candidates[row[left], k]
            apart = parts[left] - self.book[entry]
            distance = (apart * apart).sum(axis=1)
            nearer = distance < least[left]
            at = left[nearer]
            best[at], least[at] = entry[nearer], distance[nearer]
        return best, least


def whole_numbers(vector: Column | str) -> Column:
    """floor(4096 x) of each component; null if the vector or a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = vector.isNotNull() & ~F.exists(vector, bad)
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width) of a column of lists of one length."""
    cells = column.flatten().to_numpy(zero_copy_only=False)
    if len(cells) and np.abs(cells).max() >= LARGEST:
        raise ValueError(f"a component is not between {-LARGEST} and {LARGEST} after scaling by {SCALE}")
    return cells.reshape(len(column), parts, -1)


def _sums(books: list[np.ndarray]):
    """For each part and entry: how many parts it is nearest to, and their sums by component."""
    schema = arrow_schema("part int, entry int, at int, n long, total long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                vectors = _matrix(batch.column(0).slice(start, ROWS_AT_ONCE), len(books))
                for p, grid in enumerate(grids):
                    entry, _ = grid.nearest(vectors[:, p])
                    n[p] += np.bincount(entry, minlength=len(n[p]))
                    np.add.at(totals[p], entry, vectors[:, p])
        rows = [
            (p, e, at, int(n[p][e]), int(totals[p][e, at]))
            for p in range(len(books))
            for e in np.flatnonzero(n[p]).tolist()
            for at in range(totals[p].shape[1])
        ]
        if rows:
            yield batch_of(rows, schema)

    return run


def _codes(books: list[np.ndarray], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                vectors = _matrix(part.column(2), len(books))
                found = [grid.nearest(vectors[:, p]) for p, grid in enumerate(grids)]
                code = np.stack([f[0] for f in found], axis=1).astype(np.int32)
                ends = np.arange(0, code.size + 1, len(books), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(code.reshape(-1)))
                error = pa.array(np.sum([f[1] for f in found], axis=0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, error], schema=schema)

    return run


def kept_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS
) -> DataFrame:
    """(id, label, v array<long>) of the rows that count, stored: vectors of finite numbers, as long as the
    one of the least id and label and of a length that the parts divide."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_numbers(vector_col).alias("v"))
    kept = store(rows.where("v IS NOT NULL"), "vectors")
    first = kept.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v").alias("n")).first()
    if first is None or first["n"] == 0 or first["n"] % parts:
        return kept.where("false")
    return kept.where(F.size("v") == first["n"])


def train_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One (entries, width) table of whole numbers for each part; none for an empty table.

    Starts from the vectors of the least ids (nulls last, equal ids by vector); fewer vectors than entries
    make a smaller codebook. Each round is one job over all vectors, of which a task sends one row for each
    entry and component; the codebooks come to the driver, the vectors never do.
    """
    least = kept.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    if not least:
        return []
    start = np.array([r["v"] for r in least], np.int64)
    if np.abs(start).max() >= LARGEST:
        raise ValueError(f"a component is not between {-LARGEST} and {LARGEST} after scaling by {SCALE}")
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(trimmed(_sums(books)), "part int, entry int, at int, n long, total long")
        means = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [b.copy() for b in books]
        for r in means.collect():
            books[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def encode_vectors(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code array<int>, error): the nearest entry of each part and the summed squared distances."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    ddl = f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long"
    if not books:
        return kept.sparkSession.createDataFrame([], ddl)
    return kept.select("id", "label", "v").mapInArrow(trimmed(_codes(books, arrow_schema(ddl))), ddl)


def label_errors(encoded: DataFrame) -> DataFrame:
    """(label, label_error): the errors summed over equal labels, nulls together."""
    return encoded.groupBy("label").agg(F.sum("error").alias("label_error"))


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, label_error) of the vectors that count, and the codebooks.

    Vectors that are null, hold a null or a number that is not finite, or differ in length from the vector of
    the least id are left out. Components become floor(4096 x), and all sums and distances are exact. Rows with
    equal ids or vectors count each; null ids come last and stay null; null labels are one label. An empty
    table, or a length that the parts do not divide, gives an empty result and no codebooks.
    """
    kept = kept_vectors(vectors, id_col, vector_col, label_col, parts)
    books = train_codebooks(kept, parts, entries, rounds)
    encoded = store(encode_vectors(kept, books), "vector-codes")
    sums = store(label_errors(encoded).withColumnRenamed("label", "_label"), "label-errors")
    summed = encoded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return summed.select("id", "label", "code", "error", "label_error"), books
