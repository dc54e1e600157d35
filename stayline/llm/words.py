"""Word splitting inside tasks, on the bytes of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and all of a non-ASCII character.
ALNUM = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then maximal runs of digits, a-z and non-ASCII characters; none for null."""
    return text.lower().translate(ALNUM).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then maximal runs of anything but the six ASCII white-space characters."""
    return text.lower().split() if text else []


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class Numbering(dict):
    """Numbers new words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(words: list[bytes], numbers: dict) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def in_shards(
    batches: Iterator[pa.RecordBatch], text: int, split: Callable, most: int
) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(rows, words of each row) over the batches, cut before a shard grows above `most` words. A row is never cut."""
    rows, words, n = [], [], 0
    for batch in batches:
        columns = [texts_of(c) if i == text else c.to_pylist() for i, c in enumerate(batch.columns)]
        for row in zip(*columns):
            of_row = split(row[text])
            if rows and n + len(of_row) > most:
                yield rows, words
                rows, words, n = [], [], 0
            rows.append(row)
            words.append(of_row)
            n += len(of_row)
    if rows:
        yield rows, words


def trimmed(run: Callable) -> Callable:
    """A task function that gives its freed memory back at its end: Python workers live on for the tasks of
    other stages, and share the executor's memory with its heap."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
