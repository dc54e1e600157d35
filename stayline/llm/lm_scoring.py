"""Cross-entropy difference of a target and a background n-gram model that share one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import arrow_schema, batch_of, trimmed

#: The vocabulary of both models: the 256 values of a byte of UTF-8. A text starts after two zero bytes.
VOCABULARY = 256
GRAMS = VOCABULARY**3
#: Pseudo-count of the shorter context in the longer one's estimate.
BACKOFF = 16.0
#: Bytes that a task looks at together; a longer text is looked at alone.
SLICE = 4 << 20


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, trigram at each byte, length of each text) of parts of a column of text. Null is empty."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        part = data[offsets[first] : offsets[last]].astype(np.int32)
        starts = offsets[first:last] - offsets[first]
        one, two = np.zeros_like(part), np.zeros_like(part)
        one[1:], two[2:] = part[:-1], part[:-2]
        inside = starts[starts < len(part)]
        one[inside] = two[inside] = 0
        two[inside[inside + 1 < len(part)] + 1] = 0
        yield first, last - first, (two << 16) | (one << 8) | part, np.diff(offsets[first : last + 1])
        first = last


def gram_counter(schema: pa.Schema):
    """(gram, target, background) counts of a partition from rows (text, is target)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, GRAMS), np.int64)
        for batch in batches:
            wanted = np.array(batch.column(1).to_pylist(), bool)
            for first, n, grams, lengths in slices(batch.column(0)):
                for model, on in ((0, np.repeat(wanted[first : first + n], lengths)), (1, slice(None))):
                    once, count = np.unique(grams[on], return_counts=True)
                    counts[model, once] += count
        met = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[0, met]), pa.array(counts[1, met])], schema=schema)

    return run


def losses(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """-log P(byte | two bytes before) of each gram, from counts that may be scaled.

    Each order adds `BACKOFF` pseudo-counts of the next lower one; single bytes add one for each value.
    """
    counts = counts.astype(np.float64)

    def summed(keys: np.ndarray) -> np.ndarray:
        _, at = np.unique(keys, return_inverse=True)
        return np.bincount(at, counts)[at] if len(keys) else counts

    last, middle = grams & 255, (grams >> 8) & 255
    p = (summed(last) + 1) / (counts.sum() + VOCABULARY)
    p = (summed(grams & 0xFFFF) + BACKOFF * p) / (summed(middle) + BACKOFF)
    p = (counts + BACKOFF * p) / (summed(grams >> 8) + BACKOFF)
    return -np.log(p)


def scorer(grams: np.ndarray, target: np.ndarray, background: np.ndarray, schema: pa.Schema):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.zeros(GRAMS, np.int32)
        at[grams] = np.arange(len(grams))
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, n, keys, lengths in slices(batch.column(1)):
                place = at[keys]
                ends = np.cumsum(lengths)
                total = [np.zeros(n), np.zeros(n)]
                full = np.flatnonzero(lengths)
                for t, x in zip(total, (target, background)):
                    if len(full):
                        t[full] = np.add.reduceat(x[place], (ends - lengths)[full])
                size = np.maximum(lengths, 1)
                out += zip(ids[first : first + n], lengths.tolist(), (total[0] / size).tolist(), (total[1] / size).tolist())
            yield batch_of(out, schema)

    return run


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) for each row of `docs`.

    Both models are byte trigram models with the same vocabulary, orders and smoothing. The background
    counts all documents; the target counts those that `labels` (id, quality, toxic) mark good and not
    toxic in each of their rows, nulls ignored. Background counts are scaled to the target's total, so
    that smoothing weighs alike. Losses are means of -log P over the bytes; score is the mean of the
    differences, target less background: the lower, the nearer the target.

    A model holds at most 256^3 grams by its vocabulary, whatever the corpus, which bounds what the
    driver gathers and the tasks get; counts of all documents are summed by Spark. Without target
    documents both models are uniform and the score is 0. Null and empty texts have no tokens, losses
    and score 0. Repeated rows count and are scored each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = good.where("quality = 1 AND coalesce(toxic, 0) = 0").select("id", F.lit(True).alias("good"))
    # labels grow with the documents, so they meet them by a merge join at every size
    marked = rows.join(good.hint("merge"), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ddl = "gram int, target long, background long"
    counted = marked.mapInArrow(gram_counter(arrow_schema(ddl)), ddl).groupBy("gram")
    model = counted.agg(F.sum("target").alias("target"), F.sum("background").alias("background")).orderBy("gram").toArrow()
    grams, target, background = (model[c].to_numpy() for c in ("gram", "target", "background"))
    scale = target.sum() / max(1, background.sum())
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double"
    score = scorer(grams, losses(grams, target), losses(grams, background * scale), arrow_schema(ddl))
    scored = rows.mapInArrow(score, ddl)
    return scored.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "target_loss",
        "background_loss",
        (F.col("target_loss") - F.col("background_loss")).alias("score"),
    )
