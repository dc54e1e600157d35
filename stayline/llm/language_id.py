"""Language ID: a bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store
from .mixing import draw, low_bits
from .recurrent import Adam, Both, Gated, softmax
from .words import arrow_schema, batch_of, texts_of, trimmed

UNDETERMINED = "und"

#: The sample that the network learns from: documents of a language, and windows and bytes of a document.
SAMPLE_DOCS, SAMPLE_WINDOWS, TRAIN_BYTES = 256, 12, 48
HIDDEN, STEPS, BATCH, RATE = 8, 400, 192, 0.02
#: Bytes of a window that are labelled, and of context read on either side of them.
CORE, CONTEXT = 112, 8
#: Windows run side by side, and rows held as Python objects.
TOGETHER, ROWS_AT_ONCE = 2048, 1000

LETTER = np.array([(65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(id_col: str) -> Column:
    """The documents kept from learning: crc32 of the id as text, modulo 4, is 2. A null id is none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def window_sampler(schema: pa.Schema, windows: int, size: int):
    """(lang, order, bytes) for evenly spread windows of whole texts: as many, fewer in short texts."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, order, text in zip(*(c.to_pylist() for c in batch.columns[:2]), texts_of(batch.column(2))):
                last = max(0, len(text) - size)
                starts = sorted({round(x) for x in np.linspace(0, last, min(windows, last // size + 1))})
                out += [(lang, f"{order}:{i:04d}", text[s : s + size]) for i, s in enumerate(starts)]
            yield batch_of(out, schema)

    return run


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, seed: int):
    """Windows with their languages from at most `per_language` documents of each, chosen by a keyed hash.

    A threshold on the hash brings each language down to a few times its share before anything is ranked.
    """
    rows = docs.where(
        F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.rlike(text_col, F.lit(r"\p{L}"))
    ).select(F.col(lang_col).alias("lang"), draw(seed, F.col(id_col)).alias("order"), F.col(text_col).alias("text"))
    # stored, so that its size is known and no text moves to meet it
    counts = store(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    near = rows.join(counts, "lang").where(low_bits(F.col("order")) < F.lit(4 * per_language) / F.col("n") * (1 << 32))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", F.md5("text"))))
    ddl = "lang string, order string, window binary"
    sample = ranked.where(F.col("rank") <= per_language).select("lang", "order", "text")
    return sample.mapInArrow(window_sampler(arrow_schema(ddl), SAMPLE_WINDOWS, TRAIN_BYTES), ddl).toArrow()


def as_matrix(windows: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, windows) and where there are any."""
    x = np.zeros((len(windows), size), np.uint8)
    lengths = np.array([len(w) for w in windows], np.int64)
    x[np.arange(size) < lengths[:, None]] = np.frombuffer(b"".join(windows), np.uint8)
    return np.ascontiguousarray(x.T), (np.arange(size)[:, None] < lengths).astype(np.float32)


class Tagger:
    """The network: states of both directions, then a softmax over languages at each position."""

    def __init__(self, languages: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.layer = Both(Gated, 256, hidden, rng)
        self.w = rng.normal(0, 0.1, (len(languages), 2 * hidden)).astype(np.float32)
        self.b = np.zeros((len(languages), 1), np.float32)

    def fit(self, windows: list[bytes], targets: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> Tagger:
        """Cross-entropy at every position; each batch draws languages evenly."""
        rng = np.random.default_rng(seed)
        x, on = as_matrix([w.lower() for w in windows], TRAIN_BYTES)
        by_language = [np.flatnonzero(targets == k) for k in range(len(self.languages))]
        adam = Adam([*self.layer.weights(), self.w, self.b], rate)
        for step in range(steps):
            adam.rate = rate * (1 - step / steps) + 0.001
            chosen = np.array([rng.choice(by_language[k]) for k in rng.integers(len(by_language), size=batch)])
            xs, mask = x[:, chosen], on[:, chosen]
            states, backward = self.layer.learn(xs, mask)
            p = softmax(self.w @ states + self.b, 1)
            p[:, targets[chosen], np.arange(batch)] -= 1
            p *= (mask / mask.sum())[:, None]
            dw = np.einsum("tkn,thn->kh", p, states)
            adam.step([*backward(np.einsum("kh,tkn->thn", self.w, p)), dw, p.sum(axis=(0, 2))[:, None]])
        return self

    def windows(self, x: np.ndarray, on: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Sums of the probabilities at the counted positions: (languages, windows)."""
        ahead, back = self.layer.run(x, on)
        k = ahead.shape[1]
        logits = np.matmul(self.w[:, :k], ahead)
        logits += np.matmul(self.w[:, k:], back)
        logits += self.b
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (counted / logits.sum(axis=1))[:, None]
        return logits.sum(axis=0, dtype=np.float64)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the letters of each whole text: (texts, languages)."""
        sums = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts))
        size = CORE + 2 * CONTEXT
        padded = b"\0" * CONTEXT + (b"\0" * size).join(t.lower() for t in texts) + b"\0" * size
        data = np.frombuffer(padded, np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = CONTEXT + np.cumsum(lengths + size) - lengths - size
        count = -(-lengths // CORE)
        of = np.repeat(np.arange(len(texts)), count)
        core = starts[of] + CORE * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        end = starts[of] + lengths[of]
        offset = np.arange(-CONTEXT, CORE + CONTEXT)[:, None]
        for a in range(0, len(of), TOGETHER):
            at = core[a : a + TOGETHER] + offset
            x = data[at]
            on = ((at >= starts[of[a : a + TOGETHER]]) & (at < end[a : a + TOGETHER])).astype(np.float32)
            counted = on * LETTER[x] * ((offset >= 0) & (offset < CORE))
            np.add.at(sums, of[a : a + TOGETHER], self.windows(x, on, counted).T)
            np.add.at(letters, of[a : a + TOGETHER], counted.sum(axis=0))
        return sums / np.maximum(letters, 1)[:, None]


def train(windows: pa.Table, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 3) -> Tagger | None:
    windows = windows.sort_by([("lang", "ascending"), ("order", "ascending"), ("window", "ascending")])
    names = windows["lang"].to_pylist()
    if not names:
        return None
    languages = sorted(set(names))
    targets = np.array([languages.index(n) for n in names])
    return Tagger(languages, hidden, seed).fit(windows["window"].to_pylist(), targets, steps, BATCH, RATE, seed)


def predicted(tagger: Tagger | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text; parts of about 4 MB are read together."""
    out = [(UNDETERMINED, 0.0)] * len(texts)
    known = [k for k, t in enumerate(texts) if tagger and has_letter(t)]
    at = 0
    while at < len(known):
        upto, n = at, 0
        while upto < len(known) and (upto == at or n + len(texts[known[upto]]) < 4 << 20):
            n += len(texts[known[upto]])
            upto += 1
        part = known[at:upto]
        for k, p in zip(part, tagger.pooled([texts[k].encode() for k in part])):
            best = int(p.argmax())
            out[k] = (tagger.languages[best], float(min(1.0, p[best])))
        at = upto
    return out


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def predictor(tagger: Tagger | None, schema: pa.Schema):
    """Predictions for rows (id, held_out, text)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, held, texts = (c.to_pylist() for c in batch.columns)
            yield batch_of([(i, h, *found) for i, h, found in zip(ids, held, predicted(tagger, texts))], schema)

    return run


def row_filter(tagger: Tagger | None, text: int, min_score: float):
    """Batches less their rejected rows."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = predicted(tagger, batch.column(text).to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in found], pa.bool_()))

    return run


def keep_identified(
    docs: DataFrame,
    min_score: float = 0.4,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_DOCS,
    seed: int = 3,
) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language of at least `min_score`; see `identify_languages`."""
    tagger = train(training_windows(docs, id_col, text_col, lang_col, per_language, seed), seed=seed)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = plain.mapInArrow(row_filter(tagger, docs.columns.index(text_col), min_score), plain.schema)
    return kept.toDF(*docs.columns)


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_DOCS,
    seed: int = 3,
) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of `docs`.

    The network learns from windows of at most `per_language` documents of each language, none of them
    held out (crc32 of the id as text, modulo 4, is 2) or without id, language or letter. It reads a
    text's bytes, A-Z lower-cased, in windows with context on both sides and labels each position; the
    mean of the probabilities over all letters of the whole text decides. score is that of `lang_pred`;
    of equals the language first in code point order wins.

    Null texts and texts without a letter are `und` with score 0, as are all without any labelled text.
    Rows are predicted each, from their text alone; a null id is not held out and not learned from.
    """
    tagger = train(training_windows(docs, id_col, text_col, lang_col, per_language, seed), seed=seed)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(predictor(tagger, arrow_schema(ddl)), ddl).withColumnRenamed("id", id_col)
