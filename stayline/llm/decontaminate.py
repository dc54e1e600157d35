"""Benchmark decontamination: an FM-index per shard of documents, searched for the phrases of the benchmark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fm_index import FMIndex
from .words import Numbering, alnum_words, arrow_schema, batch_of, in_shards, numbered, texts_of, trimmed

#: What one phrase block may hold: it travels to every task.
BLOCK_PHRASES = 250_000

PHRASES = "phrase binary, items array<string>"
HITS = "id {id}, digest string, n_words long, spans array<struct<first:int,last:int>>, items array<string>"


def phrases_of(window: int):
    """Windows of `window` consecutive words of each item (id, text); fewer words are one window."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("phrase", pa.binary()), ("item", pa.string())])
        for batch in batches:
            rows = set()
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words = alnum_words(text)
                rows |= {(b" ".join(words[i : i + window]), item) for i in range(max(1, len(words) - window + 1)) if words}
            yield batch_of(sorted(rows, key=lambda r: (r[0], r[1] or "")), schema)

    return run


class Phrases:
    """A block of phrases, ready to be looked up in any shard."""

    def __init__(self, phrases: list[bytes], items: list[list[str]]):
        self.items = items
        words = [p.split(b" ") for p in phrases]
        self.lengths = np.array([len(w) for w in words], np.int64)
        numbers = Numbering()
        self.width = int(self.lengths.max(initial=0))
        self.rows = np.full((len(words), self.width), -1, np.int64)
        for row, w in zip(self.rows, words):
            row[self.width - len(w) :] = [numbers[x] for x in w]
        self.vocabulary = list(numbers)

    def numbered_by(self, numbers: dict) -> tuple[np.ndarray, np.ndarray]:
        """Phrases all of whose words the shard has, in the shard's numbers, and which they are."""
        of = np.array([numbers.get(w, -1) for w in self.vocabulary] + [0], np.int64)
        rows = of[self.rows]
        which = np.flatnonzero((rows >= 0).all(axis=1)) if len(rows) else np.empty(0, np.int64)
        return rows[which], which


def find_hits(words: list[list[bytes]], phrases: Phrases) -> tuple[list[np.ndarray], list[set[int]]]:
    """For each text: its hit words as a mask, and the phrases that occur in it."""
    numbers = Numbering()
    numbers[b""] = 0
    numbers[b" "] = 1  # between texts; no word has a blank
    parts, starts, at = [], [], 0
    for w in words:
        parts += [numbered(w, numbers), np.ones(1, np.int64)]
        starts.append(at)
        at += len(w) + 1
    starts = np.array(starts, np.int64)
    cover, found = np.zeros(at + 1, np.int64), [set() for _ in words]
    rows, which = phrases.numbered_by(numbers)
    if len(which):
        index = FMIndex(np.concatenate(parts))
        low, high = index.search(rows, phrases.lengths[which])
        count = high - low
        hit = np.repeat(np.arange(len(which)), count)
        suffixes = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[hit]
        position = index.locate(suffixes)
        np.add.at(cover, position, 1)
        np.add.at(cover, position + phrases.lengths[which][hit], -1)
        text = np.searchsorted(starts, position, "right") - 1
        for pair in np.unique(text * len(phrases.items) + which[hit]).tolist():
            found[pair // len(phrases.items)].add(pair % len(phrases.items))
    covered = np.cumsum(cover)[:-1] > 0
    return [covered[s : s + len(w)] for s, w in zip(starts, words)], found


def spans_of(mask: np.ndarray) -> list[dict]:
    """Runs of hit words, which merge overlapping and touching occurrences; last word included."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def searcher(phrases: Phrases, schema: pa.Schema, shard_words: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in in_shards(batches, 2, alnum_words, shard_words):
            # equal texts of a shard are indexed once
            once = {row[1]: i for i, row in enumerate(rows)}
            masks, found = find_hits([words[i] for i in once.values()], phrases)
            by_digest = dict(zip(once, zip(masks, found)))
            out = []
            for row, w in zip(rows, words):
                mask, hits = by_digest[row[1]]
                items = sorted({x for p in hits for x in phrases.items[p]})
                out.append((row[0], row[1], len(w), spans_of(mask), items))
            yield batch_of(out, schema)

    return run


def benchmark_phrases(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(phrase, items): each distinct window with the ids of the items it is from.

    An item without an id has windows too, which stand in no list of ids; null texts give none.
    """
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col))
    windows = rows.mapInArrow(phrases_of(window), "phrase binary, item string")
    return windows.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shard_words: int = 1 << 19,
    block_phrases: int = BLOCK_PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """(id, digest, n_words, spans, items) for each row of `docs`.

    Words are lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters. `spans` are the
    merged runs of words inside any occurrence of a benchmark window, `items` the ids of the items
    whose windows occur, as sorted strings; `digest` is the MD5 of the text. Windows of items without an
    id hit words like any others; such an item is not listed.

    Phrases are searched in blocks of at most `block_phrases`, so what a task gets is bounded; with
    several blocks their hits are merged by document. Each task cuts its documents into shards of about
    `shard_words` words (a longer text is a shard of its own) and builds one index for each.

    Null and empty texts have no words. Rows with equal id and text are one document to the merge and
    keep their number. An empty benchmark hits nothing; empty documents give no rows.
    """
    phrases = benchmark_phrases(benchmark, window, item_col, text_col)
    blocks = max(1, -(-phrases.count() // block_phrases))
    phrases = phrases.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"),
        F.col(text_col).alias("text"),
    )
    hits = HITS.format(id=rows.schema["id"].dataType.simpleString())
    schema = arrow_schema(hits)
    found = None
    for block in range(blocks):
        own = phrases.where(F.col("block") == block).select("phrase", "items").toArrow()
        search = searcher(Phrases(own["phrase"].to_pylist(), own["items"].to_pylist()), schema, shard_words)
        part = rows.mapInArrow(search, hits)
        found = part if found is None else found.unionAll(part)
    return found if blocks == 1 else _merged(found, blocks)


def _merged(found: DataFrame, blocks: int) -> DataFrame:
    """One row for each document from the rows of the blocks, repeated documents as often as before."""
    words = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(s["first"], s["last"]))))
    rows = found.groupBy("id", "digest", "n_words").agg(
        F.sort_array(words).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / blocks).cast("int").alias("copies"),
    )
    before = F.concat(F.array(F.lit(-2)), F.slice("hit", F.lit(1), F.greatest(F.size("hit") - 1, F.lit(0))))
    after = F.slice("hit", F.lit(2), F.greatest(F.size("hit"), F.lit(1)))
    pick = lambda x: x.isNotNull()
    firsts = F.filter(F.zip_with("hit", before, lambda a, b: F.when(a != b + 1, a)), pick)
    lasts = F.filter(F.zip_with("hit", after, lambda a, b: F.when(a + 1 != F.coalesce(b, F.lit(-9)), a)), pick)
    spans = F.zip_with(firsts, lasts, lambda a, b: F.struct(a, b)).cast("array<struct<first:int,last:int>>")
    return rows.select("id", "digest", "n_words", spans.alias("spans"), "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def cutter(text: int, spans: int):
    """Replaces texts by what is left outside their spans of words."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, cut in enumerate(batch.column(spans).to_pylist()):
                if cut:
                    texts[i] = without_words(texts[i], cut)
            columns = [pa.array(texts, batch.column(i).type) if i == text else c for i, c in enumerate(batch.columns)]
            names = [n for i, n in enumerate(batch.schema.names) if i != spans]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(columns) if i != spans], names=names)

    return run


def without_words(text: str, spans: list[dict]) -> str:
    """`text` without its words first..last of each span and what stands between them."""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    left, at = [], 0
    for s in spans:
        left.append(text[at : places[s["first"]][0]])
        at = places[s["last"]][1]
    return "".join([*left, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` with the hit spans cut from their texts; all columns and rows stay.

    Spans meet their documents by id and text digest. Texts without hits, null ones among them, stay as they are.
    """
    found = find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("size(spans) > 0")
    spans = found.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "spans").dropDuplicates(["_id", "_digest"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    digest = F.md5(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")))
    joined = rows.withColumn("_key", digest).join(
        spans, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest")), "left"
    )
    flat = joined.select(*[F.col(f"_row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("spans").alias("_spans"))
    position = docs.columns.index(text_col)
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return flat.mapInArrow(cutter(position, len(docs.columns)), fields).toDF(*docs.columns)
