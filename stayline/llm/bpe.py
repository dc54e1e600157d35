"""Byte-level BPE: a segment tree over the ranks of adjacent pairs finds each merge.

The tokenizer file is read once by the driver and sent to the tasks; its size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .words import trimmed

NONE = 1 << 62  # the rank of a pair that does not merge
PLACE_BITS = 32
MEMO_CHARS = 3_000_000  # characters of words whose ids a Python worker remembers; it starts anew when they are more
WORDS_AT_ONCE = 200_000  # words of texts in hand; the new ones among them are merged together
TEXT_AT_ONCE = 1 << 20  # words of longer texts come in portions
SIZES = (1, 2, 4, 8, 16, 32, 64)  # leaves of the trees that are merged together; longer words are merged one by one
ROWS_AT_ONCE = 512

# The endings that are words of their own, and the word pattern of byte-level BPE.
ENDINGS = r"'s|'t|'re|'ve|'m|'ll|'d"
WORDS = ENDINGS + r"| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"

# Code points that are letters or numbers only since Unicode 17, which the tokenizer library's
# character tables do not know: to them they are neither. The installed `regex` knows them.
YOUNG = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8
16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed
1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself where it is printable and no
    blank, else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """Encodes text and decodes ids by a tokenizer file of byte-level BPE."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or before != before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("not a file of byte-level BPE without prefix")
        if not plain or spec["normalizer"] or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("the file asks for steps that are not supported")
        byte_of, vocab = byte_characters(), model["vocab"]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << PLACE_BITS | vocab[right]] = rank, vocab[left + right]
        keys = np.array(sorted(self.merges), np.int64)
        self.pair_keys = np.append(keys, np.int64(-1))
        self.pair_ranks = np.array([self.merges[k][0] << PLACE_BITS for k in keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([new for _, new in sorted(self.merges.values())], np.int64)
        self.byte_id = [vocab.get(c) for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        contents = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            contents[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            contents[i] = token.encode()
        self.contents = pa.array(contents, pa.large_binary())
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split
        self.special_ids = {t: np.int32(i).tobytes() for t, i in self.special.items()}
        self.ascii_words = re.compile(WORDS.format(letter="[A-Za-z]", number="[0-9]", other=r"[^\sA-Za-z0-9]"), re.ASCII)
        young = "".join("-".join(f"\\U{int(c, 16):08x}" for c in run.split("-")) for run in YOUNG.split())
        letter, number, other = rf"[\p{{L}}--[{young}]]", rf"[\p{{N}}--[{young}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{young}]]"
        old = WORDS.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]")
        self.young = regex.compile(f"[{young}]").search
        self.old_words = regex.compile(old)
        self.young_words = regex.compile(WORDS.format(letter=letter, number=number, other=other), regex.V1)
        self.byte_ranks = self.ranks(*(np.array(self.byte_id, np.int64)[i] for i in np.indices((256, 256))))
        self.memo: dict[str, bytes] = {}
        self.memo_chars = 0

    def word_lists(self, text: str) -> Iterator[list[str]]:
        """The words of a text without special strings; those of a long one in portions."""
        pattern = self.ascii_words if text.isascii() else self.young_words if self.young(text) else self.old_words
        if len(text) <= TEXT_AT_ONCE:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while words := list(itertools.islice(found, WORDS_AT_ONCE)):
                yield words

    def parts(self, text: str | None) -> Iterator[list[str]]:
        """Words and special strings in order."""
        if not text:
            return
        special = any(t in text for t in self.special)
        for i, part in enumerate(self.cut(text) if special else [text]):
            if i % 2:
                yield [part]
            elif part:
                yield from self.word_lists(part)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, above an empty place; NONE where a pair does not merge."""
        pair = left << PLACE_BITS | right
        at = np.searchsorted(self.pair_keys[:-1], pair)
        return np.where(self.pair_keys[at] == pair, self.pair_ranks[at], NONE)

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word.

        A leaf of the tree is the rank of the pair that starts there, with its place below, so the root is the
        leftmost pair of the lowest rank. A merge changes three leaves and what is above them.
        """
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merges, size = self.merges, 1 << (n - 2).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            found = merges.get(ids[i] << PLACE_BITS | ids[i + 1])
            if found:
                tree[size + i] = found[0] << PLACE_BITS | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    return
                tree[at] = value

        def rank(i: int, j: int) -> int:
            found = merges.get(ids[i] << PLACE_BITS | ids[j])
            return found[0] << PLACE_BITS | i if found else NONE

        while tree[1] < NONE:
            i = tree[1] & ((1 << PLACE_BITS) - 1)
            j = after[i]
            ids[i] = merges[ids[i] << PLACE_BITS | ids[j]][1]
            k = after[i] = after[j]
            if j < n - 1:
                put(j, NONE)
            if k < n:
                before[k] = i
                put(i, rank(i, k))
            else:
                put(i, NONE)
            if before[i] >= 0:
                put(before[i], rank(before[i], i))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_together(self, words: list[bytes], size: int) -> list[bytes]:
        """As `merge` for many words of 2 to size + 1 bytes: one tree for each, all of which take a step at once."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        text = np.array(words, f"S{size + 1}").view(np.uint8).reshape(len(words), size + 1)
        place = np.arange(size + 1)
        alive = place < n[:, None]
        ids = np.array(self.byte_id, np.int64)[text]
        after, before = (np.tile(np.arange(d, size + 2 + d), (len(words), 1)) for d in (1, -1))
        tree = np.full((len(words), 2 * size), NONE, np.int64)
        leaves = self.byte_ranks[text[:, :-1], text[:, 1:]]
        tree[:, size:] = np.where(alive[:, 1:] & (leaves < NONE), leaves | place[:-1], NONE)
        for low in (1 << b for b in reversed(range(size.bit_length() - 1))):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        flat = tree.reshape(-1)
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            i = root & ((1 << PLACE_BITS) - 1)
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            ids[row, i] = self.merged[root >> PLACE_BITS]
            alive[row, j] = False
            after[row, i] = k
            before[row, k] = i
            pairs, closed = np.flatnonzero(k < n[row]), np.flatnonzero(j < size)
            left = np.flatnonzero(h >= 0)
            flat[row * 2 * size + size + i] = NONE
            flat[row[closed] * 2 * size + size + j[closed]] = NONE
            r, x, y = row[pairs], i[pairs], k[pairs]
            ranks = self.ranks(ids[r, x], ids[r, y])
            flat[r * 2 * size + size + x] = np.where(ranks < NONE, ranks | x, NONE)
            r, x, y = row[left], h[left], i[left]
            ranks = self.ranks(ids[r, x], ids[r, y])
            flat[r * 2 * size + size + x] = np.where(ranks < NONE, ranks | x, NONE)
            base = np.concatenate([row, row[closed], row[left]]) * 2 * size
            node = (np.concatenate([i, j[closed], h[left]]) + size) >> 1
            for _ in range(size.bit_length() - 1):
                below = base + 2 * node
                flat[base + node] = np.minimum(flat[below], flat[below + 1])
                node >>= 1
            row = row[tree[row, 1] < NONE]
        out = ids[alive].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, words: set[str]) -> None:
        """Puts the ids of new words into the memo."""
        by_size: dict[int, list[str]] = {}
        for word in words - self.special.keys():
            n = len(word) if word.isascii() else len(word.encode())
            by_size.setdefault(0 if n < 2 else 1 << (n - 2).bit_length(), []).append(word)
        for size, alike in by_size.items():
            texts = [w.encode() for w in alike]
            if size in SIZES:
                ids = self.merge_together(texts, size)
            else:
                ids = [np.array(self.merge(t), np.int32).tobytes() for t in texts]
            self.memo.update(zip(alike, ids))
        self.memo.update((w, self.special_ids[w]) for w in words & self.special.keys())
        self.memo_chars += sum(map(len, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as 32-bit integers, end to end."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, n = [], 0

        def finish() -> None:
            words = set().union(*(w for _, w in waiting))
            if self.memo_chars > MEMO_CHARS:
                self.memo, self.memo_chars = {}, 0
            self.learn(words - self.memo.keys())
            for row, of_row in waiting:
                out[row].append(b"".join(map(self.memo.__getitem__, of_row)))

        for row, text in enumerate(texts):
            for words in self.parts(text):
                waiting.append((row, words))
                n += len(words)
                if n >= WORDS_AT_ONCE:
                    finish()
                    waiting, n = [], 0
        finish()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids laid end to end; bytes that are no UTF-8 become U+FFFD."""
        pieces = self.contents.take(pa.array(ids, pa.int32()))
        offsets = np.frombuffer(pieces.buffers()[1], np.int64, len(ids) + 1, pieces.offset * 8) if len(ids) else np.zeros(1, np.int64)
        data = memoryview(pieces.buffers()[2]) if len(ids) else memoryview(b"")
        cuts = offsets[ends]
        return [str(data[a:b], "utf-8", "replace") for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer_of(file: str) -> Tokenizer:
    """The tokenizer of a file's content, made once in a process."""
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(file)
    return _tokenizers[key]


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file on the driver's machine."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids array<int>) of each row: its whole text as ids of the tokenizer file at `path`.

    A text is cut at the strings of the file's special tokens, then into words; each word's bytes merge by
    rank. Null and empty texts have no ids. Repeated rows and ids are encoded each, a null id stays null; an
    empty table gives an empty result. A word of any length takes time n log n.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(file.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                ids = tokenizer.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *(len(b) // 4 for b in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["id", "text", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), f"id {kind}, text string, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded) of each row: the text that its ids stand for, special tokens included.

    Null lists and empty ones give an empty text. An id outside the vocabulary is an error.
    """
    file = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(file.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                lists = part.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = tokenizer.decode(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(trimmed(run), f"id {kind}, ids array<int>, decoded string")
