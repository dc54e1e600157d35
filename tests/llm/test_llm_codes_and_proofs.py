"""Byte-level BPE against the tokenizer library, vector codes and Merkle proofs against plain loops."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import difference
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import DOCUMENTS
from stayline.llm import bpe, merkle, vector_codes
from stayline.llm.oracle import ORACLE_SQL
from stayline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Byte-level BPE.


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer_of(bpe.read_tokenizer(PATH))


def ids_of(own, text):
    return np.frombuffer(own.encode([text])[0], np.int32).tolist()


def library_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("folder", ["given", "awkward"])
def test_whole_query_equals_library(spark, library, awkward, folder):
    sf = SF if folder == "given" else awkward
    got = sorted(map(tuple, QUERIES["op11_byte_bpe"](spark, sf).collect()), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(((r["doc_id"], *library_row(library, r["text"])) for r in docs), key=str)


def test_every_character(own, library):
    """Each character at the places where the word pattern can split, with neighbours of every class."""
    wrong = []
    for c in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
        if not 0x20000 < c < 0xE0000 or c % 97 == 0:
            x = chr(c)
            text = f"a{x}1{x}.{x} x{x}{x} '{x}"
            if list(itertools.chain(*own.word_lists(text))) != [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]:
                wrong.append(hex(c))
    assert wrong == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t'stlldreab019_<|>é 　�"))))
def test_any_text(own, library, text):
    ids = ids_of(own, text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(np.array(ids, np.int32), np.array([len(ids)])) == [library.decode(ids, skip_special_tokens=False)] == [text]


@pytest.mark.parametrize(
    "text",
    ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "I'LL we'll 's'd  x", "a" * 70000, "ab" * 9000, " " * 5000 + "x", " " * 3000, "é" * 9999, "0" * 12345],
)
def test_special_strings_and_long_words(own, library, text):
    assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids


def plain_merge(own, word):
    """Joins the leftmost pair of the lowest rank, one scan of the word for each."""
    ids = [own.byte_id[b] for b in word]
    while True:
        pairs = [(own.merges.get(a << bpe.PLACE_BITS | b, (math.inf, 0)), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        (rank, new), i = min(pairs, key=lambda p: (p[0][0], p[1]), default=((math.inf, 0), 0))
        if rank == math.inf:
            return ids
        ids[i : i + 2] = [new]


def test_tree_finds_what_a_scan_finds(own):
    draw = random.Random(7)
    for n in range(200):
        word = bytes(draw.choice(b"aabbethinors \xc3\xa9") for _ in range(n))
        assert own.merge(word) == plain_merge(own, word)


@pytest.mark.parametrize("size", bpe.SIZES)
def test_trees_together_find_what_a_scan_finds(own, size):
    draw = random.Random(size)
    words = [bytes(draw.choice(b"aabbethinors \x00\xc3\xa9") for _ in range(draw.randint(2, size + 1))) for _ in range(300)]
    got = [np.frombuffer(b, np.int32).tolist() for b in own.merge_together(words, size)]
    assert got == [plain_merge(own, w) for w in words]


def test_memo_and_portions_change_nothing(own, library, monkeypatch):
    for name, value in {"MEMO_CHARS": 9, "WORDS_AT_ONCE": 4, "TEXT_AT_ONCE": 30}.items():
        monkeypatch.setattr(bpe, name, value)
    texts = ["one two three four five one two six " * 3, None, "", "seven <|endoftext|> eight one", "one " * 50 + "é"]
    got = [np.frombuffer(b, np.int32).tolist() for b in own.encode(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_decoding_cut_bytes(spark, own, library):
    ids = own.merge("é€😀".encode())
    pieces = [i for b in "é€😀".encode() for i in [own.byte_id[b]]]
    lists = [ids, pieces, pieces[:1], pieces[1:4], pieces[2:], [], None]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, ids array<int>")
    got = {r["id"]: r["decoded"] for r in bpe.decode_ids(df, PATH).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer(bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


# Vector codes.


def nearest_by_loop(parts, book):
    distance = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    best = distance.argmin(axis=1)  # the lowest of equal ones
    return best, distance[np.arange(len(parts)), best]


@pytest.mark.parametrize("spread", [3, 300, 2000, 90_000])
@pytest.mark.parametrize("width", [1, 3, 8])
def test_grid_equals_all_distances(spread, width):
    draw = np.random.default_rng(spread + width)
    book = draw.integers(-spread, spread, (16, width))
    book[5] = book[3]
    parts = np.concatenate([draw.integers(-2 * spread, 2 * spread, (3000, width)), book, (book[:8] + book[8:]) // 2])
    grid = vector_codes.Grid(book)
    for _ in range(2):
        entry, distance = grid.nearest(parts)
        expected = nearest_by_loop(parts, book)
        assert (entry == expected[0]).all() and (distance == expected[1]).all()


def test_grid_spares_entries():
    draw = np.random.default_rng(1)
    centres = draw.integers(-20_000, 20_000, (16, 8))
    parts = np.repeat(centres, 200, axis=0) + draw.integers(-40, 40, (3200, 8))
    grid = vector_codes.Grid(centres)
    grid.nearest(parts)
    assert grid.counts.mean() < 2 and len(grid.counts) < len(parts) / 2


def test_grid_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(vector_codes, "MEMO_CELLS", 50)
    draw = np.random.default_rng(2)
    book, grid = draw.integers(-2000, 2000, (16, 4)), None
    grid = vector_codes.Grid(book)
    for _ in range(5):
        parts = draw.integers(-3000, 3000, (400, 4))
        assert (grid.nearest(parts)[0] == nearest_by_loop(parts, book)[0]).all()


def compress_by_loop(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, codebooks digest), sorted, in Python's own numbers."""
    kept = [
        (i, [math.floor(4096 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept or not kept[0][1] or len(kept[0][1]) % parts:
        return []
    n = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == n]
    w = n // parts
    cut = [[r[1][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)]
            for c in cut
        ]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == j]
                if mine:
                    books[p] = [*books[p][:j], [sum(x) // len(mine) for x in zip(*mine)], *books[p][j + 1 :]]
    found = assign()
    sums = {}
    for r, f in zip(kept, found):
        sums[r[2]] = sums.get(r[2], 0) + sum(d for d, _ in f)
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted(
        ((r[0], "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), sums[r[2]], digest) for r, f in zip(kept, found)), key=str
    )


def vectors_folder(folder, rows):
    columns = list(zip(*rows)) or [[], [], []]
    kinds = [pa.int64(), pa.list_(pa.float32()), pa.int32()]
    names = ["vec_id", "embedding", "label"]
    more = ["id", "v", "code", "error", "_label", "n", "part", "entry", "at", "label_error"]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array(["x"] * len(rows), pa.string()) for _ in more]
    pq.write_table(pa.table(arrays, names=names + more), folder / "embeddings.parquet")
    return str(folder)


def awkward_vectors():
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(0, 0.4, 16).astype(np.float32).tolist(), int(i % 4)) for i in range(60)]
    rows += [rows[3], rows[3], (3, rows[5][1], 1), (None, rows[7][1], None), (None, rows[7][1], None), (70, rows[9][1], None)]
    rows += [(-1, None, 1), (-2, [None, *rows[0][1][1:]], 1), (-3, [math.nan, *rows[0][1][1:]], 2), (-4, [math.inf, *rows[0][1][1:]], 2)]
    rows += [(80, rows[0][1][:8], 1), (81, [], 1), (82, [900.0, -900.0] * 8, 2), (83, [0.0, -0.0] * 8, 9)]
    return rows


@pytest.mark.parametrize("rows", [awkward_vectors(), awkward_vectors()[:5], [], [(1, [], 1)], [(1, [1.0] * 12, 1)], [(1, None, 1)]])
def test_codes_equal_loop_and_sql(spark, tmp_path, rows):
    import duckdb

    folder = vectors_folder(tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    query = QUERIES["op12_vector_codes"]
    assert difference(spark, con, query, ORACLE_SQL["op12_vector_codes"], folder) is None
    assert sorted(map(tuple, query(spark, folder).collect()), key=str) == compress_by_loop(rows)


def test_components_out_of_range_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(df)


# Merkle manifest.


def leaf_of(row):
    texts = [None if v is None else str(v) for v in row]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def tree_of(digests):
    """(root, proof of each leaf): levels of (place, run)."""
    level, paths, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for leaf, i in enumerate(at):
            paths[leaf].append((i % 8, runs[i // 8]))
            at[leaf] = i // 8
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def manifest_by_loop(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the query's rows, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r)))
        trees[k] = tree_of([leaf_of(r) for r in groups[k]])
    root, tops = tree_of([trees[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, top in zip(keys, tops):
        for r, path in zip(groups[k], trees[k][1]):
            path = path + top
            siblings = "".join(d for at, run in path for i, d in enumerate(run) if i != at)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of((*r[:4], text))
            for at, run in path:
                folded = sha("".join([*run[:at], folded, *run[at + 1 :]]))
            out.append((r[0], leaf_of(r), trees[k][0], root, sha(siblings), folded, folded == root))
    return sorted(out, key=str)


def test_awkward_rows_equal_loop(spark, awkward):
    rows = [(r[0], r[3], r[2], None if r[1] is None else len(r[1]), r[1]) for r in DOCUMENTS]
    got = sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, awkward).collect()), key=str)
    assert got == manifest_by_loop(rows)


def test_tampered_rows_fail(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, SF).collect()), key=str)
    assert got == manifest_by_loop([tuple(r) for r in docs])
    assert any(not g[-1] for g in got) and any(g[-1] for g in got)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [64, 65, 1, 7], [511, 512, 513], [4097, 2], [2] * 70, [1] * 9])
def test_sizes_at_the_edges_of_runs_and_blocks(spark, sizes):
    """Groups of many sizes, many groups; with blocks of 512 rows there are one to three tiers."""
    rows = [(i, None, f"l{g}" if g else None, 1, f"Text {i} {g}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.prove_rows(df).withColumn("folded", merkle.fold("leaf", "path"))
    siblings = F.sha2(F.array_join(F.flatten(F.transform("path", lambda p: p["siblings"])), ""), 256).alias("proof")
    mine = sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", siblings).collect()), key=str)
    assert mine == sorted((r[:5] for r in manifest_by_loop(rows)), key=str)
    assert got.where("folded <> root").count() == 0


def test_any_change_breaks_the_proof(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = merkle.row_digest([F.col("doc_id"), F.lit("t"), F.col("lang"), F.col("n_chars"), F.col("text")])
    proofs = merkle.prove_rows(df, carry={"changed": changed})
    assert proofs.where(merkle.fold("changed", "path") == F.col("root")).count() == 0


def test_no_join_in_the_proofs(spark):
    """Below the stored ranks and blocks the plan groups and explodes only."""
    df = spark.createDataFrame([(i, "s", "en", 1, "x") for i in range(600)], "doc_id long, source string, lang string, n_chars long, text string")
    plan = merkle.prove_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" in plan
