"""Small tables with every awkward case, as Parquet folders that Spark and DuckDB both read."""

import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and a to in is was by that it on for as with at from his an were are which this also be had".split()


def prose(n, seed):
    out = []
    for i in range(n):
        seed = (seed * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(seed >> 8) % len(WORDS)] + WORDS[(seed >> 14) % len(WORDS)])
    return " ".join(out)


def lines(n, seed):
    return "\n".join(prose(8, seed * 100 + i) for i in range(n))


PASSAGE = lines(12, 77)
ITEM = prose(30, 991)

#: (doc_id, text, lang, source); ids repeat, are null, and rows repeat whole.
DOCUMENTS = [
    (1, prose(120, 1), "en", "a"),
    (2, prose(120, 1), "en", "b"),
    (2, prose(120, 1), "en", "b"),
    (3, prose(120, 1).replace(" ", "  ", 3).upper(), "en", None),
    (4, None, "en", "a"),
    (5, "", "fr", "a"),
    (6, " \t\n\x0b\x0c\r ", None, "Z"),
    (7, "one two three", "fr", "é"),
    (8, "One Two\u00a0Three", "fr", "é"),
    (9, "one two three", None, "\U0001f600"),
    (None, prose(60, 5), "de", "a"),
    (None, prose(60, 5), "de", "a"),
    (11, None, None, None),
    (12, "word " * 3000, "en", "long"),
    (13, lines(40, 3) + "\n" + PASSAGE + "\n" + lines(9, 4), "en", "a"),
    (14, lines(7, 5) + "\n" + PASSAGE + "\n" + lines(30, 6), "fr", "b"),
    (15, PASSAGE + "\n" + lines(30, 7), "de", "b"),
    (16, "\n\n\n\n\nx\n\n\n\n\n", "de", "b"),
    (17, "12 345 6-7 !! ##", "de", "c"),
    (18, prose(40, 8) + " " + ITEM + " " + prose(40, 9), "en", "c"),
    (19, ITEM.upper().replace(" ", ", ") + " tail", "en", "c"),
    (20, " ".join(ITEM.split()[5:14]), "en", "c"),
    (21, "Tiny Item", "en", "c"),
    (22, "a tiny item and tiny item; again TINY-ITEM", "en", "c"),
    (23, "été où ça là noël " * 30, "fr", "c"),
    (24, prose(9000, 10), "en", "long"),
    (25, prose(9000, 10) + " end", "en", "long"),
    (26, "x" * 30000 + " " + "9" * 8000 + " " + "a.b@" * 3000, "en", "long"),
    (-27, prose(120, 1).replace("the", "THE", 2), "en", "a"),
    (28, prose(15, 40) + " " + prose(20, 8) + " " + prose(15, 41), "en", "c"),
] + [(100 + i, " ".join([*prose(100, 31).split()[: 100 - i % 3], f"edit{i}"]), "de", "hot") for i in range(12)]

BENCHMARK = [(1, ITEM), (2, "tiny item"), (2, "tiny item"), (10, ITEM + " more words"), (3, None), (4, " .. "), (None, prose(20, 8)), (5, "tiny item"), (6, "")]
LABELS = [(r[0], i % 3 and 1, 0 if i % 5 else None) for i, r in enumerate(DOCUMENTS)] + [(1, 1, 0), (1, 0, 0), (None, 1, 0), (13, None, 1), (999, 1, 0)]
PAGES = [
    (1, "http://a.b.example.net/en/x?q=://z#f"),
    (1, "http://a.b.example.net/en/x?q=://z#f"),
    (2, "HTTPS://EXAMPLE.NET/EN/x"),
    (3, "http://example.net"),
    (4, "http://net/"),
    (5, "http://internet/"),
    (6, None),
    (7, ""),
    (8, "no scheme example.net/"),
    (9, "://x.org/fr/"),
    (None, "http://x.org/fr"),
    (11, "http://example.com/de/" + "d/" * 3000),
    (12, "http://" + "s." * 3000 + "example.com/de/"),
    (13, "http://..example.com/de/x"),
    (14, "http://example.com:80/de/"),
    (15, "http://exämple.com?/de/"),
    (16, "a://b://c.net/"),
    (17, "http://x.net?y"),
]


VECTORS = [(i, [math.sin(1 + i * 7 + j * j) for j in range(16)], i % 3) for i in range(40)] + [
    (3, [math.sin(22 + j * j) for j in range(16)], 0),
    (3, [math.sin(22 + j * j) for j in range(16)], 0),
    (None, [0.5] * 16, None),
    (None, [0.5] * 16, None),
    (50, None, 1),
    (-1, [math.nan] * 16, 1),
    (-2, [1.0, None] * 8, 1),
    (-3, [-math.inf] * 16, 1),
    (51, [1.0] * 8, 2),
    (52, [], 2),
    (53, [700.0, -700.0] * 8, None),
]


def write(folder, documents, labels, benchmark, pages, vectors):
    extra = {c: pa.string() for c in "id _id _text _row key n size digest hash shard pos chunk stratum host path words spans items".split()}

    def table(rows, schema):
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        arrays = [pa.array(c, t) for c, t in zip(columns, schema.values())]
        more = [pa.array([f"{c}{i}" for i in range(len(rows))], t) for c, t in extra.items() if c not in schema]
        return pa.table(arrays + more, names=[*schema, *(c for c in extra if c not in schema)])

    docs = [(*r, None if r[1] is None else len(r[1])) for r in documents]
    long, text = pa.int64(), pa.string()
    pq.write_table(table(docs, {"doc_id": long, "text": text, "lang": text, "source": text, "n_chars": long}), folder / "documents.parquet")
    pq.write_table(table(labels, {"doc_id": long, "quality": long, "toxic": long}), folder / "labels.parquet")
    pq.write_table(table(benchmark, {"item_id": long, "text": text}), folder / "benchmark.parquet")
    pq.write_table(table(pages, {"page_id": long, "url": text, "html": text}), folder / "pages.parquet")
    pq.write_table(table(vectors, {"vec_id": long, "embedding": pa.list_(pa.float32()), "label": pa.int32()}), folder / "embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    pages = [(*p, None) for p in PAGES]
    return write(tmp_path_factory.mktemp("awkward"), DOCUMENTS, LABELS, BENCHMARK, pages, VECTORS)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [], [], [])


@pytest.fixture(scope="session")
def duck_of():
    def connect(folder):
        con = duckdb.connect()
        for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
            if not os.path.exists(f"{folder}/{t}.parquet"):
                continue
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return connect
