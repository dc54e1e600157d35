"""Line dedup against plain loops over the texts."""

import hashlib
import re

import pytest

from stayline.llm.line_chunks import BASE, MODULUS, dedup_line_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]")


def boundaries(lines, window, every):
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out = {1, len(lines)}
    for i in range(len(lines)):
        rolled = hashes[i] % MODULUS
        for back in range(1, window):
            rolled = (rolled * BASE + (hashes[i - back] if i >= back else 0)) % MODULUS
        if rolled % every == 0:
            out.add(i + 1)
    return sorted(out)


def plain(rows, window, every):
    """{(id, text): numbers of removed lines} with texts in order of (id, digest)."""
    order = sorted({(i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), i, t) for i, t in rows if t is not None})
    seen, gone = set(), {}
    for *_, i, t in order:
        lines = t.split("\n")
        cuts = boundaries(lines, window, every)
        out = gone[i, t] = set()
        for a, b in zip(cuts, cuts[1:]):
            chunk = "\n".join(lines[a - 1 : b])
            if WORD.search(chunk):
                if chunk in seen:
                    out.update(range(a, b + 1))
                seen.add(chunk)
    return gone


def without(text, gone):
    return "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in gone)


@pytest.mark.parametrize("window, every", [(2, 1), (1, 2), (2, 3), (3, 4)])
def test_equals_plain_loop(spark, awkward, window, every):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(200 + i, "\n".join(f"line {j % 7} {'x' * (j % 3)}" for j in range(i, 3 * i))) for i in range(30)]
    rows += [(300, "a\na\na\na"), (301, "a\na"), (302, "\n\n"), (303, "\n"), (304, "a\n"), (305, "\na\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L AS n", "'mine' AS first", "9 AS n_lines")
    out = dedup_line_chunks(frame, window=window, every=every).collect()
    gone = plain(rows, window, every)
    expected = [(i, t if t is None else without(t, gone[i, t]), 0 if t is None else len(gone[i, t])) for i, t in rows]
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["text"], r["n_removed_lines"])) for r in out)
    assert all(r["first"] == "mine" and r["n"] == 1 for r in out) and any(r["n_removed_lines"] for r in out)


def test_counts_may_be_named(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", "kept"), (2, "a b\nc d", "kept")], "doc_id long, text string, n_lines string")
    out = dedup_line_chunks(docs, n_lines="lines_before", n_removed_lines="lines_gone").orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines"], r["lines_before"], r["lines_gone"]) for r in out] == [("a b\nc d", "kept", 2, 0), ("", "kept", 2, 2)]


def test_repeated_passages_go(spark):
    """Runs of two lines or more with over 50 words that stand in an earlier, different text, found by a plain search."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL AND text IS NOT NULL").collect())
    left = {r["doc_id"]: r for r in dedup_line_chunks(docs).collect()}
    seen, texts, runs = set(), set(), []
    for i, t in rows:
        lines = t.split("\n")
        pairs = list(zip(lines, lines[1:]))
        if t not in texts:
            a = 0
            while a < len(pairs):
                b = a
                while b < len(pairs) and pairs[b] in seen:
                    b += 1
                if b > a and sum(len(x.split()) for x in lines[a : b + 1]) > 50:
                    runs.append((i, "\n".join(lines[a : b + 1])))
                a = b + 1
        texts.add(t)
        seen.update(pairs)
    assert len(runs) > 100
    assert all(run not in left[i]["text"] for i, run in runs)
    kept_lines = {x for r in left.values() if r["text"] is not None for x in r["text"].split("\n")}
    assert {x for _, t in rows for x in t.split("\n") if WORD.search(x)} <= kept_lines
