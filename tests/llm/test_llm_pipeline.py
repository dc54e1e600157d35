"""Each stage of the corpus pipeline against a plain version, on its own input."""

import re
from collections import Counter
from itertools import combinations

import pytest
from conftest_tables import folder_of
from compare import difference
from pyspark.sql import functions as F

import corpus_pipeline
from stayline.llm import decontaminate, language_id
from stayline.llm.common import store
from stayline.llm.oracle import ORACLE_SQL
from stayline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module", params=["awkward", SF])
def run(request, spark):
    """Folder, and the input and output of each stage."""
    folder = request.getfixturevalue("awkward") if request.param == "awkward" else request.param
    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, folder), "test-stage")
        steps[name] = (docs, out)
        docs = out
    return folder, steps


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages_keep_the_columns_of_documents(run):
    _, steps = run
    for name in list(STAGES)[:-1]:
        before, after = steps[name]
        assert after.columns == before.columns and after.dtypes == before.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]


def test_language_id_drops_what_the_operator_rejects(run):
    before, after = run[1]["language_id"]
    found = language_id.identify_languages(before).where("lang_pred <> 'und' AND score >= 0.4")
    assert sorted(r["doc_id"] or 0 for r in found.collect()) == sorted(r["doc_id"] or 0 for r in after.collect())


def test_line_dedup_equals_sql(run, spark, duck_of, tmp_path):
    """On one row of each text, as a plain loop keeps them; documents that lose most of their words go."""
    before, after = run[1]["line_dedup"]
    worded = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, rest = {}, []
    for r in sorted(before.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        if not worded(r["text"]):
            rest.append(r)
        elif r["text"] not in first:
            first[r["text"]] = r
    kept = spark.createDataFrame([*first.values(), *rest], before.schema)
    con = duck_of(folder_of(tmp_path, kept))
    old = {(r["doc_id"]): len(worded(r["text"])) for r in first.values()}
    expected = [
        (i, t)
        for i, t, removed in con.execute(f"SELECT doc_id, text, n_removed_lines FROM ({ORACLE_SQL['op6_line_chunks']})").fetchall()
        if not removed or len(worded(t)) >= 0.2 * old[i]
    ]
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["text"])) for r in after.collect())
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after.collect())


def test_choice_among_rows_equal_in_id_and_text_is_the_same_in_every_run(spark):
    rows = [(i, f"text number {i} of these", f"source {k}", "en") for i in range(20) for k in range(5)]
    for stage in ("line_dedup", "mixing", "ngram_jaccard"):
        chosen = set()
        for parts, order in ((1, rows), (5, rows[::-1]), (3, rows[7:] + rows[:7])):
            docs = spark.createDataFrame(order, "doc_id long, text string, source string, lang string").repartition(parts)
            out = STAGES[stage](spark, docs, SF).select("doc_id", "source")
            chosen.add(tuple(sorted(map(tuple, out.collect()))))
        assert len(chosen) == 1 and (stage == "mixing" or len(next(iter(chosen))) == 20)


def test_columns_of_the_users_own_survive(spark):
    docs = spark.createDataFrame([(1, "a b\nc d\ne f g h", 7, 8, 9, 6)], "doc_id long, text string, n_lines int, n_removed_lines int, n_words_before int, taken int")
    out = STAGES["line_dedup"](spark, docs, SF)
    assert out.columns == docs.columns and out.collect() == docs.collect()
    assert STAGES["mixing"](spark, docs.withColumn("source", F.lit("a")), SF).first()["taken"] == 6


def test_one_end_of_each_link_stays(spark):
    """Links by brute force on the documents before line dedup: five-word shingles, 80 %."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, holders = {}, {}
    for r in docs.where("doc_id IS NOT NULL").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for s in sets[r["doc_id"]]:
            holders.setdefault(s, []).append(r["doc_id"])
    shared = Counter((a, b) for ids in holders.values() for a, b in combinations(sorted(ids), 2))
    links = [p for p, n in shared.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    out = docs
    for stage in ("line_dedup", "ngram_jaccard"):
        out = store(STAGES[stage](spark, out, SF), "test-links")
    kept = {r["doc_id"] for r in out.collect()}
    both = [p for p in links if p[0] in kept and p[1] in kept]
    assert len(links) > 50 and len(both) <= 0.1 * len(links), (len(links), both)


def test_one_of_each_group_stays(run):
    before, after = run[1]["ngram_jaccard"]
    texts = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in before.collect()})
    sets = []
    for _, _, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= 80 * large > 0 and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    groups = {r for r, s in zip(root, sets) if s}
    kept = [r for r in after.collect() if re.search(r"[^\x20\x09-\x0D]", r["text"] or "")]
    place = {(i or 0, t): k for k, (_, i, t) in enumerate(texts)}
    assert sorted(root[place[(r["doc_id"] or 0, r["text"])]] for r in kept) == sorted(groups)
    wordless = [r for r in before.collect() if not re.search(r"[^\x20\x09-\x0D]", r["text"] or "")]
    assert len(wordless) == after.count() - len(kept)


def test_near_copies_share_four_fifths_of_five_words(spark):
    """Against brute force, with edits around the limit: of copies with single words changed, and of unlike texts."""
    base = [f"w{i}" for i in range(200)]
    texts = [base] + [[f"e{k}x{i}" if 9 < i < 10 + k else w for i, w in enumerate(base)] for k in range(2, 40, 3)]
    texts += [[f"o{i}" for i in range(n)] for n in (3, 30, 33, 40)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    sets = {n: [{" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in texts] for n in (4, 5)}

    def first_of_each(n, percent):
        root = list(range(len(texts)))
        for a, x in enumerate(sets[n]):
            for b, y in enumerate(sets[n][:a]):
                if 100 * len(x & y) >= percent * len(x | y):
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
        return sorted(set(root))

    assert first_of_each(5, 80) != first_of_each(4, 85)
    kept = STAGES["ngram_jaccard"](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == first_of_each(5, 80)


def test_passages_of_the_benchmark_are_cut(run, spark):
    """Against a plain search for the windows: all words inside one go, all others stay in their order."""
    folder, steps = run
    before, after = steps["decontamination"]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = split(r["text"])
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}

    def left(text):
        words, hit = split(text), set()
        for i in range(len(words)):
            for n in sizes:
                if tuple(words[i : i + n]) in windows and i + n <= len(words):
                    hit.update(range(i, i + n))
        return [w for i, w in enumerate(words) if i not in hit], len(hit)

    expected = {(r["doc_id"], tuple(left(r["text"])[0])) for r in before.collect()}
    untouched = {(r["doc_id"], r["text"]) for r in before.collect() if not left(r["text"])[1]}
    assert before.count() == after.count() and any(left(r["text"])[1] for r in before.collect())
    assert {(r["doc_id"], tuple(split(r["text"]))) for r in after.collect()} == expected
    assert untouched <= {(r["doc_id"], r["text"]) for r in after.collect()}


def test_several_blocks_of_phrases_give_the_same(spark, awkward):
    docs, benchmark = (spark.read.parquet(f"{awkward}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (decontaminate.find_contamination(docs, benchmark, block_phrases=n, shard_words=200) for n in (1000, 5))
    assert rows(one.select("id", "digest", "n_words", "spans", "items")) == rows(many.select("id", "digest", "n_words", "spans", "items"))


def test_mixing_takes_what_the_operator_says(run, spark, duck_of, tmp_path):
    before, after = run[1]["mixing"]
    folder = folder_of(tmp_path, before)
    assert difference(spark, duck_of(folder), QUERIES["op2_mixing"], ORACLE_SQL["op2_mixing"], folder) is None
    mixed = QUERIES["op2_mixing"](spark, folder).collect()
    assert sum(r["taken"] for r in mixed) == sum(r["taken"] for r in after.collect())
    assert {r["doc_id"] for r in mixed if r["taken"]} == {r["doc_id"] for r in after.collect()}
    assert after.columns == [*before.columns, "taken"]


def test_one_row_of_each_group_of_copies_survives(spark, tmp_path, monkeypatch):
    """From line dedup to the mix; the network and the mix drop documents for reasons of their own."""
    texts = ["\n".join(" ".join(f"t{t}l{i}w{j}" for j in range(9)) for i in range(2 + t)) for t in range(12)]
    rows = [(10 * t + c if c or t % 3 else None, x) for t, x in enumerate(texts) for c in range(4)] + [(11, texts[1]), (None, texts[0])]
    rows += [(900, None), (901, None), (902, " \n"), (903, " \n")]
    docs = spark.createDataFrame([(i, x, len(x or "")) for i, x in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "benchmark.parquet").write_bytes(open(f"{SF}/benchmark.parquet", "rb").read())
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:-1])
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    first = [(10 * t + (t % 3 == 0), x) for t, x in enumerate(texts)]
    assert sorted(str((r["doc_id"], r["text"])) for r in left if (r["doc_id"] or 0) < 900) == sorted(map(str, first))
    assert sorted(r["doc_id"] for r in left if (r["doc_id"] or 0) >= 900) == [900, 901, 902, 903]


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
