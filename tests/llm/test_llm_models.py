"""Trained and scanning operators against brute force, gradients by differences, and held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import fm_index, jaccard_join, language_id, licenses, pii, quality
from stayline.llm.queries import QUERIES
from stayline.llm.recurrent import Both, Gated, LongShort

SF = "/root/testdata/sf0.01"


def rows_of(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()


# recurrent layers


@pytest.mark.parametrize("layer", [Gated, LongShort])
def test_gradients_through_time(layer):
    rng = np.random.default_rng(0)
    both = Both(layer, 5, 3, rng)
    for one in (both.ahead, both.back):
        one.x, one.u = one.x.astype(np.float64), one.u.astype(np.float64)
    x, on = rng.integers(0, 5, (6, 4)), np.ones((6, 4))
    on[4:, 1] = on[2:, 3] = 0
    weight = rng.normal(size=(6, 6, 4))
    grads = both.learn(x, on)[1](weight)
    differences(both.weights(), grads, lambda: (both.learn(x, on)[0] * weight).sum(), rng)
    assert np.allclose(np.concatenate(both.run(x, on), axis=1), both.learn(x, on)[0], atol=1e-6)


def test_crf_gradients_and_viterbi():
    rng = np.random.default_rng(1)
    chain = pii.Chain(3, 0)
    for one in (chain.layer.ahead, chain.layer.back):
        one.x, one.u = one.x.astype(np.float64), one.u.astype(np.float64)
    chain.w, chain.b = chain.w.astype(np.float64) * 9, chain.b.astype(np.float64)
    chain.move = rng.normal(size=chain.move.shape)
    x, on, tags = rng.integers(0, 130, (4, 3)), np.ones((4, 3)), np.zeros((4, 3), int)
    on[3:, 2] = 0
    tags[:3, 0], tags[1, 1] = [1, 2, 2], 5
    grads = chain.gradients(x, on, tags)[1]
    differences(chain.weights(), grads, lambda: chain.gradients(x, on, tags)[0], rng)

    states, _ = chain.layer.learn(x, on)
    emit, move = chain.w @ states + chain.b, chain.transitions()
    best = chain.decode(x, on)
    for j, n in enumerate((4, 4, 3)):
        paths = np.stack(np.meshgrid(*[np.arange(pii.TAGS)] * n, indexing="ij"), -1).reshape(-1, n)
        score = sum(emit[t, paths[:, t], j] for t in range(n)) + sum(move[paths[:, t - 1], paths[:, t]] for t in range(1, n))
        assert score.max() == pytest.approx(score[(paths == best[:n, j]).all(axis=1)][0], abs=1e-3)


def differences(weights, grads, loss, rng):
    for w, g in zip(weights, grads):
        for _ in range(8):
            at, e = tuple(rng.integers(s) for s in w.shape), 1e-5
            old = w[at]
            w[at] = old + e
            up = loss()
            w[at] = old - e
            down = loss()
            w[at] = old
            assert (up - down) / (2 * e) == pytest.approx(g[at], abs=2e-4)


# language ID


def test_languages_of_held_out_documents(spark):
    found = {r["doc_id"]: r for r in rows_of(spark, "op1_language_id", SF)}
    docs = documents(spark, SF)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in held} == {i for i, r in found.items() if r["held_out"]}
    assert np.mean([found[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values()) and len(found) == len(docs)


def test_language_comes_from_the_text_alone(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    found = language_id.identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    for i in (4, 5, 6, 11):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[17]["lang_pred"] == "und" and by_id[9]["lang_pred"] != "und"
    assert by_id[None]["held_out"] is False
    # labels of held-out rows, and any source, change nothing
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language_id.held_out("doc_id"), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    again = language_id.identify_languages(other).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_pooling_equals_windows_one_by_one():
    rng = np.random.default_rng(2)
    tagger = language_id.Tagger(["a", "b", "c"], 4, 0)
    texts = [bytes(rng.integers(32, 250, n).astype(np.uint8)) for n in (1, 2, 111, 112, 113, 500, 3000)]
    together = tagger.pooled(texts)
    for t, p in zip(texts, together):
        assert np.allclose(tagger.pooled([t])[0], p, atol=1e-5)
        if language_id.LETTER[np.frombuffer(t, np.uint8)].any():
            assert p.sum() == pytest.approx(1, abs=1e-4)


# licences


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("folder", ["awkward", SF])
def test_license_places(spark, request, folder):
    folder = request.getfixturevalue(folder) if folder == "awkward" else folder
    found = rows_of(spark, "op8_licenses", folder)
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    expected = [(d["doc_id"], *plain_licenses(d["text"])) for d in documents(spark, folder)]
    assert sorted(map(str, expected)) == sorted(str(tuple(r[c] for c in columns)) for r in found)
    for r in found:
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_license_statements(spark):
    texts = {
        1: "CC-BY cc by, CC BY! cc by",
        2: "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nAll Rights, reserved",
        3: "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */",
        4: "SPDX-License-Identifier: AND OR )(",
        5: "Licensed under CC BY-NC-SA 4.0 by us",
        6: "lesser GENERAL public license; affero general public license",
        7: "under the Lesser General Public License",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    found = {r["id"]: r for r in licenses.license_labels(licenses.scan_licenses(docs)).collect()}
    assert [p["word"] for p in found[1]["places"]] == [0, 2, 4, 6]
    assert found[2]["labels"] == "apache-2.0,gpl-2.0-only,mit,reserved" and found[2]["score"] == 0.0
    assert (found[3]["labels"], found[3]["score"]) == ("gpl-2.0-or-later", licenses.WITH_EXCEPTION)
    assert (found[4]["labels"], found[4]["score"]) == ("", 1.0)
    assert found[5]["labels"] == "cc-by,cc-by-nc,cc-by-nc-sa"
    assert found[6]["labels"] == "agpl,gpl,lgpl" and found[6]["score"] == 0.3
    assert (found[7]["labels"], found[7]["base_labels"], found[7]["score"]) == ("gpl,lgpl", "gpl", 0.6)


def test_many_places_take_linear_time():
    finds = licenses.automaton(licenses.BASE, licenses.NOTICES)
    words, places, _ = licenses.scan(b"cc by " * 500_000, finds, licenses.BASE, licenses.NOTICES)
    assert words == 1_000_000 and [p["word"] for p in places] == list(range(0, 1_000_000, 2))


def test_merged_spans_equal_plain_loop():
    rng = np.random.default_rng(4)
    for _ in range(300):
        spans = [[(k, int(s), int(s + rng.integers(1, 9))) for k, s in zip(rng.choice(pii.KINDS, 6), rng.integers(0, 60, 6))] for _ in "bl"]
        base, learned = spans
        free = [s for s in learned if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
        assert pii.merged(base, learned) == sorted([*base, *free], key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


@pytest.mark.parametrize(
    "text, labels, score",
    [
        ("MIT", ["mit"], 1.0),
        ("mit or gpl-3.0 and agpl-3.0", ["agpl-3.0", "gpl-3.0", "mit"], 1.0),
        ("(mit or gpl-3.0) and agpl-3.0", ["agpl-3.0", "gpl-3.0", "mit"], 0.3),
        ("gpl-2.0 with x or agpl-3.0", ["agpl-3.0", "gpl-2.0"], 0.6),
        ("gpl-2.0 and (mit or", ["gpl-2.0"], 0.4),
        ("mit mit", ["mit"], 1.0),
        ("NOASSERTION", ["noassertion"], 0.0),
        ("LicenseRef-Proprietary OR MPL-2.0", ["licenseref-proprietary", "mpl-2.0"], 0.6),
        ("Apache-2.0 see the file", ["apache-2.0"], 1.0),
        ("BSD-3-Clause AND CC-BY-SA-4.0 AND LGPL-2.1+", ["bsd-3-clause", "cc-by-sa-4.0", "lgpl-2.1+"], 0.6),
    ],
)
def test_license_expressions(text, labels, score):
    assert licenses.evaluate(text) == (labels, score)


@pytest.mark.parametrize("text", ["", "or mit", ")", "()", "((mit", "see the file", "gpl-", "mit-2"])
def test_broken_license_expressions(text):
    assert licenses.evaluate(text) is None


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_patterns_on_random_texts():
    rng = np.random.default_rng(4)
    alphabet = np.array(list("ab1209.@+- ()é\n%_"))
    for _ in range(30000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 40)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("folder", ["awkward", SF])
def test_personal_data(spark, request, folder):
    folder = request.getfixturevalue(folder) if folder == "awkward" else folder
    found = rows_of(spark, "op10_personal_data", folder)
    assert rows_of(spark, "op10_personal_data", folder) == found
    expected = []
    for d in documents(spark, folder):
        text = re.sub("[0-9]{4000,}", lambda m: "9" * len(m[0]), d["text"] or "")
        spans = plain_base(text)
        kinds = [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        expected.append((d["doc_id"], *kinds, hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()))
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert sorted(map(str, expected)) == sorted(str(tuple(r[c] for c in columns)) for r in found)
    texts = {d["doc_id"]: d["text"] or "" for d in documents(spark, folder)}
    for r in found:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in spans]
        assert order == sorted(order) and all(0 <= a < b <= len(texts[r["doc_id"]]) for _, a, b in order)
        if r["doc_id"] is not None:
            assert {"%s:%d:%d" % s for s in plain_base(texts[r["doc_id"]])} <= set(r["spans"].split(","))


def test_network_finds_most_spans_it_was_not_shown(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    chain = pii.train(docs.where("doc_id % 2 = 0"), "doc_id", "text", pii.SAMPLE_DOCS, 5)
    texts = [r["text"] for r in docs.where("doc_id % 2 = 1 AND text RLIKE '[0-9@]'").select("text").collect()]
    base, learned = [set(pii.base_spans(t)) for t in texts], [set(s) for s in pii.learned_spans(texts, chain)]
    learned = [{s for s in spans if s[0] in pii.BASE_KINDS} for spans in learned]
    shared = sum(len(b & s) for b, s in zip(base, learned))
    assert shared >= 0.8 * sum(map(len, base)) and shared >= 0.8 * sum(map(len, learned))


def test_network_finds_secrets_of_forms_it_was_not_shown(spark):
    """No planted secret is called token or has forty hexadecimal digits; those of the given texts are not learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert "token" not in pii.SECRET_NAMES and not any(chars == pii.HEX and 40 in n for _, chars, n in pii.SECRET_FORMS)
    found = pii.find_personal_data(docs.select("doc_id", "text")).join(docs.select("doc_id", "text"), F.col("id") == F.col("doc_id")).collect()
    whole = false = total = 0
    for r in found:
        text = r["text"] or ""
        tokens = {m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)}
        secrets = {(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "secret"}
        total, whole, false = total + len(tokens), whole + len(tokens & secrets), false + len([s for s in secrets if not any(a < s[1] and s[0] < b for a, b in tokens)])
    assert total >= 100 and whole >= 0.9 * total and false <= 0.05 * total


def test_planted_spans_hold_their_texts():
    rng = np.random.default_rng(9)
    for _ in range(300):
        text = "call +1 555 010 9999 or a.b@c.org, été 10.1.2.3 now"
        base = pii.base_spans(text)
        new, spans = pii.planted(text, base, rng)
        assert [new[s:e] for k, s, e in spans if k != "secret"] == [text[s:e] for _, s, e in sorted(base, key=lambda s: s[1])]
        assert all(pii.plausible("secret", new[s:e]) for k, s, e in spans if k == "secret")


def test_spans_across_windows_are_one():
    text = "x" * 50 + "a" * 90 + "@example.com" + " y" * 60
    tags = pii.tags_of(len(text), [("email", 50, 152)])
    assert pii.reconciled({s: tags[s : s + pii.WINDOW] for s in pii.window_starts(text)}, len(text))
    every = range(0, len(text), pii.STRIDE)
    assert pii.reconciled({s: tags[s : s + pii.WINDOW] for s in every}, len(text)) == [("email", 50, 152)]


# FM-index and T-occurrence


@pytest.mark.parametrize("n, symbols", [(1, 1), (60, 1), (50, 2), (500, 4), (3000, 700)])
def test_fm_index_finds_every_occurrence(n, symbols):
    rng = np.random.default_rng(n)
    s = rng.integers(1, symbols + 1, n)
    index = fm_index.FMIndex(s, sample=5)
    suffixes = sorted(range(n + 1), key=lambda i: [*s[i:], 0])
    assert fm_index.suffix_array(np.append(s, 0)).tolist() == suffixes
    lengths = rng.integers(1, 6, 80)
    phrases = np.zeros((80, 5), np.int64)
    for row, k in zip(phrases, lengths):
        at = rng.integers(0, max(1, n - k))
        row[5 - k :] = s[at : at + k] if n >= k and rng.random() < 0.8 else rng.integers(1, symbols + 1, k)
    low, high = index.search(phrases, lengths)
    for row, k, a, b in zip(phrases, lengths, low, high):
        expected = [i for i in range(n - k + 1) if (s[i : i + k] == row[5 - k :]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_divide_skip_counts(least):
    rng = np.random.default_rng(least)
    for _ in range(50):
        lists = [sorted(set(rng.integers(0, 40, rng.integers(1, 30)).tolist())) for _ in range(rng.integers(least, 9))]
        counts = {m: sum(m in x for x in lists) for m in range(40)}
        assert jaccard_join.divide_skip(lists, least) == {m: c for m, c in counts.items() if c >= least}


@pytest.mark.parametrize("long_list, block", [(1, 1500), (3, 4000), (64, 200_000)])
def test_jaccard_join_with_long_lists_and_small_blocks(spark, long_list, block):
    """Hot shingles, many blocks: the components stay those of brute force."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 400, 90)]
    texts = []
    for i in range(160):
        words = list(base if i % 2 else base[:60] + [f"v{i}x{j}" for j in range(i % 9)])
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(len(words))] = f"edit{rng.integers(50)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs, long_list=long_list, block=block, shard_words=2000).collect()
    sets = [{" ".join(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low = min(root[a], root[b])
                    root = [low if r in (root[a], root[b]) else r for r in root]
        break
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(root))
    assert 1 < len(set(root)) < len(root)


def test_null_id_bridges_two_documents(spark):
    """Ends link only through near copies without an id, of which one set has no other row."""
    words = [f"w{i}" for i in range(100)]
    texts = [(1, words), (None, [*words[:95], *"abcde"]), (None, ["v", *words[1:90]]), (2, [*words[10:95], *"abcde", "z1", "z2", "z3"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    sets = [{" ".join(w[j : j + 4]) for j in range(len(w) - 3)} for _, w in texts]
    assert [100 * len(a & sets[1]) >= 85 * len(a | sets[1]) for a in sets] == [True, True, True, True]
    assert 100 * len(sets[0] & sets[3]) < 85 * len(sets[0] | sets[3])
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {1}
    assert [r["doc_id"] for r in jaccard_join.keep_one_of_each(docs).collect()] == [1]


# quality bounds


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(k, n) for n in (5, 40, 300, 2000) for k in range(0, 12)]
    df = spark.createDataFrame(cases, "k long, n long")
    from pyspark.sql import functions as F

    for p in (0.004, 0.2):
        for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), p).alias("p")).collect():
            k, n = r["k"], r["n"]
            exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1
            assert r["p"] == pytest.approx(exact, rel=1e-8)


def test_cutoffs_hold_for_fresh_documents(spark):
    """Cutoffs from one half of made-up good documents reject few of the other half, in each stratum."""
    from pyspark.sql import functions as F

    good = spark.range(40_000).select(
        F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("stratum"),
        F.lit(100).cast("long").alias("n_words"),
        F.lit(500).cast("long").alias("word_chars"),
        (F.rand(3) * 30).cast("long").alias("n_symbols"),
        F.lit(10).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dup_lines"),
        (F.pow(F.rand(4), 6) * 60).cast("long").alias("n_repeat_words"),
        (F.col("id") % 8 < 4).alias("held"),
    )
    good = good.cache()
    cutoffs = quality.select_cutoffs(good.where("held")).collect()
    assert {r["stratum"] for r in cutoffs} == {"small", "large"}
    for stratum in ("small", "large"):
        failed = [F.col(r.over) / F.col(r.under) > c["cutoff"] for r in quality.RULES for c in cutoffs if c["rule"] == r.name and c["stratum"] == stratum]
        fresh = good.where(~F.col("held") & (F.col("stratum") == stratum))
        any_failed = failed[0]
        for f in failed[1:]:
            any_failed = any_failed | f
        assert fresh.where(any_failed).count() <= 0.02 * fresh.count()
