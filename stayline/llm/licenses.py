"""Licence scans: notices and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import alnum_words, arrow_schema, batch_of, texts_of, trimmed

# Phrases and labels of the base.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Further notices, as lower-case words.
NOTICES = {
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "dedicated to the public domain": "cc0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}

TAG_WORDS = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)

# How freely a text may be used, by the start of the label; the first that fits counts.
FREEDOM = (
    ("cc-by-nc", 0.2),
    ("cc-by-nd", 0.3),
    ("cc-by-sa", 0.6),
    ("reserved", 0.0),
    ("agpl", 0.3),
    ("lgpl", 0.6),
    ("gpl", 0.4),
    ("mpl", 0.6),
    ("epl", 0.6),
)
WITH_EXCEPTION = 0.6

# Families of licence identifiers, lower case; `*` stands for a version.
IDENTIFIERS = """
0bsd afl-* agpl-* apache-* apsl-* artistic-* blueoak-* bsd-*-clause bsd-*-clause-clear bsd-source-code bsl-* busl-* cc-by-*
cc-by-nc-* cc-by-nc-nd-* cc-by-nc-sa-* cc-by-nd-* cc-by-sa-* cc0-* cddl-* cecill-* cpl-* curl ecl-* epl-* eupl-* gfdl-* gpl-* hpnd ijg
intel ipl-* isc lgpl-* libpng lppl-* mit mit-0 mpl-* ms-pl ms-rl mulanpsl-* ncsa odbl-* ofl-* openssl osl-* php-* pddl-* postgresql psf-*
python-* ruby sleepycat unicode-dfs-* unlicense upl-* vim w3c wtfpl x11 zlib zpl-*
""".split()
VERSION = r"[0-9]+(\.[0-9]+)*"
KNOWN = re.compile("(" + "|".join(re.escape(i).replace(r"\*", VERSION) for i in IDENTIFIERS) + r")(\+|-only|-or-later)?")
# Statements that name no licence of the list: what they allow is not known, so they count as free of nothing.
UNKNOWN = re.compile(r"none|noassertion|(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")

PRIORITY = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")


def freedom(label: str) -> float:
    return next((score for start, score in FREEDOM if label.startswith(start)), 1.0)


def identified(token: str) -> float | None:
    """Freedom of an identifier in lower case: 0 if it names no public licence, None if it is no identifier."""
    if KNOWN.fullmatch(token):
        return freedom(token)
    return 0.0 if UNKNOWN.fullmatch(token) else None


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """(identifiers, freedom) of a licence expression, or None if nothing valid starts it.

    `or` leaves the choice (the freer side counts), `and` binds both (the stricter counts), `with` adds
    an exception to the licence before it. `with` binds before `and`, `and` before `or`. The longest
    valid start counts: text behind it, as the end of a comment, is left out. Words that are no identifiers
    end it. `NONE`, `NOASSERTION` and references to own licences keep their label and are free of nothing.
    """
    best, operators, values = None, [], []
    labels: list[str] = []
    operand = True  # whether a licence or an opening bracket may come

    def apply(operators: list[str], values: list[float]) -> None:
        op, right, left = operators.pop(), values.pop(), values.pop()
        values.append(max(left, right) if op == "or" else min(left, right) if op == "and" else max(left, WITH_EXCEPTION))

    at = 0
    while (m := TOKEN.match(expression, at)) is not None:
        token, at = m[1].lower(), m.end()
        if operand and token == "(":
            operators.append(token)
        elif operand and token not in PRIORITY and token != ")":
            if operators and operators[-1] == "with":
                values.append(0.0)
            elif (value := identified(token)) is None:
                break
            else:
                labels.append(token)
                values.append(value)
            operand = False
        elif not operand and token in PRIORITY:
            while operators and operators[-1] != "(" and PRIORITY[operators[-1]] >= PRIORITY[token]:
                apply(operators, values)
            operators.append(token)
            operand = True
        elif not operand and token == ")" and "(" in operators:
            while operators[-1] != "(":
                apply(operators, values)
            operators.pop()
        else:
            break
        if not operand and "(" not in operators:
            rest, left = operators.copy(), values.copy()
            while rest:
                apply(rest, left)
            best = sorted(set(labels)), left[0]
    return best


def automaton(base: dict[str, str], notices: dict[str, str]) -> ahocorasick.Automaton:
    finds = ahocorasick.Automaton()
    for phrase in {*base, *notices, TAG_WORDS}:
        finds.add_word(f" {phrase} ", phrase)
    finds.make_automaton()
    return finds


def with_cover(places: list[tuple[int, int, str, bool]]) -> list[dict]:
    """Places as rows, by their last word; `covered` are those inside a longer one."""
    covered, reach, longest = set(), -1, 0
    for place in sorted(places, key=lambda p: (p[0], -p[1])):
        if place[0] + place[1] <= reach and place[1] < longest:
            covered.add(place[:2])
        if place[0] + place[1] > reach:
            reach, longest = place[0] + place[1], place[1]
    return [{"word": at, "label": label, "base": of_base, "covered": (at, n) in covered} for at, n, label, of_base in places]


def scan(text: bytes | None, finds: ahocorasick.Automaton, base: dict[str, str], notices: dict[str, str]) -> tuple:
    """(number of words, places, expressions) of a text."""
    words = alnum_words(text)
    line = f" {b' '.join(words).decode()} "
    places, expressions = [], []
    counted = blanks = 0
    for end, phrase in finds.iter(line):  # ends ascend, so blanks are counted once
        blanks += line.count(" ", counted, end + 1)
        counted = end + 1
        if phrase == TAG_WORDS:
            expressions = expressions or [m[1] for m in TAG.finditer(text.decode())]
            continue
        n = phrase.count(" ") + 1
        for phrases, of_base in ((base, True), (notices, False)):
            if phrase in phrases:
                places.append((blanks - 1 - n, n, phrases[phrase], of_base))
    valid = [e for e in map(evaluate, expressions) if e]
    return len(words), with_cover(places), [{"labels": labels, "freedom": value} for labels, value in valid]


def scanner(base: dict[str, str], notices: dict[str, str], schema: pa.Schema):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds = automaton(base, notices)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield batch_of([(i, *scan(t, finds, base, notices)) for i, t in zip(ids, texts_of(batch.column(1)))], schema)

    return run


def scan_licenses(
    docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, places, expressions) for each row of `docs`.

    `places` are the occurrences of base phrases and further notices: (word, label, base, covered),
    overlapping ones too; `covered` are those inside a longer one, as a plain licence's name in a lesser one's. `expressions` are the valid licence expressions behind identifier tags: their identifiers
    in lower case, and their freedom from 0 to 1. Null and empty texts have none. Each row stands alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = (
        f"id {rows.schema['id'].dataType.simpleString()}, n_words long, "
        "places array<struct<word:int,label:string,base:boolean,covered:boolean>>, expressions array<struct<labels:array<string>,freedom:double>>"
    )
    return rows.mapInArrow(scanner(base, notices, arrow_schema(ddl)), ddl)


def license_labels(scanned: DataFrame) -> DataFrame:
    """Adds base_labels, labels (distinct, sorted), and score: the freedom of the strictest statement, 1 without any.

    Places inside a longer one keep their label, and the longer one's freedom counts.
    """
    distinct = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    based = F.filter("places", lambda p: p["base"])
    by_place = F.transform("places", lambda p: p["label"])
    scores = F.transform(
        F.filter("places", lambda p: ~p["covered"]),
        lambda p: F.coalesce(*[F.when(F.startswith(p["label"], F.lit(start)), F.lit(score)) for start, score in FREEDOM], F.lit(1.0)),
    )
    strictest = F.array_min(F.concat(scores, F.transform("expressions", lambda e: e["freedom"])))
    return scanned.withColumns(
        {
            "base_labels": distinct(F.transform(based, lambda p: p["label"])),
            "labels": distinct(F.concat(by_place, F.flatten(F.transform("expressions", lambda e: e["labels"])))),
            "score": F.coalesce(strictest, F.lit(1.0)),
        }
    )
