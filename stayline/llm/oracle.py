"""DuckDB SQL for the queries that SQL can express whole."""

from __future__ import annotations

from . import merkle, quality, url_rules, vector_codes

_WORD = r"[^\x20\x09-\x0D]+"

_URL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.RULES)

OP3 = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_URL_RULES}),
u AS (
  SELECT row_number() OVER () AS rn, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
p AS (
  SELECT rn, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
),
best AS (
  SELECT rn, r_host || r_path AS rule, r_verdict
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  QUALIFY row_number() OVER (PARTITION BY rn ORDER BY length(r_host || r_path) DESC, length(r_host) DESC,
    r_verdict = 'block' DESC, r_host || r_path DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (rn)
"""

_CUTOFFS = ", ".join(
    f"('{r.name}', {i}, CAST({c!r} AS DOUBLE))" for r in quality.RULES for i, c in enumerate(r.cutoffs)
)
_VALUES = " ".join(f"WHEN '{r.name}' THEN {r.over} / nullif({r.under}, 0)" for r in quality.RULES)
_ORDER = " ".join(f"WHEN '{r.name}' THEN {i}" for i, r in enumerate(quality.RULES))
_P = 0.02 / len(quality.RULES)

OP4 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(lang, chr(1) || 'null') AS stratum, coalesce(text, '') AS t FROM documents
),
w AS (SELECT rn, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
pos AS (SELECT rn, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (
  SELECT rn, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS s FROM pos
  WINDOW p AS (PARTITION BY rn ORDER BY i)
),
rep AS (SELECT rn, i FROM tri WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rn, s) > 1),
cov AS (SELECT rn, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY rn),
ln AS (
  SELECT rn, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT rn, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY rn
),
f AS (
  SELECT rn, doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d JOIN w USING (rn) LEFT JOIN ln USING (rn) LEFT JOIN cov USING (rn)
),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
rules(rule, step, cutoff) AS (VALUES {_CUTOFFS}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
v AS (SELECT *, CASE rule {_VALUES} END AS value FROM g CROSS JOIN rules),
n AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
  FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL
),
p AS (
  SELECT *, CASE WHEN k < n * {_P!r} THEN list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P!r}) + (n - j) * ln(1 - {_P!r})))) ELSE 1 END AS p_value,
    (SELECT count(DISTINCT stratum) FROM n) AS strata
  FROM n
),
proven AS (
  SELECT *, bool_and(p_value <= 0.05 / ({len(quality.RULES)} * strata)) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM p
),
cut AS (SELECT stratum, rule, min(cutoff) AS lowest FROM proven WHERE ok GROUP BY ALL),
failed AS (
  SELECT rn, string_agg(rule, ',' ORDER BY CASE rule {_ORDER} END) AS failed_rules
  FROM (SELECT DISTINCT rn, rule FROM v JOIN cut USING (stratum, rule) WHERE value > lowest) GROUP BY rn
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM g LEFT JOIN failed USING (rn)
"""

OP5 = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, '0000' || hex(encode(coalesce(text, ''))) AS h FROM documents),
good AS (
  SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND coalesce(max(toxic), 0) = 0
),
g AS (SELECT rn, doc_id, substr(h, 2 * i + 1, 6) AS gram FROM (SELECT rn, doc_id, h, unnest(range(0, len(h) // 2 - 2)) AS i FROM d)),
c AS (
  SELECT gram, count(*) AS background, count(*) FILTER (doc_id IN (SELECT doc_id FROM good)) AS target FROM g GROUP BY gram
),
counts AS (
  SELECT 't' AS model, gram, CAST(target AS DOUBLE) AS n FROM c
  UNION ALL
  SELECT 'b', gram, background * ((SELECT sum(target) FROM c) / CAST((SELECT sum(background) FROM c) AS DOUBLE)) FROM c
),
sums AS (
  SELECT model, gram, n, sum(n) OVER (PARTITION BY model) AS total, sum(n) OVER (PARTITION BY model, substr(gram, 5, 2)) AS n1,
    sum(n) OVER (PARTITION BY model, substr(gram, 3, 2)) AS c2, sum(n) OVER (PARTITION BY model, substr(gram, 3, 4)) AS n2,
    sum(n) OVER (PARTITION BY model, substr(gram, 1, 4)) AS c3
  FROM counts
),
loss AS (
  SELECT model, gram, -ln((n + 16 * (n2 + 16 * ((n1 + 1) / (total + 256))) / (c2 + 16)) / (c3 + 16)) AS loss FROM sums
),
per_text AS (
  SELECT rn, count(*) AS n_tokens, avg(t.loss) AS target_loss, avg(b.loss) AS background_loss
  FROM g JOIN loss t ON t.gram = g.gram AND t.model = 't' JOIN loss b ON b.gram = g.gram AND b.model = 'b' GROUP BY rn
)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(target_loss, 0), 6) AS target_loss,
  round(coalesce(background_loss, 0), 6) AS background_loss, round(coalesce(target_loss - background_loss, 0), 6) AS score
FROM d LEFT JOIN per_text USING (rn)
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text, md5(coalesce(text, '')) AS digest FROM documents),
u AS (SELECT DISTINCT doc_id, digest, text FROM d WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, digest, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM u
),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id, digest ORDER BY i) AS next FROM l),
later AS (
  SELECT doc_id, digest, i FROM p WHERE next IS NOT NULL AND regexp_matches(line || ' ' || next, '{_WORD}')
  QUALIFY row_number() OVER (PARTITION BY line, next ORDER BY doc_id NULLS FIRST, digest, i) > 1
),
gone AS (SELECT * FROM later UNION SELECT doc_id, digest, i + 1 FROM later),
k AS (
  SELECT l.doc_id, l.digest, count(*) AS n_lines, count(gone.i) AS n_removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id IS NOT DISTINCT FROM gone.doc_id AND l.digest = gone.digest AND l.i = gone.i
  GROUP BY l.doc_id, l.digest
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE n_removed_lines END AS n_removed_lines,
  CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.digest = k.digest
"""

OP2 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rn, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5(coalesce(text, '')) AS digest,
    md5('7:doc:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS draw FROM documents
),
s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
),
s1 AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
levels(level, n) AS (
  SELECT CAST(sum(source_size) AS DOUBLE) / sum(weight), 0 FROM s1
  UNION ALL
  SELECT (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size / weight < level), 0)) /
      CAST(sum(weight) FILTER (3 * source_size / weight >= level) AS DOUBLE) FROM s1), n + 1
  FROM levels WHERE n < 60
),
s AS (SELECT source, source_size, pos, least(3.0 * source_size, (SELECT level FROM levels WHERE n = 60) * weight)::DOUBLE AS target FROM s1),
shards AS (SELECT greatest(1, CAST(ceil(sum(source_size) / 131072.0) AS BIGINT)) AS n FROM s),
p AS (
  SELECT rn, doc_id, size, digest, draw, source_size, target, pos, CAST('0x' || draw[1:8] AS BIGINT) % (SELECT n FROM shards) AS shard
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
),
a AS (
  SELECT shard, pos, source_size, target, CAST(sum(size) AS BIGINT) AS words FROM p GROUP BY ALL HAVING sum(size) > 0
),
b AS (SELECT *, greatest(1, CAST(round(words / 64.0) AS BIGINT)) AS blocks FROM a),
v AS (SELECT *, target * blocks / source_size AS votes FROM b),
q AS (
  SELECT shard, pos, k, row_number() OVER (PARTITION BY shard ORDER BY votes / (2 * k + 1) DESC, k, pos) AS rank
  FROM (SELECT shard, pos, votes, unnest(range(0, 3 * blocks + 20)) AS k FROM v)
),
seats AS (
  SELECT shard, pos, count(*) AS won FROM q
  JOIN (SELECT shard, CAST(round(sum(votes)) AS BIGINT) AS n FROM v GROUP BY shard) USING (shard) WHERE rank <= n GROUP BY ALL
),
parts AS (SELECT shard, pos, words, blocks, least(coalesce(won, 0), 3 * blocks) AS seats FROM v LEFT JOIN seats USING (shard, pos)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY shard, pos ORDER BY md5('7:block:' || shard || ':' || pos || ':' || k), k) AS rank
  FROM (SELECT *, unnest(range(0, blocks)) AS k FROM parts)
),
chosen AS (
  SELECT shard, pos, k * words // blocks AS first, (k + 1) * words // blocks AS last,
    seats // blocks + CASE WHEN rank <= seats % blocks THEN 1 ELSE 0 END AS passes FROM ranked
),
streamed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY shard, pos ORDER BY draw, doc_id NULLS LAST, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM p
),
taken AS (
  SELECT rn, sum(passes * (least(lo + size, last) - greatest(lo, first))) AS taken
  FROM streamed JOIN chosen c ON streamed.shard = c.shard AND streamed.pos = c.pos AND c.first < lo + size AND c.last > lo AND size > 0
  GROUP BY rn
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN taken USING (rn)
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM documents
),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS ws
  FROM benchmark WHERE text IS NOT NULL
),
phrases AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS phrase
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
),
sizes AS (SELECT DISTINCT n FROM phrases),
places AS (
  SELECT rn, n, i, array_to_string(ws[i : i + n - 1], ' ') AS phrase
  FROM (SELECT rn, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
),
hits AS (SELECT rn, i, n, item FROM places JOIN phrases USING (n, phrase)),
words AS (SELECT rn, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT rn, i, n FROM hits), (SELECT unnest(range(0, 10)) AS o) WHERE o < n GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM hits WHERE item IS NOT NULL) GROUP BY rn)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rn) LEFT JOIN items USING (rn)
"""

OP9 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents
),
s AS (
  SELECT DISTINCT rn, array_to_string(ws[i : i + 3], ' ') AS shingle
  FROM (SELECT rn, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
),
n AS (SELECT rn, count(*) AS n FROM s GROUP BY rn),
shared AS (
  SELECT a.rn AS x, b.rn AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.rn < b.rn GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN n a ON a.rn = x JOIN n b ON b.rn = y WHERE 100 * k >= 85 * (a.n + b.n - k)
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (
  SELECT rn, rn FROM d UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
),
least AS (SELECT x AS rn, min(doc_id) AS component_id FROM reach JOIN d ON d.rn = y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (rn) LEFT JOIN least USING (rn)
"""

def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Rounds are the same statement over the codebook before: nearest entries, then their floored means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rn, p, min(d * {entries} + e) AS best FROM (
    SELECT rn, p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN b{i} USING (p, c) GROUP BY ALL
  ) GROUP BY ALL
)""")
        if i < rounds:
            steps.append(f"""s{i} AS (
  SELECT p, best % {entries} AS e, c, count(*) AS n, CAST(sum(x) AS BIGINT) AS s FROM a{i} JOIN x USING (rn, p) GROUP BY ALL
),
b{i + 1} AS MATERIALIZED (
  SELECT p, e, c, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM b{i} LEFT JOIN s{i} USING (p, e, c)
)""")
    chain = ",\n".join(steps)
    return f"""
WITH k AS (
  SELECT row_number() OVER () AS rn, vec_id, label,
    list_transform(embedding, lambda z: CAST(floor({vector_codes.SCALE} * CAST(z AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
),
f AS (SELECT len(v) AS n FROM k ORDER BY vec_id NULLS LAST, v LIMIT 1),
kk AS MATERIALIZED (SELECT * FROM k, f WHERE len(v) = n AND n > 0 AND n % {parts} = 0),
u AS (SELECT rn, n // {parts} AS w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM kk),
x AS MATERIALIZED (SELECT rn, i // w AS p, i % w AS c, x FROM u),
first AS (SELECT rn, row_number() OVER (ORDER BY vec_id NULLS LAST, v, rn) - 1 AS e FROM kk QUALIFY e < {entries}),
b0 AS MATERIALIZED (SELECT p, e, c, x AS y FROM first JOIN x USING (rn)),
{chain},
coded AS (
  SELECT rn, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rn
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, c)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kk USING (rn)
"""


OP12 = _codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _level_sql(n: str, p: str, n1: str, p1: str) -> str:
    """A level of the trees: nodes n(g, r, h) and leaves' places p(rn, g, i, sibs, f) to n1 and p1."""
    run = merkle.RUN
    return f"""m_{n} AS MATERIALIZED (
  SELECT g, r // {run} AS q, list(h ORDER BY r) AS hs, max(c) AS c FROM {n} JOIN (SELECT g, count(*) AS c FROM {n} GROUP BY g) USING (g) GROUP BY ALL
),
{n1} AS MATERIALIZED (SELECT g, q AS r, CASE WHEN c = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM m_{n}),
{p1} AS MATERIALIZED (
  SELECT rn, g, i // {run} AS i,
    CASE WHEN c = 1 THEN sibs ELSE sibs || coalesce(array_to_string(list_filter(hs, lambda x, k: k <> i % {run} + 1), ''), '') END AS sibs,
    CASE WHEN c = 1 THEN f ELSE sha256(array_to_string(list_transform(hs, lambda x, k: CASE WHEN k = i % {run} + 1 THEN f ELSE x END), '')) END AS f
  FROM {p} JOIN m_{n} USING (g) WHERE q = i // {run}
)"""


def _manifest_sql(levels: int, top: int) -> str:
    """Trees of up to 8^levels rows a language and 8^top languages."""
    rows = ",\n".join(_level_sql(f"n{j}", f"p{j}", f"n{j + 1}", f"p{j + 1}") for j in range(levels))
    tops = ",\n".join(_level_sql(f"tn{j}", f"tp{j}", f"tn{j + 1}", f"tp{j + 1}") for j in range(top))
    polynomial, ones = 0xEDB88320, 0xFFFFFFFF
    steps = ", ".join(["ord(z)", *["-1"] * 8])
    crc = f"""xor(list_reduce(CAST([{ones}] AS BIGINT[]) || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST([{steps}] AS BIGINT[]))),
    lambda c, e: CASE WHEN e < 0 THEN xor(c >> 1, {polynomial} * (c & 1)) ELSE xor(c, e) END), {ones})"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id, coalesce('1' || lang, '0') AS g, {_leaf_sql("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {_leaf_sql(lower)} ELSE {_leaf_sql("text")} END AS tampered
  FROM documents
),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf, rn) - 1 AS i FROM d),
n0 AS (SELECT g, i AS r, leaf AS h FROM r),
p0 AS (SELECT rn, g, i, '' AS sibs, tampered AS f FROM r),
{rows},
t AS MATERIALIZED (SELECT g AS lg, row_number() OVER (ORDER BY g) - 1 AS r, h FROM n{levels}),
tn0 AS (SELECT 0 AS g, r, h FROM t),
tp0 AS (SELECT rn, 0 AS g, t.r AS i, sibs, f FROM p{levels} JOIN t ON lg = p{levels}.g),
{tops}
SELECT doc_id, leaf, t.h AS subroot, tn{top}.h AS root, sha256(sibs) AS proof_sha256, f AS folded_root, f = tn{top}.h AS verified
FROM tp{top} JOIN r USING (rn) JOIN t ON lg = r.g, tn{top}
"""


OP13 = _manifest_sql(8, 4)

ORACLE_SQL = {
    "op2_mixing": OP2,
    "op3_url_rules": OP3,
    "op4_quality_rules": OP4,
    "op5_lm_scoring": OP5,
    "op6_line_chunks": OP6,
    "op7_decontamination": OP7,
    "op9_jaccard_join": OP9,
    "op12_vector_codes": OP12,
    "op13_merkle_manifest": OP13,
}
