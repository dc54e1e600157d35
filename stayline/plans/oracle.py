"""SQL counterparts of the registered queries, for DuckDB on the given tables."""

from __future__ import annotations

from ..operators import normality, resampling
from .queries import OTHER_VOCABULARY, REPLICATES, SEED, SLICES
from .views import CLASSES, LEADS, STEPS, VOCABULARY

ORACLE_SQL: dict[str, str] = {}


def _list(codes: list[str]) -> str:
    return "[" + ", ".join(f"'{c}'" for c in codes) + "]"


def _encode(codes: list[str]) -> str:
    return (
        f"list_transform({_list(codes)}, lambda c: CASE WHEN list_contains(icd_raw, c) THEN 1 ELSE 0 END)"
    )


def _text(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


def _whole(expr: str) -> str:
    return _text(f"list_transform({expr}, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1073741824) AS BIGINT))")


def _draw(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || ({key})), 1, 15))::BIGINT"


REC = f"""rec0 AS (
  SELECT event_id AS row_idx, event_id AS study_id, user_id AS subject_id,
    CAST(epoch_us(ts) / 1000000.0 AS DOUBLE) AS ecg_time,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS seq,
    19 - user_id % 20 AS fold,
    [event_type, 'k' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5)] AS icd_raw
  FROM events),
rec AS (SELECT *, {_encode(VOCABULARY)} AS icd FROM rec0)"""

SIG = """sig AS (
  SELECT r.* EXCLUDE vec, embedding AS waveform
  FROM (SELECT rec.*, row_idx % n AS vec FROM rec, (SELECT count(*) AS n FROM embeddings)) r JOIN embeddings ON vec_id = vec)"""

PAIRS = """pairs AS (
  SELECT * FROM (
    SELECT row_idx AS idx_t, lead(row_idx) OVER w AS idx_t1, subject_id, first_value(fold) OVER w AS fold,
      CASE WHEN seq < lead(seq) OVER w THEN 'within_stay' ELSE 'cross_stay' END AS pair_type
    FROM rec WINDOW w AS (PARTITION BY subject_id ORDER BY ecg_time, row_idx))
  WHERE idx_t1 IS NOT NULL)"""

STAYS = """stays AS (
  SELECT row_idx, subject_id, ecg_time, seq,
    sum(CASE WHEN seq = 0 THEN 1 ELSE 0 END) OVER
      (PARTITION BY subject_id ORDER BY ecg_time, row_idx ROWS UNBOUNDED PRECEDING) - 1 AS stay,
    row_number() OVER (PARTITION BY subject_id ORDER BY ecg_time, row_idx) AS place
  FROM rec)"""

CHANGE = """change AS (
  SELECT p.*, a.icd AS y_t, b.icd AS y_t1,
    list_transform(list_zip(a.icd, b.icd), lambda z: greatest(least(z[2] - z[1], 1), -1)) AS a_t
  FROM pairs p JOIN rec a ON a.row_idx = p.idx_t JOIN rec b ON b.row_idx = p.idx_t1)"""

CLASS_LIST = f"(SELECT range AS class_idx FROM range({CLASSES})) classes"

CELLS = f"""cells AS (
  SELECT idx_t, fold, pair_type, class_idx, y_t[class_idx + 1] AS y_t, y_t1[class_idx + 1] AS y_t1,
    a_t[class_idx + 1] AS a_t
  FROM change, {CLASS_LIST}),
test_cells AS (SELECT * FROM cells WHERE fold = 19 AND pair_type = 'cross_stay')"""

LABEL_CELLS = f"""label_cells AS (
  SELECT row_idx, class_idx, icd[class_idx + 1] AS target,
    ((row_idx * 7919 + class_idx * 101) % 1000)::DOUBLE / 1000.0 AS score
  FROM rec, {CLASS_LIST})"""

PREDICTIONS = """pred AS (
  SELECT *, ((idx_t * 7919 + class_idx * 101) % 1000)::DOUBLE / 1000.0 AS onset,
    ((idx_t * 104729 + class_idx * 211) % 1000)::DOUBLE / 1000.0 AS resolution
  FROM test_cells)"""

EMB_PAIRS = """ends AS (
  SELECT idx_t, a.embedding AS h_t, b.embedding AS h_t1
  FROM (SELECT pairs.*, idx_t % n AS vec_t, idx_t1 % n AS vec_t1 FROM pairs, (SELECT count(*) AS n FROM embeddings)) p
  JOIN embeddings a ON a.vec_id = vec_t JOIN embeddings b ON b.vec_id = vec_t1)"""

LEAD_STATS = f"""stats AS (
  SELECT row_idx, lead, avg(x) AS mean, stddev_pop(x) AS std FROM (
    SELECT row_idx, i % {LEADS} AS lead, waveform[i + 1]::DOUBLE AS x
    FROM sig, (SELECT range AS i FROM range(64)) s)
  GROUP BY row_idx, lead)"""


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 8) + 0.0 AS {name}"


def sql(name: str, body: str, *views: str) -> None:
    recursive = "RECURSIVE " if any("FROM tree" in v for v in views) else ""
    ORACLE_SQL[name] = (f"WITH {recursive}{', '.join(views)}\n" if views else "") + body


def auroc(cells: str, keys: str = "", weight: str = "1") -> str:
    """Views score_sums, ranked and aucs over cells(keys, class_idx, score, target)."""
    k = f"{keys}, " if keys else ""
    return f"""score_sums AS (
  SELECT {k}class_idx, score, sum(({weight}) * target)::DOUBLE AS pos,
    sum(({weight}) * (1 - target))::DOUBLE AS neg
  FROM {cells} GROUP BY {k}class_idx, score),
ranked AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k}class_idx ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM score_sums),
aucs AS (
  SELECT {k}class_idx, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc
  FROM ranked GROUP BY {k}class_idx HAVING sum(pos) > 0 AND sum(neg) > 0)"""


def draws(rows: str, row: str) -> str:
    """Views positions and draws over the distinct rows."""
    return f"""positions AS (
  SELECT {row}, row_number() OVER (ORDER BY {row}) - 1 AS pos FROM (SELECT DISTINCT {row} FROM {rows})),
size AS (SELECT count(*) AS n FROM positions),
drawn AS (
  SELECT i // n AS replicate, {_draw("i", SEED)} % n AS pos
  FROM (SELECT unnest(range(n * {REPLICATES})) AS i, n FROM size)),
draws AS (
  SELECT replicate, {row}, count(*) AS weight FROM drawn JOIN positions USING (pos) GROUP BY ALL)"""


def tree_draws(rows: str, row: str) -> str:
    """Views positions and draws as `resampling` makes them: every row of the recursion compares one more bit of
    all its draws with the share of the left half, or, when that is settled, gives its two halves."""
    R = resampling
    whole = "18446744073709551616::UHUGEINT"  # 2^64
    spread = {k: f"{v}::UHUGEINT" for k, v in R.SPREAD.items()}
    parts = {"seed": str(SEED), "replicate": "replicate", "node": "node", "step": "step", "word": "w"}
    x = "((" + " + ".join(f"{e}::UHUGEINT * {spread[k]}" for k, e in parts.items()) + f") % {whole})::UBIGINT"
    x = f"[{x}]"
    for i, (shift, factor) in enumerate(R.ROUNDS):
        x = f"list_transform({x}, lambda x{i}: ((xor(x{i}, x{i} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {whole})::UBIGINT)"
    bits = f"list_transform({x}, lambda y: xor(y, y >> {R.LAST_SHIFT}))[1]"
    ones = f"""list_sum(list_transform(range((open + 63) // 64),
      lambda w: bit_count((({bits}) >> CAST(64 - least(open - 64 * w, 64) AS INTEGER))::HUGEINT)))::BIGINT"""

    def half(size: str) -> str:
        return f"CASE WHEN {size} > 1 THEN 1::BIGINT << (length(ltrim(bin({size} - 1), '0')) - 1) ELSE 0 END"

    def part(node: str, first: str, size: str, c: str) -> str:
        return f"{{'node': {node}, 'first': {first}, 'size': {size}, 'c': {c}, 'rest': {half(size)}, 'open': {c}, 'won': 0::BIGINT, 'step': 0::BIGINT}}"

    return f"""positions AS (
  SELECT {row}, row_number() OVER (ORDER BY {row}) - 1 AS pos FROM (SELECT DISTINCT {row} FROM {rows})),
tree AS (
  SELECT replicate, n.* FROM (SELECT range AS replicate FROM range({REPLICATES})) r,
    (SELECT {part("1::BIGINT", "0::BIGINT", "n", "n")} AS n FROM (SELECT count(*) AS n FROM positions) WHERE n > 0)
  UNION ALL
  SELECT replicate, n.* FROM (
    SELECT replicate, unnest(CASE
      WHEN going THEN [{{'node': node, 'first': first, 'size': size, 'c': c, 'rest': 2 * rest - b * size,
        'open': CASE WHEN b = 1 THEN ones ELSE open - ones END, 'won': won + b * (open - ones), 'step': step + 1}}]
      ELSE [{part("2 * node", "first", "h", "won")}, {part("2 * node + 1", "first + h", "size - h", "c - won")}] END) AS n
    FROM (
      SELECT *, open > 0 AND rest > 0 AS going, CASE WHEN 2 * rest >= size THEN 1 ELSE 0 END AS b, {half("size")} AS h,
        CASE WHEN open > 0 AND rest > 0 THEN {ones} ELSE 0 END AS ones
      FROM tree WHERE size > 1)
  ) WHERE n.c > 0),
draws AS (SELECT replicate, {row}, c AS weight FROM tree JOIN positions ON pos = first WHERE size = 1)"""


# Sources and sinks.

sql(
    "read_metadata",
    """SELECT row_idx, study_id, subject_id, seq::BIGINT AS ecg_no_within_stay, fold::BIGINT AS fold,
  row_idx AS h5_index FROM rec""",
    REC,
)
sql(
    "read_recordings",
    f"SELECT row_idx, subject_id, ecg_time, fold::BIGINT AS fold FROM rec WHERE fold = 19 AND seq = 0",
    REC,
)
sql("read_array_table", f"SELECT row_idx AS src_index, {_text('icd')} AS labels FROM rec", REC)
#: The signal with its steps in reverse order.
TURNED = f"flatten(list_transform(range({STEPS}), lambda t: waveform[({STEPS} - 1 - t) * {LEADS} + 1 : ({STEPS} - t) * {LEADS}]))"
WHOLE_ROWS = f"""SELECT row_idx, study_id, subject_id, ecg_time, seq::BIGINT AS ecg_no_within_stay,
  fold::BIGINT AS fold, {_text('icd_raw')} AS icd_raw, {_text('icd')} AS icd, {_whole('waveform')} AS waveform FROM sig"""
sql(
    "write_recordings",
    WHOLE_ROWS,
    REC,
    SIG,
)
sql("append_batches", WHOLE_ROWS, REC, SIG)
PAIR_ROWS = "SELECT idx_t, idx_t1, subject_id, fold::BIGINT AS fold, pair_type FROM pairs"
sql("write_pairs", PAIR_ROWS, REC, PAIRS)
sql("update_pair_index", PAIR_ROWS, REC, PAIRS)
sql(
    "vocabulary",
    f"""SELECT class_idx, code, rows FROM
  (SELECT unnest({_list(VOCABULARY)}) AS code, unnest(range({CLASSES})) AS class_idx) v
  JOIN (SELECT code, count(*) AS rows FROM (SELECT unnest(icd_raw) AS code FROM rec) GROUP BY code) USING (code)""",
    REC,
)

# Assembly and projections.

sql(
    "assemble_recordings",
    f"""SELECT row_idx, study_id, subject_id, seq::BIGINT AS ecg_no_within_stay, fold::BIGINT AS fold,
  ecg_time,
  {_text(f"list_filter({_list(VOCABULARY)}, lambda c: list_contains(icd_raw, c))")} AS icd_raw,
  {_text('icd')} AS icd, {_whole('waveform')} AS waveform FROM sig""",
    REC,
    SIG,
)
sql(
    "verify_build",
    f"""SELECT * FROM (
  SELECT 'counts' AS "check", 'recordings' AS finding, count(*) AS rows FROM rec HAVING count(*) <> count(*) FILTER (fold <> 10)
  UNION ALL SELECT 'cells', CASE WHEN fold = 10 THEN 'only_a' ELSE 'waveform' END, count(*) FROM sig
    WHERE fold = 10 OR (fold = 11 AND {_whole('waveform')} <> {_whole(TURNED)}) GROUP BY ALL
  UNION ALL SELECT 'pairs', 'number does not rise', count(*) FROM pairs WHERE idx_t % 3 = 0 AND pair_type = 'cross_stay' HAVING count(*) > 0) f""",
    REC,
    SIG,
    PAIRS,
)
sql(
    "build_tables",
    """SELECT "table", kind, rows, pairs_only FROM (
  SELECT 'recordings' AS "table", CASE WHEN fold <= 17 THEN 'train' WHEN fold = 18 THEN 'val' ELSE 'test' END AS kind,
    count(*) AS rows FROM rec GROUP BY 2
  UNION ALL SELECT 'pairs', pair_type, count(*) FROM pairs GROUP BY 2) t, (VALUES (false), (true)) p(pairs_only)""",
    REC,
    PAIRS,
)
sql(
    "with_row_index",
    f"""SELECT study_id, subject_id, ecg_time,
  row_number() OVER (ORDER BY subject_id, ecg_time, study_id) - 1 AS row_idx FROM rec""",
    REC,
)
sql(
    "frames",
    f"""SELECT vec_id, step, {_whole(f"waveform[step * {LEADS} + 1 : step * {LEADS} + {LEADS}]")} AS frame,
  {_whole('waveform')} AS flat FROM (SELECT vec_id, embedding AS waveform FROM embeddings), (SELECT range AS step FROM range(16))""",
)
sql(
    "conform",
    f"""SELECT row_idx, study_id, subject_id, ecg_time, seq::BIGINT AS ecg_no_within_stay,
  fold::BIGINT AS fold, {_text('icd_raw')} AS icd_raw, {_text('icd')} AS icd, {_whole('waveform')} AS waveform FROM sig""",
    REC,
    SIG,
)

# Labels.

DECODE = f"list_filter({_list(VOCABULARY)}, lambda c: list_contains(icd_raw, c))"
sql("encode_label_codes", f"SELECT row_idx, {_text('icd')} AS icd FROM rec", REC)
sql("decode_label_vectors", f"SELECT row_idx, {_text(DECODE)} AS codes FROM rec", REC)
sql(
    "add_label_column",
    f"""SELECT row_idx, {_text('icd_raw')} AS icd_raw, {_text('icd')} AS icd,
  {_text(_encode(OTHER_VOCABULARY))} AS icd_other FROM rec""",
    REC,
)
sql(
    "explode_labels",
    f"SELECT row_idx, class_idx, icd[class_idx + 1]::BIGINT AS y FROM rec, {CLASS_LIST}",
    REC,
)

# Pairs and stays.

sql("build_pairs", PAIR_ROWS, REC, PAIRS)
sql("pair_type_counts", "SELECT pair_type, count(*) AS pairs FROM pairs GROUP BY pair_type", REC, PAIRS)
sql("assign_stays", "SELECT row_idx, subject_id, stay::BIGINT AS stay FROM stays", REC, STAYS)
sql(
    "select_subjects",
    """SELECT subject_id, count(*) AS stays, max(n) AS max_per_stay, sum(n)::BIGINT AS rows
  FROM (SELECT subject_id, stay, count(*) AS n FROM stays GROUP BY ALL)
  GROUP BY subject_id HAVING count(*) BETWEEN 24 AND 26 AND max(n) >= 5
  ORDER BY stays DESC, rows DESC, subject_id LIMIT 5""",
    REC,
    STAYS,
)
sql(
    "subject_timeline",
    f"""SELECT row_idx, subject_id, ecg_time, seq::BIGINT AS ecg_no_within_stay,
  stay::BIGINT AS stay, 'x' || place AS tag FROM stays WHERE subject_id = 7""",
    REC,
    STAYS,
)
sql(
    "filter_pairs",
    "SELECT idx_t, idx_t1, subject_id FROM pairs WHERE fold = 19 AND pair_type = 'cross_stay'",
    REC,
    PAIRS,
)
sql(
    "fetch_pairs",
    f"""SELECT idx_t, idx_t1, {_text('a.icd')} AS icd_t, {_text('b.icd')} AS icd_t1,
  a.ecg_time AS ecg_time_t, b.ecg_time AS ecg_time_t1
  FROM pairs JOIN rec a ON a.row_idx = idx_t JOIN rec b ON b.row_idx = idx_t1""",
    REC,
    PAIRS,
)
WHOLE_PAIRS = f"""SELECT idx_t, idx_t1, {_text('a.icd')} AS icd_t, {_text('b.icd')} AS icd_t1,
  a.ecg_time AS ecg_time_t, b.ecg_time AS ecg_time_t1, {_whole('a.waveform')} AS waveform_t, {_whole('b.waveform')} AS waveform_t1
  FROM pairs JOIN sig a ON a.row_idx = idx_t JOIN sig b ON b.row_idx = idx_t1"""
sql("fetch_pairs_together", WHOLE_PAIRS, REC, SIG, PAIRS)
sql("fetch_pairs_of_cut_subjects", WHOLE_PAIRS, REC, SIG, PAIRS)
sql("read_linked_pairs", WHOLE_PAIRS + " WHERE pairs.fold <= 17 AND pair_type = 'cross_stay'", REC, SIG, PAIRS)
sql("transition_vectors", f"SELECT idx_t, {_text('a_t')} AS a_t FROM change", REC, PAIRS, CHANGE)
sql(
    "transition_values",
    "SELECT value::BIGINT AS value, count(*) AS cells FROM (SELECT unnest(a_t) AS value FROM change) GROUP BY value",
    REC,
    PAIRS,
    CHANGE,
)
sql("next_label_vectors", f"SELECT idx_t, {_text('y_t1')} AS y_next FROM change", REC, PAIRS, CHANGE)
sql(
    "transition_target_vectors",
    f"""SELECT idx_t, {_text("list_transform(a_t, lambda a: CASE WHEN a = 1 THEN 1 ELSE 0 END)")} AS onset,
  {_text("list_transform(a_t, lambda a: CASE WHEN a = -1 THEN 1 ELSE 0 END)")} AS resolution FROM change""",
    REC,
    PAIRS,
    CHANGE,
)
CAME = f"list_filter({_list(VOCABULARY)}, lambda c: list_contains(b.icd_raw, c) AND NOT list_contains(a.icd_raw, c))"
WENT = f"list_filter({_list(VOCABULARY)}, lambda c: list_contains(a.icd_raw, c) AND NOT list_contains(b.icd_raw, c))"
sql(
    "describe_pairs",
    f"""SELECT idx_t, idx_t1, p.subject_id, pair_type, a.study_id AS study_id_t, b.study_id AS study_id_t1,
  a.ecg_time AS ecg_time_t, b.ecg_time AS ecg_time_t1, {_text('a.icd_raw')} AS codes_t,
  {_text('b.icd_raw')} AS codes_t1, {_text(CAME)} AS onset_codes, {_text(WENT)} AS resolved_codes
  FROM pairs p JOIN rec a ON a.row_idx = idx_t JOIN rec b ON b.row_idx = idx_t1""",
    REC,
    PAIRS,
)

# Splits, selection, sampling, batching.

sql(
    "split_rows",
    """SELECT row_idx, subject_id, fold::BIGINT AS fold,
  CASE WHEN fold <= 17 THEN 'train' WHEN fold = 18 THEN 'val' ELSE 'test' END AS split FROM rec""",
    REC,
)
sql(
    "select_mode",
    """SELECT row_idx, subject_id, ecg_time, CASE WHEN fold <= 17 THEN 'train' WHEN fold = 18 THEN 'val' ELSE 'test' END AS split, mode
  FROM rec, (VALUES ('triage'), ('monitoring')) m(mode) WHERE mode = 'monitoring' OR seq = 0""",
    REC,
)


def kept(source: str) -> str:
    return f"""subjects AS (
  SELECT subject_id, row_number() OVER (ORDER BY {_draw('subject_id', 0)}, subject_id) AS place,
    count(*) OVER () AS n
  FROM (SELECT DISTINCT subject_id FROM {source})),
kept AS (SELECT subject_id FROM subjects WHERE place <= greatest(1, floor(n * 0.3::DOUBLE)))"""


sql(
    "subject_fraction",
    "SELECT row_idx, subject_id FROM chosen WHERE seq = 0 AND subject_id IN (FROM kept)",
    REC,
    "chosen AS (SELECT * FROM rec WHERE fold <= 17)",
    kept("chosen"),
)
sql(
    "subject_fraction_of_pairs",
    "SELECT idx_t, idx_t1, subject_id FROM chosen WHERE subject_id IN (FROM kept)",
    REC,
    PAIRS,
    "chosen AS (SELECT * FROM pairs WHERE fold <= 17 AND pair_type = 'cross_stay')",
    kept("chosen"),
)
sql(
    "take_rows",
    f"""SELECT ids.pos, ids.row_idx, subject_id, {_text('icd')} AS icd
  FROM (SELECT row_idx AS pos, {_draw('row_idx', 3)} % (SELECT count(*) FROM rec) AS row_idx FROM rec) ids
  JOIN rec ON rec.row_idx = ids.row_idx""",
    REC,
)
sql(
    "take_stored_rows",
    f"""SELECT ids.pos, ids.row_idx, subject_id, {_text('icd')} AS icd
  FROM (SELECT row_idx AS pos, {_draw('row_idx', 3)} % (SELECT count(*) FROM rec) AS row_idx FROM rec) ids
  JOIN rec ON rec.row_idx = ids.row_idx""",
    REC,
)
sql(
    "sample_rows",
    f"SELECT row_idx, subject_id FROM rec ORDER BY {_draw('row_idx', 42)}, row_idx LIMIT 2000",
    REC,
)
sql(
    "sample_rows_with_replacement",
    f"""SELECT pos, row_idx, subject_id
  FROM (SELECT range AS pos, {_draw('range', 1)} % (SELECT count(*) FROM rec) AS row_idx FROM range(2000)) d
  JOIN rec USING (row_idx)""",
    REC,
)
sql(
    "sample_per_group",
    f"""SELECT idx_t, idx_t1, subject_id, fold::BIGINT AS fold, pair_type FROM pairs
  QUALIFY row_number() OVER (PARTITION BY pair_type ORDER BY {_draw('idx_t', 2)}, idx_t) <= 10""",
    REC,
    PAIRS,
)
sql(
    "assign_batches",
    f"""SELECT row_idx, pos, pos // 256 AS batch FROM (
    SELECT row_idx, row_number() OVER (ORDER BY {_draw('row_idx', 7)}, row_idx) - 1 AS pos, count(*) OVER () AS n
    FROM rec WHERE fold <= 17)
  WHERE pos // 256 < n // 256""",
    REC,
)
sql(
    "assign_batches_in_order",
    """SELECT row_idx, pos, pos // 256 AS batch
  FROM (SELECT row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS pos FROM rec WHERE fold = 19)""",
    REC,
)

# Signals.

BY_LEAD = f"""SELECT vec_id, i % {LEADS} AS lead, i // {LEADS} AS step, embedding[i + 1]::DOUBLE AS x
  FROM embeddings, (SELECT range AS i FROM range(64)) s"""
for name in ("lead_major_signals", "lead_major_signal_batches"):
    sql(name, f"SELECT vec_id, lead, step, {_r('x', 'value')} FROM ({BY_LEAD})")
sql(
    "zscore_signals",
    f"""SELECT vec_id, lead, step, {_r(
      "(x - avg(x) OVER w) / greatest(stddev_samp(x) OVER w, 0.000001)", "value")}
  FROM ({BY_LEAD}) WINDOW w AS (PARTITION BY vec_id, lead)""",
)
sql(
    "zscore_signal_batches",
    f"""SELECT vec_id, lead, step, round(((x - avg(x) OVER w) / greatest(stddev_samp(x) OVER w, 0.000001))::FLOAT::DOUBLE, 5) + 0.0 AS value
  FROM ({BY_LEAD}) WINDOW w AS (PARTITION BY vec_id, lead)""",
)
sql(
    "uneven_signals",
    f"""SELECT vec_id, true AS same, lead, step, {_r('x', 'value')} FROM ({BY_LEAD}) WHERE vec_id % 5 IN (0, 4)
  UNION ALL SELECT vec_id, true, NULL, NULL, NULL FROM embeddings WHERE vec_id % 5 NOT IN (0, 4)""",
)
sql(
    "lead_stats",
    f"SELECT row_idx, lead, {_r('mean', 'mean')}, {_r('std', 'std')} FROM stats",
    REC,
    SIG,
    LEAD_STATS,
)
POINTS = ", ".join(_r(f"quantile_cont(value, {p / 100})", f"p{p}") for p in (1, 5, 25, 50, 75, 95, 99))
sql(
    "stats_summary",
    f"""SELECT stat, {_r('avg(value)', 'mean')}, {_r('stddev_pop(value)', 'std')}, {POINTS}
  FROM (SELECT 'mean' AS stat, mean AS value FROM stats UNION ALL SELECT 'std', std FROM stats) GROUP BY stat""",
    REC,
    SIG,
    LEAD_STATS,
)
sql(
    "lead_breakdown",
    f"""SELECT lead, {_r('avg(mean)', 'mean_of_means')}, {_r('stddev_pop(mean)', 'std_of_means')},
  {_r('avg(std)', 'mean_of_stds')}, {_r('stddev_pop(std)', 'std_of_stds')},
  ['I', 'II', 'III', 'aVR'][lead + 1] AS lead_name FROM stats GROUP BY lead""",
    REC,
    SIG,
    LEAD_STATS,
)
sql(
    "normalization_verdict",
    f"""SELECT {_r('m', 'mean_offset')}, {_r('s', 'std_offset')}, m < 0.05 AND s < 0.05 AS pre_normalized
  FROM (SELECT abs(avg(mean)) AS m, abs(avg(std) - 1) AS s FROM stats)""",
    REC,
    SIG,
    LEAD_STATS,
)

STEPPED = "(SELECT range AS i FROM range(64)) s"
sql(
    "single_samples",
    f"""SELECT row_idx, {_text('icd')} AS label, i % {LEADS} AS lead, i // {LEADS} AS step, {_r('waveform[i + 1]::DOUBLE', 'value')}
  FROM chosen, {STEPPED} WHERE seq = 0 AND subject_id IN (FROM kept)""",
    REC,
    SIG,
    "chosen AS (SELECT * FROM sig WHERE fold <= 17)",
    kept("chosen"),
)
sql(
    "pair_samples",
    f"""SELECT idx_t, idx_t1, {_text('y_t')} AS y_t, {_text('a_t')} AS a_t, i % {LEADS} AS lead, i // {LEADS} AS step,
  {_r('h_t[i + 1]::DOUBLE', 'x_t')}, {_r('h_t1[i + 1]::DOUBLE', 'x_t1')}
  FROM chosen JOIN ends USING (idx_t), {STEPPED} WHERE subject_id IN (FROM kept)""",
    REC,
    PAIRS,
    CHANGE,
    EMB_PAIRS,
    "chosen AS (SELECT * FROM change WHERE fold <= 17 AND pair_type = 'cross_stay')",
    kept("chosen"),
)

# Scoring.

sql(
    "score_model",
    f"SELECT vec_id, {_r('list_avg(list_transform(embedding, lambda x: x::DOUBLE))', 'score')} FROM embeddings",
)


def weight(i: str, j: str, salt: int = 0) -> str:
    return f"((({i}) * 31 + ({j}) * 17 + {salt}) % 13 - 6)::DOUBLE / 13.0::DOUBLE"


def bias(i: str) -> str:
    return f"(({i}) % 5 - 2)::DOUBLE / 10.0::DOUBLE"


sql(
    "linear_head",
    f"""SELECT vec_id, class_idx, {_r('x', 'logits')}, {_r('1 / (1 + exp(-x))', 'probs')} FROM (
  SELECT vec_id, class_idx, sum(embedding[d + 1]::DOUBLE * {weight('class_idx', 'd')}) + {bias('class_idx')} AS x
  FROM embeddings, {CLASS_LIST}, (SELECT range AS d FROM range(64)) dims GROUP BY vec_id, class_idx)""",
)


def layer(name: str, source: str, rows: int, cols: int, salt: int, relu: bool, skip: str = "") -> str:
    """A view (id, j, x): one linear layer over source(id, j, x)."""
    x = f"sum(s.x * {weight('o.j', 's.j', salt)}) + {bias('o.j')}"
    if skip:
        x = f"any_value(k.x) + {x}"
    x = f"greatest({x}, 0)" if relu else x
    join = f"JOIN {skip} k ON k.id = s.id AND k.j = o.j" if skip else ""
    return f"""{name} AS (
  SELECT s.id, o.j, {x} AS x
  FROM {source} s CROSS JOIN (SELECT range AS j FROM range({rows})) o {join} GROUP BY s.id, o.j)"""


def vector(name: str, source: str, expr: str, dim: int, key: str = "idx_t") -> str:
    return f"{name} AS (SELECT {key} AS id, j, ({expr})::DOUBLE AS x FROM {source}, (SELECT range AS j FROM range({dim})) dims)"


def values(source: str, name: str) -> str:
    return f"SELECT id AS idx_t, j, round(x, 6) + 0.0 AS {name} FROM {source}"


PROJECTOR = [
    vector("a0", "change", "a_t[j + 1]", CLASSES),
    layer("a1", "a0", 16, CLASSES, 5, True),
    layer("a2", "a1", 16, 16, 6, True),
    layer("emb", "a2", 16, 16, 7, False),
]
TRUNK = [
    layer("t1", "t0", 32, 0, 1, True),
    layer("t2", "t1", 32, 32, 2, True),
    layer("trunk", "t2", 32, 32, 3, True, skip="t1"),
]
sql("action_projector", values("emb", "action_emb"), REC, PAIRS, CHANGE, *PROJECTOR)
sql(
    "dynamics_predictor",
    values("ahead", "h_t1_hat"),
    REC,
    SIG,
    PAIRS,
    CHANGE,
    EMB_PAIRS,
    *PROJECTOR,
    vector("h0", "ends", "h_t[j + 1]", 64),
    "t0 AS (SELECT * FROM h0 UNION ALL SELECT id, j + 64, x FROM emb)",
    *TRUNK,
    layer("ahead", "trunk", 64, 32, 4, False),
)
sql(
    "action_predictor",
    f"""SELECT o.idx_t, o.j, onset_logits, resolution_logits
  FROM ({values('onset_head', 'onset_logits')}) o JOIN ({values('resolution_head', 'resolution_logits')}) r
  ON o.idx_t = r.idx_t AND o.j = r.j""",
    REC,
    SIG,
    PAIRS,
    EMB_PAIRS,
    vector("t0", "ends", "h_t1[j + 1] - h_t[j + 1]", 64),
    *TRUNK,
    layer("onset_head", "trunk", CLASSES, 32, 4, False),
    layer("resolution_head", "trunk", CLASSES, 32, 8, False),
)
HEADS = [
    vector("t0", "ends", "h_t1[j + 1] - h_t[j + 1]", 64),
    *TRUNK,
    layer("onset_head", "trunk", CLASSES, 32, 4, False),
    layer("resolution_head", "trunk", CLASSES, 32, 8, False),
    """heads AS (
  SELECT o.id AS idx_t, o.j AS class_idx, o.x AS onset_logit, r.x AS resolution_logit
  FROM onset_head o JOIN resolution_head r ON o.id = r.id AND o.j = r.j)""",
]
sql(
    "transition_probabilities",
    f"""SELECT idx_t, class_idx, {_r('1 / (1 + exp(-onset_logit))', 'onset')},
  {_r('1 / (1 + exp(-resolution_logit))', 'resolution')} FROM heads""",
    REC,
    PAIRS,
    EMB_PAIRS,
    *HEADS,
)
sql(
    "embedding_displacement",
    f"SELECT idx_t, i AS dim, {_r('h_t1[i + 1]::DOUBLE - h_t[i + 1]::DOUBLE', 'value')} FROM ends, {STEPPED}",
    REC,
    PAIRS,
    EMB_PAIRS,
)
CONTEXT = "(y_t * (1 - resolution) + (1 - y_t) * onset)"
sql(
    "contextual_predictions",
    f"SELECT idx_t, class_idx, {_r(CONTEXT, 'score')} FROM pred",
    REC,
    PAIRS,
    CHANGE,
    CELLS,
    PREDICTIONS,
)

# Metrics, losses, baselines.

MACRO = f"SELECT {_r('avg(auroc)', 'macro_auroc')}, count(*) AS classes FROM aucs"
BY_CLASS = f"SELECT class_idx, {_r('auroc', 'auroc')} FROM aucs"
sql("auroc_by_class", BY_CLASS, REC, LABEL_CELLS, auroc("label_cells"))
sql("macro_auroc", MACRO, REC, LABEL_CELLS, auroc("label_cells"))
sql(
    "macro_auroc_of_labels",
    MACRO,
    """doc_cells AS (
  SELECT 0 AS class_idx, (doc_id * 7919 % 1000)::DOUBLE / 1000.0 AS score, quality AS target FROM labels
  UNION ALL SELECT 1, (doc_id * 7919 % 1000)::DOUBLE / 1000.0, toxic FROM labels)""",
    auroc("doc_cells"),
)
TEST = (REC, PAIRS, CHANGE, CELLS)
sql("bootstrap_draws", "SELECT replicate, idx_t, weight FROM draws", *TEST, draws("test_cells", "idx_t"))
INTERVAL = f"""{_r('avg(m)', 'mean')}, {_r('quantile_cont(m, 0.025)', 'lo')}, {_r('quantile_cont(m, 0.975)', 'hi')},
  count(*) AS replicates"""
sql("tree_draws", "SELECT replicate, idx_t, weight FROM draws", *TEST, tree_draws("test_cells", "idx_t"))
for name, drawn in (("bootstrap_auroc", draws), ("bootstrap_auroc_blocks", draws), ("bootstrap_auroc_tree", tree_draws)):
    sql(
        name,
        f"SELECT {INTERVAL} FROM (SELECT replicate, avg(auroc) AS m FROM aucs GROUP BY replicate)",
        *TEST,
        drawn("test_cells", "idx_t"),
        """weighed AS (
  SELECT replicate, class_idx, y_t AS score, y_t1 AS target, weight FROM test_cells JOIN draws USING (idx_t))""",
        auroc("weighed", "replicate", "weight"),
    )
for name, score, target in (
    ("carry_forward", "y_t", "y_t1"),
    ("onset_structural", "1 - y_t", "CASE WHEN a_t = 1 THEN 1 ELSE 0 END"),
    ("resolution_structural", "y_t", "CASE WHEN a_t = -1 THEN 1 ELSE 0 END"),
):
    scored = f"scored AS (SELECT class_idx, {score} AS score, {target} AS target FROM test_cells)"
    sql(name, BY_CLASS, *TEST, scored, auroc("scored"))
    if name == "carry_forward":
        sql("carry_forward_macro", MACRO, *TEST, scored, auroc("scored"))
sql(
    "evaluate_predictions",
    f"SELECT {INTERVAL} FROM (SELECT replicate, avg(auroc) AS m FROM aucs GROUP BY replicate)",
    REC,
    SIG,
    f"""scored AS (
  SELECT row_idx, class_idx, any_value(icd[class_idx + 1]) AS target, round(1 / (1 + exp(-(
    sum(waveform[d + 1]::DOUBLE * {weight('class_idx', 'd')}) + {bias('class_idx')}))), 9) AS score
  FROM sig, {CLASS_LIST}, (SELECT range AS d FROM range(64)) dims
  WHERE fold = 19 AND seq = 0 GROUP BY row_idx, class_idx)""",
    draws("scored", "row_idx"),
    "weighed AS (SELECT * FROM scored JOIN draws USING (row_idx))",
    auroc("weighed", "replicate", "weight"),
)
sql(
    "evaluate_transitions",
    f"SELECT task, {INTERVAL} FROM (SELECT task, replicate, avg(auroc) AS m FROM aucs GROUP BY ALL) GROUP BY task",
    *TEST,
    PREDICTIONS,
    f"""task_cells AS (
  SELECT idx_t, 'onset' AS task, class_idx, onset AS score, CASE WHEN a_t = 1 THEN 1 ELSE 0 END AS target FROM pred
  UNION ALL
  SELECT idx_t, 'resolution', class_idx, resolution, CASE WHEN a_t = -1 THEN 1 ELSE 0 END FROM pred
  UNION ALL
  SELECT idx_t, 'contextual', class_idx, {CONTEXT}, y_t1 FROM pred)""",
    draws("test_cells", "idx_t"),
    "weighed AS (SELECT * FROM task_cells JOIN draws USING (idx_t))",
    auroc("weighed", "task, replicate", "weight"),
)
sql(
    "evaluate_inverse",
    f"SELECT task, {INTERVAL} FROM (SELECT task, replicate, avg(auroc) AS m FROM aucs GROUP BY ALL) GROUP BY task",
    *TEST,
    EMB_PAIRS.replace("SELECT pairs.*", "SELECT test_ends.*").replace("FROM pairs,", "FROM (SELECT * FROM pairs WHERE fold = 19 AND pair_type = 'cross_stay') test_ends,"),
    *HEADS,
    """pred AS (
  SELECT c.*, round(1 / (1 + exp(-onset_logit)), 9) AS onset, round(1 / (1 + exp(-resolution_logit)), 9) AS resolution
  FROM test_cells c JOIN heads USING (idx_t, class_idx))""",
    f"""task_cells AS (
  SELECT idx_t, 'onset' AS task, class_idx, onset AS score, CASE WHEN a_t = 1 THEN 1 ELSE 0 END AS target FROM pred
  UNION ALL
  SELECT idx_t, 'resolution', class_idx, resolution, CASE WHEN a_t = -1 THEN 1 ELSE 0 END FROM pred
  UNION ALL
  SELECT idx_t, 'contextual', class_idx, {CONTEXT}, y_t1 FROM pred)""",
    draws("test_cells", "idx_t"),
    "weighed AS (SELECT * FROM task_cells JOIN draws USING (idx_t))",
    auroc("weighed", "task, replicate", "weight"),
)
BCE = "avg((1 - y) * x + (1 + (w - 1) * y) * (ln(1 + exp(-abs(x))) + greatest(-x, 0)))"
sql(
    "bce_with_logits",
    f"""SELECT w AS pos_weight, {_r(BCE, 'loss')}
  FROM (SELECT 8 * score - 4 AS x, target AS y FROM label_cells) c, (SELECT unnest([1.0::DOUBLE, 46.0::DOUBLE]) AS w) ws
  GROUP BY w""",
    REC,
    LABEL_CELLS,
)
def head_loss(logit: str, target: str, pos_weight: int) -> str:
    return f"avg((1 - {target}) * {logit} + (1 + {pos_weight - 1} * {target}) * (ln(1 + exp(-abs({logit}))) + greatest(-{logit}, 0)))"


sql(
    "two_head_loss",
    f"""SELECT round(o, 6) AS onset_loss, round(r, 6) AS resolution_loss, round(o + r, 6) AS loss FROM (
  SELECT {head_loss('onset_logit', '(a_t = 1)::INT', 46)} AS o, {head_loss('resolution_logit', '(a_t = -1)::INT', 20)} AS r
  FROM cells JOIN heads USING (idx_t, class_idx))""",
    *TEST,
    EMB_PAIRS,
    *HEADS,
)
MSE = """avg((h_t[d + 1]::DOUBLE - h_t1[d + 1]::DOUBLE) ** 2) AS mse
  FROM ends, (SELECT range AS d FROM range(64)) dims"""
sql(
    "embedding_mse",
    f"SELECT {_r('mse', 'mse')} FROM (SELECT {MSE})",
    REC,
    SIG,
    PAIRS,
    EMB_PAIRS,
)

GRID = """grid AS (
  SELECT t, exp(-t * t / 2) AS phi,
    exp(-t * t / 2) * (CASE WHEN i IN (0, 16) THEN 1 ELSE 2 END) * 3.0::DOUBLE / 16 AS w
  FROM (SELECT range AS i, range * 3.0::DOUBLE / 16 AS t FROM range(17)))"""


def distance(source: str) -> str:
    """(slice, statistic) over source(slice, x)."""
    return f"""SELECT slice, any_value(n) * sum(w * ((c - phi) ** 2 + s ** 2)) AS statistic FROM (
  SELECT slice, t, count(*) AS n, avg(cos(x * t)) AS c, avg(sin(x * t)) AS s, any_value(phi) AS phi, any_value(w) AS w
  FROM {source}, grid GROUP BY slice, t) GROUP BY slice"""


def uniform(sign: str) -> str:
    key = f"slice || ':' || d || ':{sign}'"
    return f"(({_draw(key, 0)})::DOUBLE + 0.5) / {2**60}::DOUBLE"


WAYS = f"""normals AS (
  SELECT slice, d, sqrt(-2 * ln({uniform('u')})) * cos(2 * pi() * ({uniform('v')})) AS z
  FROM (SELECT range AS slice FROM range(6)) ss, (SELECT range AS d FROM range(64)) ds),
ways AS (SELECT slice, d, z / sqrt(sum(z * z) OVER (PARTITION BY slice)) AS a FROM normals)"""


def projected(name: str, source: str, col: str, scale: str = "1") -> str:
    return f"""{name} AS (
  SELECT slice, id, sum({col}[d + 1]::DOUBLE * {scale} * a) AS x
  FROM (SELECT *, row_number() OVER () AS id FROM {source}) src, ways GROUP BY slice, id)"""


sql(
    "epps_pulley",
    f"SELECT slice, {_r('statistic', 'statistic')} FROM ({distance('dims')})",
    GRID,
    "dims AS (SELECT 'd' || i AS slice, embedding[i + 1]::DOUBLE * 8 AS x FROM embeddings, (SELECT range AS i FROM range(64)) r)",
)
sql(
    "slice_statistics",
    f"SELECT slice, {_r('statistic', 'statistic')} FROM ({distance('proj')})",
    GRID,
    WAYS,
    projected("proj", "embeddings", "embedding", "8"),
)
sql(
    "sliced_epps_pulley",
    f"SELECT {_r('avg(statistic)', 'statistic')} FROM ({distance('proj')})",
    GRID,
    WAYS,
    projected("proj", "embeddings", "embedding", "8"),
)


def mixed(counter: str, seed: int) -> str:
    """The uniform draw of a counter, from its 32 random bits."""
    mask = normality.MASK
    x = f"((({counter}) + {seed * normality.SEED_STEP % (mask + 1)}) & {mask})"
    for i, (shift, factor) in enumerate(normality.MIXING):
        x = f"list_transform({x if i else f'[{x}]'}, lambda x{i}: CAST((CAST(xor(x{i}, x{i} >> {shift}) AS HUGEINT) * {factor}) % {mask + 1} AS BIGINT))"
    return f"((list_transform({x}, lambda y: xor(y, y >> {normality.LAST_SHIFT}))[1])::DOUBLE + 0.5) / 4294967296::DOUBLE"


sql(
    "seeded_slice_statistics",
    f"SELECT slice, {_r('statistic', 'statistic')} FROM ({distance('proj')})",
    GRID,
    f"""normals AS (
  SELECT slice, d, sqrt(-2 * ln({mixed('(slice * 64 + d) * 2', 7)})) * cos(2 * pi() * ({mixed('(slice * 64 + d) * 2 + 1', 7)})) AS z
  FROM (SELECT range AS slice FROM range({SLICES})) ss, (SELECT range AS d FROM range(64)) ds),
ways AS (SELECT slice, list(a ORDER BY d) AS way FROM (
  SELECT slice, d, z / sqrt(sum(z * z) OVER (PARTITION BY slice)) AS a FROM normals) GROUP BY slice),
proj AS (SELECT slice, list_inner_product(CAST(list_transform(embedding, lambda x: x::DOUBLE * 8) AS DOUBLE[]), way) AS x FROM embeddings, ways)""",
)
sql(
    "objective",
    f"""SELECT round(p, 6) AS pred_loss, round(r, 6) AS reg_loss, round(0.995::DOUBLE * p + 0.005::DOUBLE * r, 6) AS loss,
  round(r / (p + 0.00000001::DOUBLE), 6) AS loss_ratio FROM (
  SELECT (SELECT {MSE}) AS p,
    (SELECT avg(statistic) FROM ({distance('proj_t')})) + (SELECT avg(statistic) FROM ({distance('proj_t1')})) AS r)""",
    REC,
    SIG,
    PAIRS,
    EMB_PAIRS,
    GRID,
    WAYS,
    projected("proj_t", "ends", "h_t"),
    projected("proj_t1", "ends", "h_t1"),
)
sql(
    "class_balance",
    f"""SELECT class_idx, sum(target)::BIGINT AS positives, sum(1 - target)::BIGINT AS negatives,
  {_r('CASE WHEN sum(target) > 0 THEN sum(1 - target)::DOUBLE / sum(target) END', 'pos_weight')},
  sum(target) > 0 AND sum(1 - target) > 0 AS usable FROM label_cells GROUP BY class_idx""",
    REC,
    LABEL_CELLS,
)

# Audits.

sql(
    "check_counts",
    """SELECT 'recordings' AS "table", count(*) AS rows, (SELECT count(*) FROM events) AS expected, true AS ok FROM rec
  UNION ALL SELECT 'pairs', count(*), NULL::BIGINT, count(*) > 0 FROM pairs""",
    REC,
    PAIRS,
)
sql(
    "check_schema",
    """SELECT 'missing column' AS finding, 'study_id' AS "column", NULL::BIGINT AS length, NULL::BIGINT AS rows
  UNION ALL SELECT 'array length', 'icd', len(icd)::BIGINT, count(*) FROM rec WHERE len(icd) <> 9 GROUP BY len(icd)
  UNION ALL SELECT 'array length', 'waveform', len(waveform)::BIGINT, count(*) FROM sig
    WHERE len(waveform) <> 64 GROUP BY len(waveform)""",
    REC,
    SIG,
)
COMPARED = """SELECT row_idx, CASE WHEN fold = 10 THEN 'only_a' ELSE 'icd' END AS difference
  FROM rec WHERE fold = 10 OR (fold = 11 AND list_reverse(icd) <> icd)"""
sql("compare_by_ranges", COMPARED, REC)
sql(
    "compare_tables",
    """SELECT row_idx, CASE WHEN fold = 10 THEN 'only_a' ELSE 'icd' END AS difference
  FROM rec WHERE fold = 10 OR (fold = 11 AND list_reverse(icd) <> icd)""",
    REC,
)
sql(
    "check_reencode",
    f"""SELECT row_idx, {_text('icd_raw')} AS icd_raw, {_text('list_reverse(icd)')} AS icd
  FROM rec WHERE fold = 11 AND list_reverse(icd) <> icd""",
    REC,
)
sql(
    "stray_codes",
    f"""SELECT 'stray code' AS finding, code, count(*) AS rows FROM (SELECT unnest(icd_raw) AS code FROM rec)
  WHERE NOT list_contains({_list(VOCABULARY)}, code) GROUP BY code""",
    REC,
)
sql(
    "check_pair_rules",
    """SELECT idx_t, idx_t1, CASE WHEN pair_type = 'cross_stay' THEN 'within_stay' ELSE 'cross_stay' END AS pair_type,
  CASE WHEN pair_type = 'cross_stay' THEN 'number does not rise' ELSE 'number rises' END AS broken_rule
  FROM pairs WHERE fold = 5""",
    REC,
    PAIRS,
)
sql(
    "check_stay_agreement",
    """SELECT idx_t, idx_t1, p.subject_id, pair_type, a.stay::BIGINT AS stay_t, b.stay::BIGINT AS stay_t1,
  a.stay = b.stay AS same_stay, (pair_type = 'within_stay') <> (a.stay = b.stay) AS mismatch
  FROM pairs p JOIN stays a ON a.row_idx = idx_t JOIN stays b ON b.row_idx = idx_t1""",
    REC,
    PAIRS,
    STAYS,
)
sql(
    "skipped_stays",
    """SELECT a.row_idx AS idx_t, b.row_idx AS idx_t1, a.subject_id, 'cross_stay' AS pair_type,
  a.stay::BIGINT AS stay_t, b.stay::BIGINT AS stay_t1
  FROM stays a JOIN stays b ON a.subject_id = b.subject_id AND b.place = a.place + 2
  WHERE abs(b.stay - a.stay) > 1""",
    REC,
    STAYS,
)
sql(
    "check_split_sizes",
    """SELECT CASE WHEN fold <= 17 THEN 'train' WHEN fold = 18 THEN 'val' ELSE 'test' END AS split,
  count(*) AS monitoring, count(*) FILTER (seq = 0) AS triage FROM rec GROUP BY 1""",
    REC,
)
sql(
    "check_values",
    """SELECT 'a_t' AS "column", count(*) FILTER (a_t NOT IN (-1, 0, 1)) AS bad_values FROM pred
  UNION ALL SELECT 'onset', count(*) FILTER (onset IS NULL OR isnan(onset)) FROM pred
  UNION ALL SELECT 'resolution', count(*) FILTER (resolution IS NULL OR isnan(resolution)) FROM pred""",
    *TEST,
    PREDICTIONS.replace("test_cells", "cells"),
)
PROFILE = [
    ("row_idx", "bigint"),
    ("study_id", "int"),
    ("subject_id", "int"),
    ("ecg_time", "double"),
    ("seq", "smallint"),
    ("fold", "tinyint"),
    ("icd_raw", "array<string>"),
    ("icd", "array<tinyint>"),
    ("waveform", "array<float>"),
]
sql(
    "profile_columns",
    "\n  UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS position, '{c.replace('seq', 'ecg_no_within_stay')}' AS "column", '{t}' AS "type",
  count({c}) AS non_null, {f'min(len({c}))' if 'array' in t else 'NULL'}::BIGINT AS min_length,
  {f'max(len({c}))' if 'array' in t else 'NULL'}::BIGINT AS max_length FROM sig"""
        for i, (c, t) in enumerate(PROFILE)
    ),
    REC,
    SIG,
)
