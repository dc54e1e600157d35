"""Audits. Each runs over whole tables and returns its findings as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.labels import encode_labels
from ..schema import CROSS_STAY, WITHIN_STAY
from .lineage import store
from .ordered import HOT_ROWS
from .pairs import assign_stays, fetch_pairs
from .select import TEST_FOLD, TRAIN_LAST_FOLD, VAL_FOLD, first_by_draw

DIGEST = T.StructType([T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType())])


def check_counts(
    recordings: DataFrame,
    pairs: DataFrame,
    metadata: DataFrame | None = None,
    expected: Mapping[str, int] | None = None,
) -> DataFrame:
    """Row counts of the tables, what they should be, and whether they are."""
    expected = dict(expected or {})
    count = F.count(F.lit(1)).alias("rows")
    spark = recordings.sparkSession
    wanted_recordings = F.lit(expected.get("recordings")).cast("long")
    if metadata is not None:
        wanted_recordings = F.coalesce(wanted_recordings, metadata.agg(count).scalar())
    table = spark.range(1).select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("recordings").alias("table"),
                    recordings.agg(count).scalar().alias("rows"),
                    wanted_recordings.alias("expected"),
                ),
                F.struct(
                    F.lit("pairs").alias("table"),
                    pairs.agg(count).scalar().alias("rows"),
                    F.lit(expected.get("pairs")).cast("long").alias("expected"),
                ),
            )
        ).alias("t")
    ).select("t.*")
    right = F.coalesce(F.col("rows") == F.col("expected"), F.lit(True)) & (F.col("rows") > 0)
    return table.withColumn("ok", right)


def check_schema(
    df: DataFrame, expected: Sequence[str], lengths: Mapping[str, int] | None = None
) -> DataFrame:
    """Findings (finding, column, length, rows): missing columns and arrays of a wrong length."""
    spark = df.sparkSession
    kind = "finding string, column string, length int, rows long"
    missing = [("missing column", c, None, None) for c in expected if c not in df.columns]
    out = spark.createDataFrame(missing, kind)
    present = {c: n for c, n in (lengths or {}).items() if c in df.columns}
    if present:
        sizes = df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column"),
                            F.size(c).alias("length"),
                            F.lit(n).alias("wanted"),
                        )
                        for c, n in present.items()
                    ]
                )
            ).alias("s")
        ).select("s.*")
        wrong = (
            sizes.where(~F.col("length").eqNullSafe(F.col("wanted")))
            .groupBy("column", "length")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit("array length").alias("finding"), "column", "length", "rows")
        )
        out = out.unionByName(wrong)
    return out


def compare_tables(
    a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], n: int | None = None, seed: int = 0
) -> DataFrame:
    """Keys whose cells differ: ``only_a``, ``only_b`` or the first differing column.

    Rows are compared by digests; cells move for keys whose digests differ only. With ``n`` the
    comparison covers n keys of ``a`` drawn by hash; other rows do not move.
    """
    a, b = _drawn(a, b, key, n, seed)
    digests = [_digested(t, key, cols, side) for t, side in ((a, "a"), (b, "b"))]
    found = digests[0].join(digests[1], key, "full_outer")
    differs = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") != F.col("_b"))
    found = store(found.where(differs).select(key, F.col("_a").isNull().alias("_no_a"), F.col("_b").isNull().alias("_no_b")), "differing")
    left = a.join(found.select(key), key, "left_semi").select(key, F.struct(*cols).alias("_a"))
    right = b.join(found.select(key), key, "left_semi").select(key, F.struct(*cols).alias("_b"))
    return (
        found.join(left, key, "left")
        .join(right, key, "left")
        .select(key, _first_difference(F.col("_no_a"), F.col("_no_b"), cols).alias("difference"))
        .where(F.col("difference").isNotNull())
    )


def compare_narrow_tables(
    a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], n: int | None = None, seed: int = 0
) -> DataFrame:
    """As `compare_tables`, for cells that are narrow or digests already: rows meet once, with their cells, and no
    table is read a second time for those that differ."""
    a, b = _drawn(a, b, key, n, seed)
    left, right = (t.select(key, F.struct(*cols).alias(side)) for t, side in ((a, "_a"), (b, "_b")))
    difference = _first_difference(F.col("_a").isNull(), F.col("_b").isNull(), cols)
    met = left.join(right, key, "full_outer").select(key, difference.alias("difference"))
    return met.where(F.col("difference").isNotNull())


def _drawn(a: DataFrame, b: DataFrame, key: str, n: int | None, seed: int) -> list[DataFrame]:
    if n is None:
        return [a, b]
    keys = a.select(key)
    return [first_by_draw(t, keys, key, lambda rows: min(n, rows), seed) for t in (a, b)]


def _first_difference(no_a: Column, no_b: Column, cols: Sequence[str]) -> Column:
    difference = F.when(no_b, "only_a").when(no_a, "only_b")
    for c in cols:
        difference = difference.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c)
    return difference


def compare_by_ranges(
    a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], ranges: int = 1_024, rows: int = 100_000
) -> DataFrame:
    """As `compare_tables`, for a whole-number key: order-free sums of digests by ranges of the key, and
    only ranges whose sums differ are looked into.

    First the span of all keys is cut into ``ranges``; a task sends one row for each range, so equal tables move
    no row of their own. Ranges that differ are cut again, until they hold no more than ``rows`` rows, are one
    key wide, or are more than ``ranges``; their rows are compared one by one.
    """
    span = a.select(key).unionAll(b.select(key)).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    nulls = [t.where(F.col(key).isNull()) for t in (a, b)]
    if span["lo"] is None:
        return compare_tables(*nulls, key, cols)
    lo, width = span["lo"], span["hi"] - span["lo"] + 1
    inside = [t.where(F.col(key).isNotNull()) for t in (a, b)]
    while True:
        width = -(-width // ranges)
        place = F.floor((F.col(key) - lo) / F.lit(width)).cast("long") if width > 1 else F.col(key).cast("long") - lo
        sums = [
            _digested(t, key, cols, "d")
            .groupBy(place.alias("place"))
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.struct(
                    F.count(F.lit(1)),
                    F.bit_xor(F.xxhash64(key, "_d")),
                    F.sum(F.shiftright(F.xxhash64("_d", key), 24)),
                ).alias(side),
            )
            .withColumnRenamed("rows", f"rows_{side}")
            for t, side in zip(inside, "ab")
        ]
        met = sums[0].join(sums[1], "place", "full_outer")
        apart = met.where(~F.col("a").eqNullSafe(F.col("b"))).select("place", F.greatest("rows_a", "rows_b").alias("rows"))
        differing = apart.limit(ranges + 1).collect()
        if len(differing) > ranges:
            break
        held = place.isin([r["place"] for r in differing])
        inside = [t.where(held) for t in inside]
        if width == 1 or sum(r["rows"] for r in differing) <= rows:
            break
    return compare_tables(*(t.unionAll(n) for t, n in zip(inside, nulls)), key, cols)


def _digested(df: DataFrame, key: str, cols: Sequence[str], side: str) -> DataFrame:
    """(key, digest of the cells), so that equal rows move as 16 bytes."""
    return df.select(key, digest(*[F.col(c) for c in cols]).alias(f"_{side}"))


def digest(*cells: Column) -> Column:
    """Two 64-bit hashes of the cells."""
    told = [x for c in cells for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*told).alias("h0"), F.xxhash64(F.lit(1), *reversed(told)).alias("h1"))


def check_reencode(df: DataFrame, vocab: Sequence[str], vec: str = "icd", key: str = "row_idx") -> DataFrame:
    """Rows whose stored vector is not the encoding of their codes."""
    again = encode_labels("icd_raw", vocab)
    return df.where(~again.eqNullSafe(F.col(vec))).select(key, "icd_raw", vec)


def stray_codes(df: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """(finding, code, rows): codes outside the vocabulary, and null code lists."""
    codes = df.select(
        F.col("icd_raw").isNull().alias("_none"),
        F.size("icd_raw").alias("_size"),
        F.explode_outer("icd_raw").alias("code"),
    )
    known = F.coalesce(F.col("code").isin(list(vocab)), F.lit(False))
    return (
        codes.where(F.col("_none") | ((F.col("_size") > 0) & ~known))
        .groupBy("_none", "code")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.when(F.col("_none"), "null list").otherwise("stray code").alias("finding"), "code", "rows"
        )
    )


def check_pair_rules(pairs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Pairs that break a rule, with the rule: within-stay numbers rise; cross-stay numbers do
    not and the subject stays the same; both recordings exist."""
    marked = recordings.withColumn("found", F.lit(True))
    ends = fetch_pairs(
        pairs.select("idx_t", "idx_t1", "pair_type"),
        marked.withColumnsRenamed({"subject_id": "subject", "ecg_no_within_stay": "seq"}),
        ["subject", "seq", "found"],
        how="left",
    )
    within, cross = F.col("pair_type") == WITHIN_STAY, F.col("pair_type") == CROSS_STAY
    rises = F.coalesce(F.col("seq_t") < F.col("seq_t1"), F.lit(False))
    broken = (
        F.when(F.col("found_t").isNull() | F.col("found_t1").isNull(), "missing recording")
        .when(within & ~rises, "number does not rise")
        .when(cross & rises, "number rises")
        .when(cross & ~F.col("subject_t").eqNullSafe(F.col("subject_t1")), "subject changes")
    )
    return (
        ends.withColumn("broken_rule", broken)
        .where(F.col("broken_rule").isNotNull())
        .select("idx_t", "idx_t1", "pair_type", "broken_rule")
    )


def check_stay_agreement(pairs: DataFrame, recordings: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Pairs with the stays of both ends; ``mismatch`` where the pair type says otherwise."""
    stays = assign_stays(
        recordings.select("row_idx", "subject_id", "ecg_time", "ecg_no_within_stay"), limit
    )
    ends = fetch_pairs(pairs, stays, ["stay"])
    same = F.col("stay_t") == F.col("stay_t1")
    mismatch = (
        F.when(F.col("pair_type") == WITHIN_STAY, ~same)
        .when(F.col("pair_type") == CROSS_STAY, same)
        .otherwise(F.lit(False))
    )
    return ends.select(
        "idx_t",
        "idx_t1",
        "subject_id",
        "pair_type",
        "stay_t",
        "stay_t1",
        same.alias("same_stay"),
        mismatch.alias("mismatch"),
    )


def skipped_stays(pairs: DataFrame, recordings: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Cross-stay pairs whose stays are not neighbours."""
    ends = check_stay_agreement(pairs.where(F.col("pair_type") == CROSS_STAY), recordings, limit)
    return ends.where(F.abs(F.col("stay_t1") - F.col("stay_t")) > 1).drop("same_stay", "mismatch")


def check_split_sizes(recordings: DataFrame) -> DataFrame:
    """Rows per split in monitoring mode (all) and triage mode (numbered 0 in their stay)."""
    fold = F.col("fold")
    name = (
        F.when(fold <= TRAIN_LAST_FOLD, "train").when(fold == VAL_FOLD, "val").when(fold == TEST_FOLD, "test")
    )
    return (
        recordings.groupBy(name.alias("split"))
        .agg(
            F.count(F.lit(1)).alias("monitoring"),
            F.count_if(F.col("ecg_no_within_stay") == 0).alias("triage"),
        )
        .where(F.col("split").isNotNull())
    )


def check_values(df: DataFrame, transition: str | None = "a_t", scores: Sequence[str] = ()) -> DataFrame:
    """(column, bad_values): transition values outside -1, 0, 1, and NaN or null scores."""
    bad = {}
    if transition:
        bad[transition] = F.size(
            F.filter(transition, lambda a: ~F.coalesce(a.isin(-1, 0, 1), F.lit(False)))
        )
    for c in scores:
        bad[c] = F.size(F.filter(c, lambda s: s.isNull() | F.isnan(s)))
    sums = df.agg(*[F.coalesce(F.sum(F.coalesce(e, F.lit(1))), F.lit(0)).alias(c) for c, e in bad.items()])
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad_values")) for c in bad])).alias("b")
    ).select("b.*")


def profile_columns(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null, min_length, max_length) per column, from one pass."""
    aggs = []
    for i, f in enumerate(df.schema):
        aggs.append(F.count(f.name).alias(f"n{i}"))
        length = F.size(f.name) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast("int")
        length = F.when(F.col(f.name).isNotNull(), length)
        aggs += [F.min(length).alias(f"lo{i}"), F.max(length).alias(f"hi{i}")]
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"n{i}").alias("non_null"),
            F.col(f"lo{i}").alias("min_length"),
            F.col(f"hi{i}").alias("max_length"),
        )
        for i, f in enumerate(df.schema)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")
