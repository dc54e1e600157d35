"""Quality rules whose cutoffs are chosen so that few good documents are lost, with a guarantee."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, WORD, store


@dataclass(frozen=True)
class Rule:
    """Reject documents whose `over` / `under` lies above a cutoff; `cutoffs` go from lenient to strict."""

    name: str
    over: str
    under: str
    cutoffs: tuple[float, ...]

    def value(self) -> Column:
        return F.try_divide(F.col(self.over), F.col(self.under))


RULES = (
    Rule("long_words", "word_chars", "n_words", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0)),
    Rule("short_words", "n_words", "word_chars", (0.95, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4)),
    Rule("symbols", "n_symbols", "n_words", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, plus the counts of each whole text (null: no words). One pass, no shuffle.

    Three-word windows are compared as text. Only texts in which a window occurs twice sort their
    windows, by hash and then position, so that equal windows become neighbours.
    """
    keep = [c for c in docs.columns if c != text_col]
    words = F.array_remove(F.split("_text", SPACE), "").alias("_words")
    rows = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("_text")).select(*keep, "_text", words)

    n = F.size("_words")
    triples = F.arrays_zip(
        F.col("_words"), F.slice("_words", 2, F.greatest(n, F.lit(1))), F.slice("_words", 3, F.greatest(n, F.lit(1)))
    ).cast("array<struct<a:string,b:string,c:string>>")
    windows = F.transform(
        F.slice(triples, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda t: F.concat_ws(" ", t["a"], t["b"], t["c"])
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    by_hash = F.sort_array(F.transform("_windows", lambda s, i: F.struct(F.xxhash64(s).alias("h"), i.alias("i"), s.alias("s"))))
    rows = rows.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, by_hash).alias("_sorted"),
    )
    entry = "struct<h:bigint,i:int,s:string>"
    neighbours = F.arrays_zip("_sorted", F.slice("_sorted", 2, F.size("_sorted"))).cast(f"array<struct<x:{entry},y:{entry}>>")
    equal = F.filter(neighbours, lambda t: t["x"]["s"] == t["y"]["s"])
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda t: F.array(t["x"]["i"], t["y"]["i"])))))
    rows = rows.withColumn("_starts", starts)
    covered = F.aggregate(
        F.zip_with("_starts", F.slice("_starts", 2, F.size("_starts")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series of log gamma after a shift by eight, for x > 0; error below 1e-10."""
    shift = sum((F.log(x + i) for i in range(8)), F.lit(0.0))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), where k < n p; 1 for other k.

    Terms are added from k downwards. They fall at least as fast as a normal tail, so
    40 + 12 sqrt(n p) of them hold all but a part below 1e-25 of the sum.
    """
    n, k = n.cast("double"), k.cast("double")
    last = (
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    steps = F.least(k, 40 + F.floor(12 * F.sqrt(n * p))).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"), k.alias("j"), n.alias("n"))
    odds = (1 - p) / p
    summed = F.aggregate(
        F.sequence(F.lit(0), steps),
        start,
        lambda a, _: F.struct(
            (a["term"] * a["j"] / (a["n"] - a["j"] + 1) * odds).alias("term"),
            (a["total"] + a["term"]).alias("total"),
            (a["j"] - 1).alias("j"),
            a["n"].alias("n"),
        ),
        lambda a: a["total"],
    )
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(last + F.log(summed)))).otherwise(1.0)


def select_cutoffs(
    holdout: DataFrame,
    stratum_col: str = "stratum",
    rules: tuple[Rule, ...] = RULES,
    max_false_rejection: float = 0.02,
    error: float = 0.05,
) -> DataFrame:
    """Rows (stratum, rule, cutoff): the strictest cutoffs whose false rejection is proven small.

    `holdout` holds the counts of documents labelled good. For each stratum and rule the cutoffs are
    tested in their fixed order, lenient ones first: of n good documents k are rejected, and
    P(Binomial(n, max_false_rejection / rules) <= k) must stay below error / (rules x strata)
    (Bonferroni). The first cutoff that fails ends the sequence. So with probability 1 - error no
    stratum loses more than `max_false_rejection` of its good documents over all rules together.
    A rule that has proven no cutoff in a stratum has no row there and rejects nothing.
    """
    sums = [
        F.sum(F.when(r.value() > c, 1).otherwise(0)).alias(f"{r.name}_{i}") for r in rules for i, c in enumerate(r.cutoffs)
    ]
    counts = store(holdout.groupBy(F.col(stratum_col).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *sums), "quality-holdout")
    entries = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{r.name}_{i}").alias("k"))
        for r in rules
        for i, c in enumerate(r.cutoffs)
    ]
    tests = counts.select("stratum", "n", F.inline(F.array(*entries)))
    p_value = binomial_tail(F.col("k"), F.col("n"), max_false_rejection / len(rules))
    proven = (p_value <= error / (len(rules) * max(1, counts.count()))).cast("int")
    in_order = Window.partitionBy("stratum", "rule").orderBy("step")
    return (
        tests.withColumn("proven", F.min(proven).over(in_order))
        .where("proven = 1")
        .groupBy("stratum", "rule")
        .agg(F.min("cutoff").alias("cutoff"))
    )


def filter_quality(
    docs: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    max_false_rejection: float = 0.02,
    error: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
) -> DataFrame:
    """Counts and verdict of each document: (id, counts, base_failed, kept, failed_rules).

    `labels` (id, quality) marks good documents with 1; of several labels of an id the least counts,
    null labels are ignored. Good documents that pass the base rules form the holdout of their stratum
    (null: its own stratum). The rules are fixed beforehand, so every labelled document is a holdout.
    Null or empty texts have no words and fail the base. A feature with a zero divisor rejects nothing.
    Repeated rows are judged each and a holdout counts them each. An empty table gives no rows;
    without labels only the base rules decide.
    """
    chosen = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col), F.lit("\x00null")).alias("stratum"), F.col(text_col).alias("text")
    )
    counts = store(text_counts(chosen).withColumn("base_failed", base_failed()), "quality-counts")
    good = (
        labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    )
    holdout = counts.where("NOT base_failed").join(good, "id", "left_semi")
    cutoffs = select_cutoffs(holdout, "stratum", rules, max_false_rejection, error)
    by_stratum = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in rules])
    failed = F.filter(
        F.array(*[F.when(r.value() > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in rules]),
        lambda x: x.isNotNull(),
    )
    return counts.join(by_stratum, "stratum", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
        F.array_join(failed, ",").alias("failed_rules"),
    )
