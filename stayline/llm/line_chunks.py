"""Removal of repeated passages of whole lines, found as content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, store

# The rolling hash: polynomial over the hashes of the last lines, modulo a prime.
BASE, MODULUS = 31, 2_147_483_647


def elements(values: Column, first: Column, last: Column) -> Column:
    """The elements from first to last, from 1, by place: a slice would convert the whole array each time."""
    return F.transform(F.sequence(first, last), lambda i: F.get(values, i - 1))


def chunked(docs: DataFrame, window: int, every: int) -> DataFrame:
    """Adds `_chunks` (first line from 1, lines, digest, whether it has a word) to rows with `_text`.

    A boundary is each line at which the rolling hash of it and the window - 1 lines before is a
    multiple of `every`, and the first and the last line. A chunk runs from a boundary through the next
    one, both included, so it has two lines or more. Boundaries depend on those lines only: an insertion
    earlier in a text moves chunks but does not change them. With every = 1 chunks are all pairs of
    neighbours, and each repeated run of two lines or more consists of repeated chunks.
    """
    lines = F.split("_text", "\n")
    rows = docs.withColumn("_marks", F.transform(lines, lambda x: F.struct(F.md5(x).alias("digest"), F.rlike(x, F.lit(WORD)).alias("word"))))
    hashed = F.transform("_marks", lambda x: F.conv(F.substring(x["digest"], 1, 8), 16, 10).cast("long"))
    rows = rows.withColumn("_hashes", hashed).withColumn("_n", F.size("_marks"))
    rolled = F.transform("_hashes", lambda h: h % MODULUS)
    for back in range(1, window):
        before = F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), back), F.col("_hashes")), F.lit(1), F.size("_hashes"))
        rolled = F.zip_with(rolled, before, lambda a, b: (a * BASE + b) % MODULUS)
    cuts = F.filter(F.transform(rolled, lambda r, i: F.when(r % every == 0, i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("_cuts", F.array_distinct(F.concat(F.array(F.lit(1)), cuts, F.array("_n"))))

    def chunk(a, b):
        own = elements(F.col("_marks"), a, b)
        digest = F.unhex(F.md5(F.array_join(own["digest"], "")))
        return F.struct(a.alias("first"), (b - a + 1).alias("n"), digest.alias("chunk"), F.exists(own["word"], lambda w: w).alias("word"))

    rest = F.size("_cuts") - 1
    chunks = F.zip_with(F.slice("_cuts", F.lit(1), rest), F.slice("_cuts", F.lit(2), rest), chunk)
    return rows.withColumn("_chunks", chunks).drop("_marks", "_hashes", "_n", "_cuts")


def dedup_line_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2,
    every: int = 1,
    n_lines: str = "n_lines",
    n_removed_lines: str = "n_removed_lines",
) -> DataFrame:
    """`docs` with repeated multi-line chunks taken out of their text, plus `n_lines` and `n_removed_lines`.

    Of equal chunks with a word, the first by (id, text digest, line) stays; nulls come first.
    Candidates share a digest; a chunk goes only if its bytes equal those of the first. The other
    lines keep their order. The first place of each line of text always stays. With every = 1 each run
    of two lines or more that stands at an earlier place too goes whole; higher values move fewer
    rows and miss the runs, or ends of runs, that lie between boundaries.

    A null text stays null with no lines. Rows with equal id and text are one document: all of them
    get the same result. Other columns, whatever their names, are kept; the two counts replace columns of their
    names, which are parameters. An empty table gives no rows.
    """
    kept_columns = [c for c in docs.columns if c not in (n_lines, n_removed_lines)]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.md5(F.coalesce(text_col, F.lit(""))).alias("_digest"),
    )
    texts = rows.where(F.contains("_text", F.lit("\n"))).select("_id", "_digest", "_text")
    place = F.struct("_id", "_digest", "first")
    # the outer form: for the inner one the optimizer adds a filter on the chunks, which computes all of them twice,
    # and the arrays they come from anew for each chunk
    found = chunked(texts, window, every).select("_id", "_digest", F.inline_outer("_chunks")).where("word").drop("word")
    found = store(found, "line-chunks")
    repeated = (
        found.groupBy("chunk").agg(F.min(place).alias("holder"), F.max(place).alias("last")).where("holder != last").drop("last")
    )
    repeated = store(repeated, "line-repeated")  # a plain side lets the join below split a hot chunk
    candidates = (
        found.join(repeated, "chunk")
        .groupBy("_id", "_digest")
        .agg(F.collect_set(F.struct("first", "n", "chunk", (place == F.col("holder")).alias("holds"))).alias("_candidates"))
    )

    def same(a: DataFrame, b: DataFrame):
        return a["_id"].eqNullSafe(b["_id"]) & (a["_digest"] == b["_digest"])

    matched = rows.join(candidates, same(rows, candidates), "inner").select(
        rows["_id"], rows["_digest"], "_text", "_candidates"
    )
    # the lines are split once for a text, as the variable of a function, not once for a chunk
    cut = F.transform(
        F.array(F.split("_text", "\n")),
        lambda lines: F.transform(
            "_candidates",
            lambda c: F.struct(c["first"], c["n"], c["chunk"], c["holds"], F.array_join(elements(lines, c["first"], c["first"] + c["n"] - 1), "\n").alias("text")),
        ),
    )
    passages = matched.dropDuplicates(["_id", "_digest"]).select("_id", "_digest", F.inline_outer(F.get(cut, F.lit(0))))
    passages = store(passages, "line-passages")
    holders = passages.where("holds").select("chunk", F.col("text").alias("held"))
    removed = (
        passages.where("NOT holds")
        .join(holders, "chunk")
        .where("text = held")
        .groupBy("_id", "_digest")
        .agg(F.collect_set(F.struct("first", "n")).alias("_removed"))
    )
    gone = F.array_distinct(F.flatten(F.transform("_removed", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1))))
    result = (
        rows.join(removed, same(rows, removed), "left")
        .select("_row", "_text", F.coalesce(gone, F.array().cast("array<int>")).alias("_gone"))
        .withColumn("_lines", F.split("_text", "\n"))
    )
    numbers = F.array_except(F.sequence(F.lit(1), F.size("_lines")), "_gone")
    kept = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(F.transform(numbers, lambda i: F.get("_lines", i - 1)), "\n"))
    return result.select(
        *[(kept if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in kept_columns],
        F.coalesce(F.size("_lines").cast("long"), F.lit(0).cast("long")).alias(n_lines),
        F.size("_gone").cast("long").alias(n_removed_lines),
    )
