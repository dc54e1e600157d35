"""Rows of equal text taken down to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import WORD, row_digest


def keep_one_of_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows with equal text the one with the least id stays, nulls last; of equal ids the one with the least
    digest of all columns.

    Texts without words, null ones too, all stay. Other columns, whatever their names, are kept. Only
    digests are grouped; the texts of rows that go are not moved. An empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("_own"),
        F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("_key"),
        F.rlike(F.coalesce(text_col, F.lit("")), F.lit(WORD)).alias("_words"),
    ).withColumn("_rank", F.struct(F.col("_own").isNull(), F.col("_own").alias("id"), row_digest("_row").alias("digest")))
    worded = rows.where("_words")
    first = worded.groupBy(F.col("_key").alias("_digest")).agg(F.min("_rank").alias("_first"))
    kept = worded.join(first, (F.col("_key") == F.col("_digest")) & F.col("_rank").eqNullSafe(F.col("_first")), "left_semi")
    kept = kept.dropDuplicates(["_key"])  # what is left of a key are rows equal in all columns
    return kept.unionAll(rows.where("NOT _words")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
