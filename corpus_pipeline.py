"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.llm.common import WORD, store, table
from stayline.llm.copies import keep_one_of_equal_texts
from stayline.llm.decontaminate import remove_contamination
from stayline.llm.jaccard_join import keep_one_of_each
from stayline.llm.language_id import keep_identified
from stayline.llm.line_chunks import dedup_line_chunks
from stayline.llm.mixing import take_mix


#: A document that keeps less than this share of its words after line dedup is a near copy of what holds them, and goes.
LEAST_LEFT = 0.2


def _counted(docs: DataFrame) -> DataFrame:
    """Brings n_chars up to date with changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _free(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters or without a language that the network is fairly sure of.

    Null and empty texts have no letters and go. Each row stands alone, so repeated rows share their
    fate. An empty table gives no rows.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes rows of equal text down to one, then repeated passages of lines out of the texts.

    A document that loses words and keeps less than `LEAST_LEFT` of them goes. Null texts and texts
    without words stay as they are, repeated ones too. Of rows equal in id and text one stays, the same
    in every run. An empty table gives no rows.
    """
    before, lines, gone = _free(docs, "n_words_before"), _free(docs, "n_lines"), _free(docs, "n_removed_lines")
    words = F.regexp_count("text", F.lit(WORD))
    # line dedup reads its input three times, so what it reads is stored: texts move to their digests once
    one = store(keep_one_of_equal_texts(docs), "pipeline-one-of-equal-texts")
    kept = dedup_line_chunks(one.withColumn(before, words), n_lines=lines, n_removed_lines=gone)
    copied = (F.col(gone) > 0) & (words < LEAST_LEFT * F.col(before))
    return _counted(kept.where(~F.coalesce(copied, F.lit(False))).select(*docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: those that share 80 % of their five-word shingles.

    The least id stays, nulls last. Texts without words, null ones too, all stay. Of rows equal in id
    and text one stays, the same in every run. An empty table gives no rows.
    """
    return keep_one_of_each(docs, ngram=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts.

    All rows stay, repeated ones too. Null texts and texts without words hold no passage and stay as
    they are. Items without an id count, items without words do not. An empty table gives no rows.
    """
    return _counted(remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources: documents that words are taken of, with how many, in a column `taken`.

    Texts without words, null ones too, have nothing to take and go. A null source is a source. Rows equal in
    id and text become one, the same in every run. An empty table gives no rows.
    """
    return take_mix(docs, taken_col=_free(docs, "taken"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stage is a trained network, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
