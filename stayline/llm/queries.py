"""The registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    bpe,
    decontaminate,
    jaccard_join,
    language_id,
    licenses,
    line_chunks,
    lm_scoring,
    merkle,
    mixing,
    pii,
    quality,
    url_rules,
    vector_codes,
)
from .common import lower_ascii, table

TOKENIZER = "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    values = [F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")]
    return scored.select("doc_id", "n_tokens", *values)


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_chunks.dedup_line_chunks(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "text")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_labels(licenses.scan_licenses(table(spark, sf_dir, "documents")))
    words = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["word"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(words).cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"),
        F.array_max(words).cast("long").alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    decoded = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    digits = F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0")))
    numbers = ",".join(str(x) for b in books for x in b.reshape(-1).tolist())
    return codes.select(
        F.col("id").alias("vec_id"),
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.sha2(F.lit(numbers), 256).alias("codebooks_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = merkle.row_digest([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns])
    same = merkle.row_digest([F.col(c) for c in columns])
    proofs = merkle.prove_rows(
        table(spark, sf_dir, "documents"), columns, carry={"tampered": F.when(hit, changed).otherwise(same)}
    )
    siblings = F.flatten(F.transform("path", lambda level: level["siblings"]))
    rows = proofs.withColumn("folded_root", merkle.fold("tampered", "path"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_mixing,
        op3_url_rules,
        op4_quality_rules,
        op5_lm_scoring,
        op6_line_chunks,
        op7_decontamination,
        op8_licenses,
        op9_jaccard_join,
        op10_personal_data,
        op11_byte_bpe,
        op12_vector_codes,
        op13_merkle_manifest,
    )
}
