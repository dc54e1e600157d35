"""URL filter: rules on hosts and path prefixes, looked up by hash prefixes of URL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import lower_ascii

# Host, path, verdict.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Hex digits of a digest that the equi-join compares; full digests are confirmed after it.
PREFIX_DIGITS = 8


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(url: str) -> tuple:
    """Columns host and path of a URL column: both empty for null or without `://`."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substr(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")


def _digest(host, path):
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of `pages`.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
    rule's. The longest rule wins (host and path together; of equals the one with the longer host,
    then `block`, then the greater text). Without a rule the verdict is `default` and rule is null.

    Each distinct URL is expanded into its host suffixes times its path prefixes that end in `/`,
    as deep as the deepest rule goes. Expressions meet rules by the first digits of their digests;
    full digests and the rest of a rule's path are confirmed afterwards.

    Null, empty or malformed URLs have empty host and path. Repeated rows and ids are judged each;
    a null id stays null. Rules with a null field are ignored; an empty table gives an empty result.
    """
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .na.drop()
        .distinct()
        .withColumn("r_anchor", F.regexp_extract("r_path", r"^(?s)(.*/)?", 0))
    )
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_anchor"))).withColumn(
        "r_key", F.substring("r_digest", 1, PREFIX_DIGITS)
    )
    deepest = rules.agg(
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.length("r_anchor") - F.length(F.replace(F.col("r_anchor"), F.lit("/"), F.lit("")))).alias("slashes"),
    ).first()
    labels, slashes = deepest["labels"] or 1, deepest["slashes"] or 0

    parts = pages.select(F.col(id_col).alias("id"), *split_url(url_col))
    urls = (
        parts.select("host", "path")
        .distinct()
        .withColumn("labels", F.split("host", r"\."))
        .withColumn("n", F.size("labels"))
        .withColumn("slashes", F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))))
    )
    expressions = urls.select(
        "host",
        "path",
        F.explode(F.expr(f"transform(sequence(greatest(1, n - {labels - 1}), n), i -> array_join(slice(labels, i, n), '.'))")).alias("suffix"),
        "slashes",
    ).select(
        "host",
        "path",
        "suffix",
        F.explode(
            F.expr(f"transform(sequence(0, least({slashes}, slashes)), k -> if(k = 0, '', substring_index(path, '/', k) || '/'))")
        ).alias("prefix"),
    )
    expressions = expressions.withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn(
        "key", F.substring("digest", 1, PREFIX_DIGITS)
    )
    fits = expressions.join(rules, F.col("key") == F.col("r_key")).where(
        (F.col("digest") == F.col("r_digest")) & F.expr("startswith(path, r_path)")
    )
    rule = F.concat("r_host", "r_path")
    rank = F.struct(F.length(rule), F.length("r_host"), F.col("r_verdict") == "block", rule)
    decided = fits.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "r_verdict"), rank).alias("best"))
    return parts.join(decided, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
    )
