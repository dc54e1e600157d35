"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lineage import store

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "least_row", "lower_ascii", "row_digest", "store", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words are maximal runs of anything but a blank and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_digest(row: str) -> Column:
    """A digest of all columns of a struct: the same in every run, so that a choice among rows by it is too."""
    return F.md5(F.to_json(row))


def least_row(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: of several, the one whose `_row` has the least digest."""
    return rows.groupBy(*keys).agg(F.min_by("_row", row_digest("_row")).alias("_row"))
