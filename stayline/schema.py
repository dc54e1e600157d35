"""Column types of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

RECORDINGS = T.StructType(
    [
        T.StructField("row_idx", T.LongType()),
        T.StructField("study_id", T.IntegerType()),
        T.StructField("subject_id", T.IntegerType()),
        T.StructField("ecg_time", T.DoubleType()),
        T.StructField("ecg_no_within_stay", T.ShortType()),
        T.StructField("fold", T.ByteType()),
        T.StructField("icd_raw", T.ArrayType(T.StringType())),
        T.StructField("icd", T.ArrayType(T.ByteType())),
        T.StructField("waveform", T.ArrayType(T.FloatType())),
    ]
)

PAIRS = T.StructType(
    [
        T.StructField("idx_t", T.LongType()),
        T.StructField("idx_t1", T.LongType()),
        T.StructField("subject_id", T.IntegerType()),
        T.StructField("fold", T.ByteType()),
        T.StructField("pair_type", T.StringType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("study_id", T.IntegerType()),
        T.StructField("subject_id", T.IntegerType()),
        T.StructField("ecg_no_within_stay", T.ShortType()),
        T.StructField("fold", T.ByteType()),
        T.StructField("h5_index", T.LongType()),
    ]
)

# Fixed values.
WITHIN_STAY = "within_stay"
CROSS_STAY = "cross_stay"
LEADS = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to ``schema``, keeping only its columns in its order."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
