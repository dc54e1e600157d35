"""Time the headline queries, the median of three runs each. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
The `wide_` rows run on signals of full width, 5000 x 12, made of the given embeddings.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.functions import lead_major_batch
from stayline.operators import bootstrap, metrics, pairs, quality, signal
from stayline.operators.lineage import store
from stayline.operators.samples import LEADS, STEPS
from stayline.plans import views
from stayline.plans.queries import QUERIES

HEADLINE = [
    "read_metadata",
    "write_recordings",
    "read_recordings",
    "assemble_recordings",
    "with_row_index",
    "encode_label_codes",
    "build_pairs",
    "assign_stays",
    "fetch_pairs",
    "transition_values",
    "describe_pairs",
    "subject_fraction",
    "sample_rows",
    "sample_per_group",
    "assign_batches",
    "lead_stats",
    "stats_summary",
    "linear_head",
    "dynamics_predictor",
    "action_predictor",
    "auroc_by_class",
    "carry_forward_macro",
    "bootstrap_auroc",
    "evaluate_transitions",
    "evaluate_inverse",
    "bce_with_logits",
    "sliced_epps_pulley",
    "compare_tables",
    "check_reencode",
    "check_pair_rules",
    "check_stay_agreement",
    "profile_columns",
]


def bootstrap_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the label baseline with the usual 1,000 replicates."""
    cells = metrics.pair_cells(views.test_pairs(spark, sf_dir)).selectExpr(
        "idx_t", "class_idx", "y_t AS score", "y_t1 AS target"
    )
    return bootstrap.bootstrap_auroc(cells, 1000, 42, "idx_t", method="cells")


def evaluate_transitions_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.evaluate_transitions(views.predictions(spark, sf_dir), 1000, 42)


WIDE_ROWS = 2_000
_wide: list[DataFrame] = []


def wide_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Some thousand recordings with full signals, and their pairs."""
    if not _wide:
        rows = views.recordings(spark, sf_dir).where(F.col("row_idx") < WIDE_ROWS)
        width = STEPS * LEADS
        repeated = F.slice(F.flatten(F.array_repeat("waveform", width // 64 + 1)), 1, width)
        _wide.append(store(rows.withColumn("waveform", repeated), "wide"))
        _wide.append(store(pairs.build_pairs(_wide[0]), "wide-pairs"))
    return _wide[0], _wide[1]


def wide_lead_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_tables(spark, sf_dir)[0].select("row_idx", lead_major_batch(STEPS, LEADS, zscore=True)("waveform").alias("leads"))


def wide_lead_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.lead_stats(wide_tables(spark, sf_dir)[0], LEADS)


def wide_fetch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index = wide_tables(spark, sf_dir)
    return pairs.fetch_pairs(index, rows, ["waveform"])


def wide_compare_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide_tables(spark, sf_dir)[0]
    return quality.compare_tables(rows, rows, "row_idx", ["waveform"])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()

    wide = (wide_lead_major, wide_lead_stats, wide_fetch_pairs, wide_compare_tables)
    runs = {"stored_tables": lambda s, d: views.pairs(s, d)}
    runs |= {name: QUERIES[name] for name in HEADLINE}
    runs |= {f.__name__: f for f in (bootstrap_1000, evaluate_transitions_1000, *wide)}
    seconds = {}
    for name, run in runs.items():
        times = []
        if run in wide:
            wide_tables(spark, sf_dir)
        for _ in range(1 if name == "stored_tables" else int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
