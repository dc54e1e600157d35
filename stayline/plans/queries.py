"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..functions import (
    contextual_prediction,
    decode_labels,
    displacement,
    draw,
    encode_labels,
    flatten_frames,
    lead_major,
    lead_major_batch,
    next_labels,
    reshape_frames,
    reshape_frames_batch,
    transition_targets,
    zscore_leads,
)
from ..operators import assemble, bootstrap, colocated, metrics, normality, pair_index, pairs, quality, samples, scoring, select, signal
from ..operators.lineage import store
from ..operators.ordered import row_positions
from ..sources import tables
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

BOTH = (S.WITHIN_STAY, S.CROSS_STAY)
OTHER_VOCABULARY = ["k4", "purchase", "k1"]
REPLICATES, SEED = 20, 42


def tidy(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: bigint, double rounded to 8 places, text for lists."""

    def plain(f: T.StructField):
        c, t = F.col(f.name), f.dataType
        if isinstance(t, T.ArrayType):
            whole = isinstance(t.elementType, T.FloatType)  # vectors of 0 and 1
            c = F.array_join(F.transform(c, lambda x: (x.cast("int") if whole else x).cast("string")), ",")
        elif isinstance(t, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 8) + F.lit(0.0)
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema])


def whole(signal):
    """Every sample of a signal as a whole number of 2^-30, which any engine prints alike."""
    return F.transform(signal, lambda x: F.floor(x.cast("double") * 2.0**30).cast("long"))


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
    return fn


META = ["study_id", "subject_id", "ecg_no_within_stay", "fold"]


# Sources and sinks.


def _metadata_csv(spark, sf):
    path = V.shared_dir(spark, "metadata.csv", sf)
    rows = V.recordings(spark, sf).select("row_idx", *META, F.col("row_idx").alias("h5_index"))
    rows.repartitionByRange(4, "row_idx").sortWithinPartitions("row_idx").drop("row_idx").write.mode(
        "overwrite"
    ).csv(path, header=True)
    return path


@query
def read_metadata(spark, sf):
    return tables.read_metadata(spark, _metadata_csv(spark, sf))


@query
def read_recordings(spark, sf):
    V.recordings(spark, sf)
    path = V.shared_dir(spark, "recordings", sf)
    return tables.read_recordings(
        spark, path, ["row_idx", "subject_id", "ecg_time", "fold"], "fold = 19 AND ecg_no_within_stay = 0"
    )


@query
def read_array_table(spark, sf):
    path = V.shared_dir(spark, "labels", sf)
    V.recordings(spark, sf).select(F.col("row_idx").alias("src_index"), F.col("icd").alias("labels")).write.mode(
        "overwrite"
    ).parquet(path)
    return tables.read_array_table(spark, path, ["labels"])


@query
def write_recordings(spark, sf):
    path = V.shared_dir(spark, "write_recordings", sf)
    rows = V.recordings(spark, sf)
    tables.write_recordings(rows.where("fold < 10"), path, "overwrite")
    tables.write_recordings(rows.where("fold >= 10"), path, "append")
    return tables.read_recordings(spark, path).withColumn("waveform", whole("waveform"))


@query
def append_batches(spark, sf):
    """Three chunks, one of which is written a second time after a first try with half of its rows."""
    path = V.shared_dir(spark, "append_batches", sf)
    rows = V.recordings(spark, sf)
    chunk = F.col("row_idx") % 3
    for name, part in (("0", chunk == 0), ("1", (chunk == 1) & (F.col("fold") > 9)), ("1", chunk == 1), ("2", chunk == 2), ("2", chunk == 2)):
        tables.append_batch(rows.where(part), path, name)
    return tables.read_batches(spark, path).withColumn("waveform", whole("waveform"))


@query
def write_pairs(spark, sf):
    path = V.shared_dir(spark, "write_pairs", sf)
    tables.write_pairs(pairs.build_pairs(V.recordings(spark, sf)), path)
    return spark.read.schema(S.PAIRS).parquet(path)


@query
def update_pair_index(spark, sf):
    """An index built without a third of the recordings of some subjects, then brought up to date with them."""
    path = V.shared_dir(spark, "update_pair_index", sf)
    rows = V.recordings(spark, sf)
    late = (F.col("subject_id") % 7 == 3) & (F.col("row_idx") % 3 == 0)
    pair_index.update_pair_index(spark, path, rows.where(~late), buckets=64)
    pair_index.update_pair_index(spark, path, rows, rows.where(late))
    return pair_index.read_pair_index(spark, path)


@query
def vocabulary(spark, sf):
    path = V.shared_dir(spark, "vocabulary", sf)
    used = V.recordings(spark, sf).select(F.explode("icd_raw").alias("code"))
    counts = used.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
    tables.save_vocabulary(spark, V.VOCABULARY, path)
    return tables.vocabulary_frame(spark, path).join(counts, "code")


# Assembly and projections.


@query
def assemble_recordings(spark, sf):
    rows = V.recordings(spark, sf)
    meta = rows.select("row_idx", *META, F.col("row_idx").alias("h5_index"))
    waves = rows.select(
        F.col("row_idx").alias("src_index"), "ecg_time", reshape_frames_batch(V.LEADS)("waveform").alias("frames")
    )
    labels = rows.select(F.col("row_idx").alias("src_index"), F.col("icd").alias("labels"))
    built = assemble.assemble_recordings(meta, waves, labels, V.VOCABULARY)
    return built.select(
        "row_idx",
        *META,
        "ecg_time",
        "icd_raw",
        "icd",
        whole("waveform").alias("waveform"),
    )


@query
def build_tables(spark, sf):
    """From the CSV and the array tables to the checked pair index, and that once more from the stored recordings."""
    rows = V.recordings(spark, sf)
    meta = tables.read_metadata(spark, _metadata_csv(spark, sf))
    waves = rows.select(F.col("row_idx").alias("src_index"), "ecg_time", reshape_frames_batch(V.LEADS)("waveform").alias("frames"))
    labels = rows.select(F.col("row_idx").alias("src_index"), F.col("icd").alias("labels"))
    folder = V.shared_dir(spark, "build_tables", sf)
    built = assemble.build_tables(meta, waves, labels, V.VOCABULARY, folder).withColumn("pairs_only", F.lit(False))
    first = store(built, "built")
    again = assemble.build_tables(None, None, None, V.VOCABULARY, folder, pairs_only=True)
    return first.unionByName(again.withColumn("pairs_only", F.lit(True)))


@query
def verify_build(spark, sf):
    """Of a build after which the inputs changed: signals of fold 11 were turned round, fold 10 has gone, and a
    third of the pair index was marked as within a stay."""
    rows = V.recordings(spark, sf)
    folder = V.shared_dir(spark, "verify_build", sf)
    narrow = rows.select("row_idx", *META, F.col("row_idx").alias("h5_index"))
    frames = reshape_frames_batch(V.LEADS)("waveform")
    turned = F.when(F.col("fold") == 11, F.reverse(frames)).otherwise(frames)
    waves, other = (rows.select(F.col("row_idx").alias("src_index"), "ecg_time", f.alias("frames")) for f in (frames, turned))
    labels = rows.select(F.col("row_idx").alias("src_index"), F.col("icd").alias("labels"))
    assemble.build_tables(narrow, waves, labels, V.VOCABULARY, folder)
    index = spark.read.schema(S.PAIRS).parquet(f"{folder}/pairs")
    marked = F.when(F.col("idx_t") % 3 == 0, S.WITHIN_STAY).otherwise(F.col("pair_type"))
    tables.write_pairs(store(index.withColumn("pair_type", marked), "marked"), f"{folder}/pairs")
    return assemble.verify_build(folder, narrow.where("fold <> 10"), other, labels, V.VOCABULARY)


@query
def with_row_index(spark, sf):
    rows = V.recordings(spark, sf).select("study_id", "subject_id", "ecg_time")
    return assemble.with_row_index(rows, ["subject_id", "ecg_time", "study_id"])


@query
def frames(spark, sf):
    nested = V.table(spark, sf, "embeddings").select(
        "vec_id", reshape_frames("embedding", V.LEADS).alias("frames")
    )
    flat = nested.select("vec_id", F.posexplode("frames").alias("step", "f"), flatten_frames("frames").alias("flat"))
    return flat.select("vec_id", "step", whole("f").alias("frame"), whole("flat").alias("flat"))


@query
def conform(spark, sf):
    rows = V.recordings(spark, sf).withColumn("extra", F.lit(1))
    out = S.conform(rows, S.RECORDINGS)
    return out.withColumn("waveform", whole("waveform"))


# Labels.


@query
def encode_label_codes(spark, sf):
    return V.recordings(spark, sf).select("row_idx", encode_labels("icd_raw", V.VOCABULARY).alias("icd"))


@query
def decode_label_vectors(spark, sf):
    return V.recordings(spark, sf).select("row_idx", decode_labels("icd", V.VOCABULARY).alias("codes"))


@query
def add_label_column(spark, sf):
    rows = V.recordings(spark, sf).select("row_idx", "icd_raw", "icd")
    return assemble.add_label_column(rows, "icd_other", OTHER_VOCABULARY)


@query
def explode_labels(spark, sf):
    return assemble.explode_labels(V.recordings(spark, sf), "row_idx", "icd")


# Pairs and stays.


@query
def build_pairs(spark, sf):
    return pairs.build_pairs(V.recordings(spark, sf))


@query
def pair_type_counts(spark, sf):
    return pairs.pair_type_counts(V.pairs(spark, sf))


@query
def assign_stays(spark, sf):
    return pairs.assign_stays(V.recordings(spark, sf)).select("row_idx", "subject_id", "stay")


@query
def select_subjects(spark, sf):
    return pairs.select_subjects(V.recordings(spark, sf), 5, 24, 26, 5)


@query
def subject_timeline(spark, sf):
    cols = ["row_idx", "subject_id", "ecg_time", "ecg_no_within_stay"]
    return pairs.subject_timeline(V.recordings(spark, sf).select(*cols), 7)


@query
def filter_pairs(spark, sf):
    return pairs.filter_pairs(V.pairs(spark, sf), "test", [S.CROSS_STAY])


@query
def fetch_pairs(spark, sf):
    found = pairs.fetch_pairs(V.pairs(spark, sf), V.recordings(spark, sf), ["icd", "ecg_time"])
    return found.select("idx_t", "idx_t1", "icd_t", "icd_t1", "ecg_time_t", "ecg_time_t1")


FETCHED = ["icd", "ecg_time", "waveform"]


def _whole_pairs(found):
    signals = {f"waveform_{e}": whole(f"waveform_{e}") for e in ("t", "t1")}
    return found.withColumns(signals).select("idx_t", "idx_t1", *[f"{c}_{e}" for e in ("t", "t1") for c in FETCHED])


@query
def fetch_pairs_together(spark, sf):
    return _whole_pairs(colocated.fetch_pairs_together(V.pairs(spark, sf), V.recordings(spark, sf), FETCHED))


@query
def fetch_pairs_of_cut_subjects(spark, sf):
    """Every subject is cut into chunks of some 16 rows, as a dominant one would be."""
    return _whole_pairs(colocated.fetch_pairs_together(V.pairs(spark, sf), V.recordings(spark, sf), FETCHED, limit=16))


@query
def read_linked_pairs(spark, sf):
    return _whole_pairs(colocated.read_linked_pairs(spark, V.linked_table(spark, sf), FETCHED, "train", [S.CROSS_STAY]))


@query
def transition_vectors(spark, sf):
    return pairs.pair_labels(V.pairs(spark, sf), V.recordings(spark, sf)).select("idx_t", "a_t")


@query
def transition_values(spark, sf):
    changes = pairs.pair_labels(V.pairs(spark, sf), V.recordings(spark, sf))
    return changes.select(F.explode("a_t").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("cells"))


@query
def next_label_vectors(spark, sf):
    changes = pairs.pair_labels(V.pairs(spark, sf), V.recordings(spark, sf))
    return changes.select("idx_t", next_labels("y_t", "a_t").alias("y_next"))


@query
def transition_target_vectors(spark, sf):
    onset, gone = transition_targets("a_t")
    changes = pairs.pair_labels(V.pairs(spark, sf), V.recordings(spark, sf))
    return changes.select("idx_t", onset.alias("onset"), gone.alias("resolution"))


@query
def describe_pairs(spark, sf):
    return pairs.describe_pairs(V.pairs(spark, sf), V.recordings(spark, sf), V.VOCABULARY)


# Splits, selection, sampling, batching.


@query
def split_rows(spark, sf):
    rows = V.recordings(spark, sf).select("row_idx", "subject_id", "fold")
    parts = [select.split(rows, s).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def select_mode(spark, sf):
    """Every split in both modes."""
    rows = V.recordings(spark, sf).select("row_idx", "subject_id", "ecg_time", "fold", "ecg_no_within_stay")
    parts = [
        select.select_mode(select.split(rows, s), mode).select(
            "row_idx", "subject_id", "ecg_time", F.lit(s).alias("split"), F.lit(mode).alias("mode")
        )
        for s in ("train", "val", "test")
        for mode in ("triage", "monitoring")
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def subject_fraction(spark, sf):
    rows = select.split(V.recordings(spark, sf).select("row_idx", "subject_id", "fold", "ecg_no_within_stay"), "train")
    kept = select.subject_fraction(rows, 0.3, seed=0)
    return select.select_mode(kept, "triage").select("row_idx", "subject_id")


@query
def subject_fraction_of_pairs(spark, sf):
    chosen = pairs.filter_pairs(V.pairs(spark, sf), "train", [S.CROSS_STAY])
    return select.subject_fraction(chosen, 0.3, seed=0)


@query
def take_rows(spark, sf):
    rows = V.recordings(spark, sf)
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    ids = rows.select(F.col("row_idx").alias("pos"), (draw("row_idx", 3) % n).alias("row_idx"))
    return select.take_rows(rows, ids, ["subject_id", "icd"])


@query
def sample_rows(spark, sf):
    return select.sample_rows(V.recordings(spark, sf).select("row_idx", "subject_id"), 2000, seed=42)


@query
def sample_rows_with_replacement(spark, sf):
    rows = V.recordings(spark, sf).select("row_idx", "subject_id")
    return select.sample_rows(rows, 2000, seed=1, replace=True)


@query
def take_stored_rows(spark, sf):
    """As take_rows, from files in folders of 64 positions each."""
    path = V.shared_dir(spark, "clustered", sf)
    rows = V.recordings(spark, sf)
    tables.write_clustered(rows.select("row_idx", "subject_id", "icd"), path, 64)
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    ids = rows.select(F.col("row_idx").alias("pos"), (draw("row_idx", 3) % n).alias("row_idx"))
    return tables.take_stored_rows(spark, path, ids, ["subject_id", "icd"])


@query
def sample_per_group(spark, sf):
    return select.sample_per_group(V.pairs(spark, sf), "pair_type", 10, seed=2, id_col="idx_t")


@query
def assign_batches(spark, sf):
    rows = select.split(V.recordings(spark, sf).select("row_idx", "fold"), "train")
    return select.assign_batches(rows, 256, shuffle=True, seed=7).select("row_idx", "pos", "batch")


@query
def assign_batches_in_order(spark, sf):
    rows = select.split(V.recordings(spark, sf).select("row_idx", "fold"), "test")
    return select.assign_batches(rows, 256).select("row_idx", "pos", "batch")


# Signals.


def _by_lead(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("leads").alias("lead", "v")).select(
        "vec_id", "lead", F.posexplode("v").alias("step", "value")
    )


@query
def lead_major_signals(spark, sf):
    signals = V.table(spark, sf, "embeddings")
    return _by_lead(signals.select("vec_id", lead_major("embedding", V.STEPS, V.LEADS).alias("leads")))


@query
def lead_major_signal_batches(spark, sf):
    turn = lead_major_batch(V.STEPS, V.LEADS)
    return _by_lead(V.table(spark, sf, "embeddings").select("vec_id", turn("embedding").alias("leads")))


@query
def zscore_signals(spark, sf):
    leads = lead_major(F.col("embedding").cast("array<double>"), V.STEPS, V.LEADS)
    return _by_lead(V.table(spark, sf, "embeddings").select("vec_id", zscore_leads(leads).alias("leads")))


@query
def zscore_signal_batches(spark, sf):
    turn = lead_major_batch(V.STEPS, V.LEADS, zscore=True)
    return _by_lead(V.table(spark, sf, "embeddings").select("vec_id", turn("embedding").alias("leads"))).withColumn(
        "value", F.round(F.col("value").cast("double"), 5)
    )


def _uneven(spark, sf):
    """Signals of which some are cut short, some too long and some missing."""
    e = F.col("embedding")
    kind = F.col("vec_id") % 5
    uneven = F.when(kind == 1, F.slice(e, 1, 60)).when(kind == 2, F.concat(e, F.slice(e, 1, 3))).when(kind != 3, e)
    return V.table(spark, sf, "embeddings").select("vec_id", uneven.alias("embedding"))


@query
def uneven_signals(spark, sf):
    """Both layouts of uneven signals: null where the length is wrong."""
    leads = lead_major_batch(V.STEPS, V.LEADS)("embedding")
    rows = _uneven(spark, sf).select("vec_id", leads.alias("leads"), lead_major("embedding", V.STEPS, V.LEADS).alias("short"))
    same = F.col("leads").eqNullSafe(F.col("short"))
    rows = rows.select("vec_id", same.alias("same"), F.posexplode_outer("leads").alias("lead", "v"))
    return rows.select("vec_id", "same", "lead", F.posexplode_outer("v").alias("step", "value"))


def _stats(spark, sf):
    return signal.lead_stats(V.recordings(spark, sf), V.LEADS)


@query
def lead_stats(spark, sf):
    return _stats(spark, sf)


@query
def stats_summary(spark, sf):
    return signal.stats_summary(_stats(spark, sf))


@query
def lead_breakdown(spark, sf):
    return signal.lead_breakdown(_stats(spark, sf))


@query
def normalization_verdict(spark, sf):
    return signal.normalization_verdict(_stats(spark, sf))


@query
def single_samples(spark, sf):
    out = samples.single_samples(V.recordings(spark, sf), "train", "triage", 0.3, 0, V.STEPS, V.LEADS)
    return out.select("row_idx", "label", F.posexplode("waveform").alias("lead", "v")).select(
        "row_idx", "label", "lead", F.posexplode("v").alias("step", "value")
    )


@query
def pair_samples(spark, sf):
    out = samples.pair_samples(
        V.pairs(spark, sf), V.recordings(spark, sf), "train", [S.CROSS_STAY], 0.3, 0, V.STEPS, V.LEADS
    )
    ends = F.arrays_zip("x_t", "x_t1")
    by_lead = out.select("idx_t", "idx_t1", "y_t", "a_t", F.posexplode(ends).alias("lead", "v"))
    return by_lead.select(
        "idx_t", "idx_t1", "y_t", "a_t", "lead", F.posexplode(F.arrays_zip("v.x_t", "v.x_t1")).alias("step", "x")
    ).select("idx_t", "idx_t1", "y_t", "a_t", "lead", "step", "x.x_t", "x.x_t1")


# Scoring. Weights follow a rule, so that SQL can repeat them.


def rule_weights(rows: int, cols: int, salt: int = 0) -> np.ndarray:
    i, j = np.indices((rows, cols))
    return ((i * 31 + j * 17 + salt) % 13 - 6) / 13.0


def rule_layer(rows: int, cols: int, salt: int = 0) -> dict[str, np.ndarray]:
    return {"weight": rule_weights(rows, cols, salt), "bias": (np.arange(rows) % 5 - 2) / 10.0}


@query
def score_model(spark, sf):
    def make():
        return lambda h: h.astype(np.float64).mean(axis=1)

    rows = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return scoring.score(rows, make, ["embedding"], "score", "double", 256, [[64]]).drop("embedding")


@query
def linear_head(spark, sf):
    rows = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    layer = rule_layer(V.CLASSES, 64)
    out = scoring.linear_head(rows, layer["weight"], layer["bias"])
    zipped = F.arrays_zip("logits", "probs")
    return out.select("vec_id", F.posexplode(zipped).alias("class_idx", "v")).select(
        "vec_id", "class_idx", "v.logits", "v.probs"
    )


def predictor_weights(inputs: int, hidden: int, heads: dict[str, int]) -> dict[str, dict[str, np.ndarray]]:
    layers = {
        "input": rule_layer(hidden, inputs, 1),
        "residual_in": rule_layer(hidden, hidden, 2),
        "residual_out": rule_layer(hidden, hidden, 3),
    }
    return layers | {name: rule_layer(size, hidden, 4 + 4 * i) for i, (name, size) in enumerate(heads.items())}


def projector_weights(classes: int, dim: int) -> list[dict[str, np.ndarray]]:
    return [rule_layer(dim, classes, 5), rule_layer(dim, dim, 6), rule_layer(dim, dim, 7)]


def _vector_values(df: DataFrame, *cols: str) -> DataFrame:
    """Every value of the vectors, by its place."""
    cells = df.select("idx_t", F.posexplode(F.arrays_zip(*cols)).alias("j", "v"))
    return cells.select("idx_t", "j", *[F.round(f"v.{c}", 6).alias(c) for c in cols])


@query
def action_projector(spark, sf):
    rows = V.embedding_pairs(spark, sf).select("idx_t", "a_t")
    return _vector_values(scoring.action_projector(rows, projector_weights(V.CLASSES, 16)), "action_emb")


@query
def dynamics_predictor(spark, sf):
    rows = V.embedding_pairs(spark, sf).select("idx_t", "h_t", "a_t")
    rows = scoring.action_projector(rows, projector_weights(V.CLASSES, 16))
    weights = predictor_weights(64 + 16, 32, {"output": 64})
    return _vector_values(scoring.dynamics_predictor(rows, weights), "h_t1_hat")


@query
def action_predictor(spark, sf):
    rows = V.embedding_pairs(spark, sf).select("idx_t", displacement("h_t", "h_t1").alias("d"))
    weights = predictor_weights(64, 32, {"onset": V.CLASSES, "resolution": V.CLASSES})
    return _vector_values(scoring.action_predictor(rows, weights), "onset_logits", "resolution_logits")


@query
def transition_probabilities(spark, sf):
    weights = predictor_weights(64, 32, {"onset": V.CLASSES, "resolution": V.CLASSES})
    out = scoring.transition_probabilities(V.embedding_pairs(spark, sf), weights)
    return out.select("idx_t", F.posexplode(F.arrays_zip("onset", "resolution")).alias("class_idx", "p")).select(
        "idx_t", "class_idx", "p.onset", "p.resolution"
    )


@query
def embedding_displacement(spark, sf):
    d = displacement(F.col("h_t").cast("array<double>"), F.col("h_t1").cast("array<double>"))
    return V.embedding_pairs(spark, sf).select("idx_t", F.posexplode(d).alias("dim", "value"))


@query
def contextual_predictions(spark, sf):
    rows = V.predictions(spark, sf)
    ctx = contextual_prediction("y_t", "onset", "resolution")
    return rows.select("idx_t", F.posexplode(ctx).alias("class_idx", "score"))


@query
def linear_probe(spark, sf):
    """A probe fitted on four fifths of the embeddings, scored on its own rows and on the others."""
    rows = V.table(spark, sf, "embeddings")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (c == F.col("label")).cast("int"))
    held_out = F.crc32(F.col("vec_id").cast("string").cast("binary")) % 5 == 0
    rows = rows.select("vec_id", "embedding", one_hot.alias("labels"), held_out.alias("held_out"))
    probed = scoring.linear_probe(rows.where(~F.col("held_out")), rows, 10, max_iter=100, reg=0.01)
    zipped = F.arrays_zip(F.col("probs").alias("score"), F.col("labels").alias("target"))
    cells = probed.select("held_out", F.posexplode(zipped).alias("class_idx", "v"))
    return metrics.macro_auroc(cells.select("held_out", "class_idx", "v.score", "v.target"), ["held_out"])


@query
def displacement_probe(spark, sf):
    """Probes for labels that come and go, fitted on the training folds and scored on the pairs of each split."""
    moved = displacement("h_t", "h_t1").alias("moved")
    ends = store(V.embedding_pairs(spark, sf).select("fold", "a_t", moved), "displacements")
    train = select.split(ends, "train")
    probed = scoring.displacement_probe(train, ends, V.CLASSES, max_iter=100, reg=0.01, moved="moved", stored=True)
    parts = [select.split(probed, name).withColumn("split", F.lit(name)) for name in ("train", "val", "test")]
    onset, resolution = transition_targets("a_t")
    tasks = [
        F.struct(F.lit(name).alias("task"), F.arrays_zip(F.col(name).alias("score"), target.alias("target")).alias("cells"))
        for name, target in (("onset", onset), ("resolution", resolution))
    ]
    both = reduce(DataFrame.unionAll, parts).select("split", F.inline(F.array(*tasks)))
    cells = both.select("split", "task", F.posexplode("cells").alias("class_idx", "v"))
    cells = cells.select("split", "task", "class_idx", "v.score", "v.target")
    return metrics.macro_auroc(cells, ["split", "task"], many_scores=True)


# Metrics, losses, baselines.


@query
def auroc_by_class(spark, sf):
    return metrics.auroc_by_class(V.label_cells(spark, sf))


@query
def macro_auroc(spark, sf):
    return metrics.macro_auroc(V.label_cells(spark, sf))


@query
def macro_auroc_of_labels(spark, sf):
    """Two targets of the labels table against one score per document."""
    rows = V.table(spark, sf, "labels").withColumn("score", (F.col("doc_id") * 7919 % 1000) / 1000.0)
    cells = rows.select("score", F.posexplode(F.array("quality", "toxic")).alias("class_idx", "target"))
    return metrics.macro_auroc(cells)


@query
def bootstrap_draws(spark, sf):
    rows = V.test_pairs(spark, sf).select("idx_t")
    return bootstrap.bootstrap_draws(rows, REPLICATES, SEED, "idx_t")


@query
def tree_draws(spark, sf):
    rows = V.test_pairs(spark, sf).select("idx_t")
    return bootstrap.tree_draws(rows, REPLICATES, SEED, "idx_t")


def _carry_cells(spark, sf):
    cells = metrics.pair_cells(V.test_pairs(spark, sf))
    return cells.select("idx_t", "class_idx", F.col("y_t").alias("score"), F.col("y_t1").alias("target"))


@query
def bootstrap_auroc(spark, sf):
    return bootstrap.bootstrap_auroc(_carry_cells(spark, sf), REPLICATES, SEED, "idx_t", method="cells")


@query
def bootstrap_auroc_tree(spark, sf):
    return bootstrap.bootstrap_auroc(_carry_cells(spark, sf), REPLICATES, SEED, "idx_t", method="tree")


@query
def bootstrap_auroc_blocks(spark, sf):
    return bootstrap.bootstrap_auroc(_carry_cells(spark, sf), REPLICATES, SEED, "idx_t", method="blocks")


@query
def carry_forward(spark, sf):
    return metrics.carry_forward(metrics.pair_cells(V.test_pairs(spark, sf)))


@query
def carry_forward_macro(spark, sf):
    by_class = metrics.carry_forward(metrics.pair_cells(V.test_pairs(spark, sf)))
    return by_class.agg(F.avg("auroc").alias("macro_auroc"), F.count(F.lit(1)).alias("classes"))


@query
def onset_structural(spark, sf):
    return metrics.onset_structural(metrics.pair_cells(V.test_pairs(spark, sf)))


@query
def resolution_structural(spark, sf):
    return metrics.resolution_structural(metrics.pair_cells(V.test_pairs(spark, sf)))


@query
def evaluate_predictions(spark, sf):
    """Interval of a linear head on the first recordings of the test stays."""
    rows = select.select_mode(select.split(V.recordings(spark, sf), "test"), "triage")
    layer = rule_layer(V.CLASSES, 64)
    return bootstrap.evaluate_labels(rows, layer, REPLICATES, SEED, features="waveform", digits=9)


@query
def evaluate_transitions(spark, sf):
    return bootstrap.evaluate_transitions(V.predictions(spark, sf), REPLICATES, SEED)


@query
def evaluate_inverse(spark, sf):
    """From the embeddings of the cross-stay test pairs to the intervals."""
    weights = predictor_weights(64, 32, {"onset": V.CLASSES, "resolution": V.CLASSES})
    ends = V.embedding_pairs(spark, sf, V.chosen_test_pairs(spark, sf))
    return bootstrap.evaluate_inverse(ends, weights, REPLICATES, SEED, digits=9)


@query
def two_head_loss(spark, sf):
    weights = predictor_weights(64, 32, {"onset": V.CLASSES, "resolution": V.CLASSES})
    ends = V.embedding_pairs(spark, sf)
    rows = scoring.action_predictor(ends.withColumn("d", displacement("h_t", "h_t1")), weights)
    out = metrics.two_head_loss(rows, 46.0, 20.0)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _logits(spark, sf):
    return V.label_cells(spark, sf).withColumn("logit", 8.0 * F.col("score") - 4.0)


@query
def bce_with_logits(spark, sf):
    plain = metrics.bce_with_logits(_logits(spark, sf)).select(F.lit(1.0).alias("pos_weight"), "loss")
    heavy = metrics.bce_with_logits(_logits(spark, sf), pos_weight=46.0)
    return plain.unionByName(heavy.select(F.lit(46.0).alias("pos_weight"), "loss"))


@query
def embedding_mse(spark, sf):
    return metrics.mse(V.embedding_pairs(spark, sf), "h_t", "h_t1")


@query
def epps_pulley(spark, sf):
    dims = [(F.get("embedding", F.lit(i)).cast("double") * F.lit(8.0)).alias(f"d{i}") for i in range(64)]
    rows = V.table(spark, sf, "embeddings").select(*dims)
    return normality.epps_pulley(rows, rows.columns)


def _scaled(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 8.0)
    return V.table(spark, sf, "embeddings").select(scaled.alias("embedding"))


@query
def slice_statistics(spark, sf):
    return normality.slice_statistics(_scaled(spark, sf), normality.random_directions(0, 6, 64))


@query
def sliced_epps_pulley(spark, sf):
    return normality.sliced_epps_pulley(_scaled(spark, sf), normality.random_directions(0, 6, 64))


SLICES = 1024


@query
def seeded_slice_statistics(spark, sf):
    """All 1,024 directions of the regulariser."""
    return normality.seeded_slice_statistics(_scaled(spark, sf), SLICES, 64, seed=7)


@query
def objective(spark, sf):
    ends = V.embedding_pairs(spark, sf)
    ways = normality.random_directions(0, 6, 64)
    out = metrics.objective(
        metrics.mse(ends, "h_t", "h_t1"),
        normality.sliced_epps_pulley(ends, ways, "h_t"),
        normality.sliced_epps_pulley(ends, ways, "h_t1"),
        5.0e-3,
    )
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query
def class_balance(spark, sf):
    return metrics.class_balance(V.label_cells(spark, sf))


# Audits.


@query
def check_counts(spark, sf):
    events = V.table(spark, sf, "events")
    return quality.check_counts(V.recordings(spark, sf), V.pairs(spark, sf), events)


@query
def check_schema(spark, sf):
    rows = V.recordings(spark, sf).drop("study_id")
    return quality.check_schema(rows, S.RECORDINGS.fieldNames(), {"icd": V.CLASSES + 1, "waveform": 64})


def _altered(spark, sf):
    """Recordings with the label vectors of every subject of fold 11 reversed."""
    rows = V.recordings(spark, sf).select("row_idx", "fold", "icd_raw", "icd")
    swapped = F.when(F.col("fold") == 11, F.reverse("icd")).otherwise(F.col("icd"))
    return rows.withColumn("icd", swapped)


@query
def compare_tables(spark, sf):
    """Against a table without the rows of fold 10 and with those of fold 11 changed."""
    other = _altered(spark, sf).where("fold <> 10")
    return quality.compare_tables(V.recordings(spark, sf), other, "row_idx", ["icd_raw", "icd"])


@query
def compare_by_ranges(spark, sf):
    other = _altered(spark, sf).where("fold <> 10")
    return quality.compare_by_ranges(V.recordings(spark, sf), other, "row_idx", ["icd_raw", "icd"], 16, 200)


@query
def check_reencode(spark, sf):
    return quality.check_reencode(_altered(spark, sf), V.VOCABULARY)


@query
def stray_codes(spark, sf):
    return quality.stray_codes(V.recordings(spark, sf), V.VOCABULARY)


@query
def check_pair_rules(spark, sf):
    """Pairs with the two types exchanged in fold 5, so that the audit has something to find."""
    flipped = F.when(F.col("pair_type") == S.CROSS_STAY, S.WITHIN_STAY).otherwise(S.CROSS_STAY)
    wrong = V.pairs(spark, sf).withColumn(
        "pair_type", F.when(F.col("fold") == 5, flipped).otherwise(F.col("pair_type"))
    )
    return quality.check_pair_rules(wrong, V.recordings(spark, sf))


@query
def check_stay_agreement(spark, sf):
    return quality.check_stay_agreement(V.pairs(spark, sf), V.recordings(spark, sf))


@query
def skipped_stays(spark, sf):
    """Each recording paired with the one two steps on, so that stays are skipped."""
    rows = row_positions(V.recordings(spark, sf), ["subject_id"], pairs.TIME_ORDER, "pos")
    here = rows.select("subject_id", "pos", F.col("row_idx").alias("idx_t"))
    there = rows.select("subject_id", (F.col("pos") - 2).alias("pos"), F.col("row_idx").alias("idx_t1"))
    far = here.join(there, ["subject_id", "pos"]).withColumn("pair_type", F.lit(S.CROSS_STAY))
    return quality.skipped_stays(far.drop("pos"), V.recordings(spark, sf))


@query
def check_split_sizes(spark, sf):
    return quality.check_split_sizes(V.recordings(spark, sf))


@query
def check_values(spark, sf):
    return quality.check_values(V.predictions(spark, sf, V.all_pairs), "a_t", ["onset", "resolution"])


@query
def profile_columns(spark, sf):
    return quality.profile_columns(S.conform(V.recordings(spark, sf), S.RECORDINGS))
