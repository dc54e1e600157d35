"""What queries move and keep: by rows, since bytes of small tables say little."""

from compare import difference, duck

from stayline.functions import reshape_frames
from stayline.operators import assemble, colocated, lineage, metrics, pairs, quality, scoring
from stayline.plans import views as V
from stayline.plans.oracle import ORACLE_SQL
from stayline.plans.queries import QUERIES
from stayline.sources import tables

SF = "/root/testdata/sf0.001"


def shuffled_rows(df):
    """Rows that each exchange of an executed query wrote."""
    df.collect()
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            stack.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return found


def moved_types(df):
    """Types of the columns that the exchanges and broadcasts of an executed query carry."""
    df.collect()
    found, stack = set(), [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            stack.append(node.plan())
            continue
        if node.nodeName().endswith("Exchange"):
            found |= {node.output().apply(i).dataType().simpleString() for i in range(node.output().size())}
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return found


def test_embeddings_of_other_pairs_stay(spark):
    chosen = V.chosen_test_pairs(spark, SF)
    wanted = V.embedding_pairs(spark, SF).join(chosen, "idx_t", "left_semi")
    ends = V.embedding_pairs(spark, SF, chosen)
    assert sorted(map(str, ends.collect())) == sorted(map(str, wanted.select(*ends.columns).collect()))
    subjects = chosen.select("subject_id").distinct()
    own = V.recordings(spark, SF).join(subjects, "subject_id", "left_semi").count()
    assert max(shuffled_rows(ends)) <= own + 2 * chosen.count() < V.recordings(spark, SF).count()


def test_evaluate_inverse_equals_sql(spark):
    assert difference(spark, duck(SF), QUERIES["evaluate_inverse"], ORACLE_SQL["evaluate_inverse"], SF) is None


def test_folders_of_large_clustered_tables_are_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MOST_FOLDERS", 16)
    path = str(tmp_path / "clustered")
    far = spark.createDataFrame([(10**12,)], "row_idx long")
    tables.write_clustered(spark.range(5_000).toDF("row_idx").union(far).selectExpr("row_idx", "row_idx * 3 AS v"), path, 8)
    assert 4 < len(list((tmp_path / "clustered").glob("row_idx_div_*"))) <= 17
    asked = spark.createDataFrame([(0, 4_999), (1, 7), (2, 10**12), (3, 7), (4, 6_000)], "pos long, row_idx long")
    found = tables.take_stored_rows(spark, path, asked)
    assert [tuple(r) for r in found.select("pos", "row_idx", "v").collect()] == [(i, x, 3 * x) for i, x in ((0, 4_999), (1, 7), (2, 10**12), (3, 7))]


def test_many_scores_move_once_and_count_alike(spark):
    rows = spark.range(4_000).selectExpr(
        "if(id % 7 = 0, 'a', 'b') AS task",
        "id % 3 AS class_idx",
        "CASE WHEN id % 11 = 0 THEN double('nan') WHEN id % 13 = 0 THEN -0.0D WHEN id % 13 = 1 THEN 0.0D ELSE (hash(id) % 900) / 7D END AS score",
        "if(id % 17 = 0, NULL, hash(id, 1) & 1) AS target",
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        kept = {(r["task"], r["class_idx"]): r["auroc"] for r in metrics.auroc_by_class(rows.repartition(5), ["task"], many_scores=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {(r["task"], r["class_idx"]): r["auroc"] for r in metrics.auroc_by_class(rows, ["task"]).collect()}
    assert kept.keys() == wanted.keys() and all(abs(kept[k] - wanted[k]) < 1e-12 for k in kept) and len(kept) == 6


def test_displacement_probe_fetches_embeddings_once(spark, monkeypatch):
    V.pairs(spark, SF)
    fetched = []
    kept = scoring.fit_probe

    def fit(train, *args, **named):
        fetched.append(max(shuffled_rows(train), default=0))
        return kept(train, *args, **named)

    monkeypatch.setattr(scoring, "fit_probe", fit)
    QUERIES["displacement_probe"](spark, SF)
    assert fetched == [0]


def test_borders_stay_few_enough_to_be_broadcast(spark, monkeypatch):
    rows, index = V.recordings(spark, SF), V.pairs(spark, SF)
    many = colocated._borders_of(rows, 2)
    monkeypatch.setattr(colocated, "MOST_BORDERS", 40)
    few = colocated._borders_of(rows, 2)
    held = [b.selectExpr("count(1) + sum(size(_borders)) AS n").first()["n"] for b in (many, few)]
    assert 0 < held[1] <= 40 < held[0]
    plan = few.join(rows, "subject_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    together = colocated.fetch_pairs_together(index, rows, ["icd"], limit=2)
    wanted = pairs.fetch_pairs(index, rows, ["icd"]).select(*together.columns)
    assert sorted(map(str, together.collect())) == sorted(map(str, wanted.collect()))


def test_vectors_are_scored_in_arrow_buffers(spark, monkeypatch):
    monkeypatch.setattr(scoring, "predict_batch_udf", None)
    rows = spark.createDataFrame([(i, None if i == 4 else [float(i)] * (3 if i == 5 else 2)) for i in range(11)], "i long, v array<float>")
    out = scoring.score(rows.repartition(3), lambda: lambda v: v * 2.0, ["v"], "w", "array<double>", 2, [[2]])
    assert {r["i"]: r["w"] for r in out.collect()} == {i: None if i in (4, 5) else [2.0 * i] * 2 for i in range(11)}


def test_verifying_a_build_moves_digests_of_arrays(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(quality, "store", lambda df, name: stored.append(df) or lineage.store(df, name))
    found = QUERIES["verify_build"](spark, SF)
    moved = set().union(*(moved_types(df) for df in [found, *stored]))
    assert "bigint" in moved and not [t for t in moved if "float" in t or "array" in t]


def test_signals_are_assembled_flat(spark):
    rows = V.recordings(spark, SF)
    meta = rows.selectExpr("row_idx", "study_id", "subject_id", "ecg_no_within_stay", "fold", "row_idx AS h5_index")
    waves = rows.select(rows["row_idx"].alias("src_index"), "ecg_time", reshape_frames("waveform", V.LEADS).alias("frames"))
    built = assemble.assemble_recordings(meta, waves, rows.selectExpr("row_idx AS src_index", "icd AS labels"), V.VOCABULARY)
    assert "array<array<float>>" not in moved_types(built)
