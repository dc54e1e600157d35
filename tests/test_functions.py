import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline import functions as fn
from stayline import schema as S

VOCAB = ["a", "b", "c"]


def one(spark, values, schema, **exprs):
    df = spark.createDataFrame(values, schema)
    return df.select(*[e.alias(n) for n, e in exprs.items()]).collect()


def test_encode_and_decode(spark):
    lists = [([],), (None,), (["b", "b"],), (["x", "a"],), (["c", "b", "a"],), ([None, "c"],)]
    got = one(spark, lists, "codes array<string>", v=fn.encode_labels("codes", VOCAB))
    vectors = [r.v for r in got]
    assert vectors == [[0, 0, 0], None, [0, 1, 0], [1, 0, 0], [1, 1, 1], [0, 0, 1]]
    back = one(spark, [(v,) for v in vectors], "v array<tinyint>", c=fn.decode_labels("v", VOCAB))
    assert [r.c for r in back] == [[], None, ["b"], ["a"], ["a", "b", "c"], ["c"]]


def test_repeated_vocabulary(spark):
    with pytest.raises(ValueError):
        fn.encode_labels("codes", ["a", "a"])


def test_transitions(spark):
    schema = "y array<tinyint>, z array<tinyint>"
    rows = [([0, 0, 1, 1], [0, 1, 0, 1])]
    got = one(spark, rows, schema, a=fn.transition_vector("y", "z"))[0].a
    assert got == [0, 1, -1, 0]
    on, off = fn.transition_targets("z")
    rows = [([0, 0, 1, 1], got)]
    r = one(spark, rows, schema, n=fn.next_labels("y", "z"), on=on, off=off)[0]
    assert (r.n, r.on, r.off) == ([0, 1, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0])


def test_contextual_prediction(spark):
    rows = [([0, 1], [0.25, 0.5], [0.75, 0.125])]
    schema = "y array<tinyint>, p array<double>, q array<double>"
    got = one(spark, rows, schema, c=fn.contextual_prediction("y", "p", "q"))[0].c
    assert got == [0.25, 0.875]


def test_frames_of_partial_signals(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, 4.0, 5.0],), ([1.0],), ([float("inf")] * 3,)], "w array<float>")
    got = [r.f for r in df.select(fn.reshape_frames("w", 3).alias("f")).collect()]
    assert got == [[[1.0, None, 3.0]], [], [[float("inf")] * 3]]


def test_frames_in_batches_are_the_same_frames(spark):
    signals = [None if i % 7 == 3 else [None if (i + j) % 11 == 5 else j / 8 for j in range(i % 10)] for i in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(signals)], "i long, w array<float>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for leads in (1, 3, 4):
            got = df.select(fn.reshape_frames("w", leads).alias("a"), fn.reshape_frames_batch(leads)("w").alias("b"))
            assert got.schema["a"].dataType.simpleString() == got.schema["b"].dataType.simpleString()
            rows = got.collect()
            assert [r.a for r in rows] == [r.b for r in rows] and len(rows) == 60
        whole = df.where("size(w) = 8 OR w IS NULL OR size(w) = 0")
        assert all(r[0] == r[1] for r in whole.select(fn.reshape_frames_batch(4)("w"), fn.reshape_frames("w", 4)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frames_and_leads(spark):
    flat = np.arange(12, dtype=float)
    rows = [(flat.tolist(),), (None,), ([],)]
    df = spark.createDataFrame(rows, "w array<float>")
    frames = df.select(fn.reshape_frames("w", 3).alias("f"))
    got = [r.f for r in frames.collect()]
    assert got == [flat.reshape(4, 3).tolist(), None, []]
    assert [r[0] for r in frames.select(fn.flatten_frames("f")).collect()] == [r[0] for r in rows]

    df = df.where(F.size("w") != 0)
    native = [r[0] for r in df.select(fn.lead_major("w", 4, 3)).collect()]
    batched = [r[0] for r in df.select(fn.lead_major_batch(4, 3)("w")).collect()]
    assert native == batched == [flat.reshape(4, 3).T.tolist()]


def test_lead_batches_keep_null_rows(spark):
    flat = np.random.default_rng(0).normal(size=(5, 12)).astype(np.float32)
    rows = [(i, flat[i].tolist() if i % 2 else None) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, w array<float>").coalesce(1)
    for zscore in (False, True):
        got = df.select("i", fn.lead_major_batch(4, 3, zscore)("w").alias("l")).orderBy("i").collect()
        for r in got:
            if r.i % 2 == 0:
                assert r.l is None
                continue
            want = flat[r.i].reshape(4, 3).T.astype(float)
            if zscore:
                spread = np.maximum(want.std(axis=1, ddof=1, keepdims=True), 1e-6)
                want = (want - want.mean(axis=1, keepdims=True)) / spread
            assert np.allclose(r.l, want, atol=1e-6)


def test_constant_lead_is_not_divided_by_zero(spark):
    got = one(spark, [([[2.0, 2.0, 2.0]],)], "l array<array<double>>", z=fn.zscore_leads("l"))
    assert got[0].z == [[0.0, 0.0, 0.0]]


def test_draw_is_stable(spark):
    assert spark.range(1).select(fn.draw("id", 42)).first()[0] == 761537681252206945


def test_conform(spark):
    df = spark.range(1).selectExpr("id row_idx", "1L a")
    with pytest.raises(ValueError):
        S.conform(df, S.PAIRS)


def test_identities(spark):
    """decode then encode, and transition then next labels, over all vectors of three classes."""
    vectors = [[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    rows = [(y, z) for y in vectors for z in vectors]
    df = spark.createDataFrame(rows, "y array<tinyint>, z array<tinyint>")
    df = df.withColumns({"a": fn.transition_vector("y", "z"), "codes": fn.decode_labels("y", VOCAB)})
    back = df.select("y", "z", fn.next_labels("y", "a").alias("n"), fn.encode_labels("codes", VOCAB).alias("e"))
    assert all(r.n == r.z and r.e == r.y for r in back.collect())
