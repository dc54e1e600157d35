"""Batch inference with a user's model, and the heads used on embeddings."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.arrays import displacement
from ..functions.labels import transition_targets
from .lineage import store


LOGITS = T.ArrayType(T.DoubleType())
FLAT = [T.ArrayType(t(), n) for t in (T.FloatType, T.DoubleType, T.ByteType) for n in (True, False)]
_models: dict[str, Callable[..., object]] = {}  # of this Python worker


def _flat_udf(make_predict: Callable[[], Callable[..., object]], kind: T.DataType, batch_size: int, sizes: Sequence[int]):
    """As `predict_batch_udf` for vectors in and out, which stay in Arrow's buffers and are never lists of numbers."""
    name = uuid.uuid4().hex

    def vectors(values) -> pa.Array:
        flat = np.ascontiguousarray(values, dtype=np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))

    def scored(columns: Sequence[pa.Array]) -> pa.Array:
        if name not in _models:
            _models[name] = make_predict()
        parts = []
        for start in range(0, max(1, len(columns[0])), batch_size):
            cut = [c.slice(start, batch_size) for c in columns]
            result = _models[name](*[c.flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c, n in zip(cut, sizes)])
            if isinstance(kind, T.StructType):
                parts.append(pa.StructArray.from_arrays([vectors(result[f.name]) for f in kind], [f.name for f in kind]))
            else:
                parts.append(vectors(result))
        return pa.concat_arrays(parts)

    if len(sizes) == 1:

        @F.arrow_udf(kind)
        def run(a: pa.Array) -> pa.Array:
            return scored([a])
    else:

        @F.arrow_udf(kind)
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return scored([a, b])

    return run


def score(
    df: DataFrame,
    make_predict: Callable[[], Callable[..., object]],
    in_cols: Sequence[str],
    out: str,
    out_type: T.DataType | str,
    batch_size: int = 1024,
    shapes: Sequence[Sequence[int]] | None = None,
) -> DataFrame:
    """Append ``out`` = predict(batch). ``make_predict`` loads the model, once per Python worker.

    ``shapes`` gives the shape of each array input, without the batch dimension. A row with a null
    input, or an array of another size, takes part as zeros and its result is null.
    """
    kind = T._parse_datatype_string(out_type) if isinstance(out_type, str) else out_type
    fields = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind]
    inputs_known = all(df.schema[c].dataType in FLAT for c in in_cols)
    if shapes and inputs_known and all(len(s) == 1 for s in shapes) and len(shapes) < 3 and all(f == LOGITS for f in fields):
        udf = _flat_udf(make_predict, kind, batch_size, [s[0] for s in shapes])
    else:
        udf = predict_batch_udf(
            make_predict,
            return_type=kind,
            batch_size=batch_size,
            input_tensor_shapes=[list(s) for s in shapes] if shapes else None,
        )
    inputs, whole = [], F.lit(True)
    for i, c in enumerate(in_cols):
        sound, blank = F.col(c).isNotNull(), F.lit(0)
        if shapes:
            size = math.prod(shapes[i])
            sound, blank = F.coalesce(F.size(c) == size, F.lit(False)), F.array_repeat(F.lit(0), size)
        inputs.append(F.when(sound, F.col(c)).otherwise(blank.cast(df.schema[c].dataType)))
        whole = whole & sound
    scored = df.withColumn(out, F.when(whole, udf(*inputs)))
    if isinstance(kind, T.StructType):
        scored = scored.select(*df.columns, f"{out}.*")
    return scored


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _linear(x: np.ndarray, layer: Mapping[str, np.ndarray]) -> np.ndarray:
    return x @ layer["weight"].T + layer["bias"]


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def _residual(x: np.ndarray, weights: Mapping[str, Mapping[str, np.ndarray]]) -> np.ndarray:
    x = _relu(_linear(x, weights["input"]))
    return _relu(x + _linear(_relu(_linear(x, weights["residual_in"])), weights["residual_out"]))


def _wide(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.float64)


def linear_head(
    df: DataFrame, weight: np.ndarray, bias: np.ndarray, col: str = "embedding", batch_size: int = 1024
) -> DataFrame:
    """Append ``logits`` = W h + b and ``probs`` = sigmoid(logits)."""
    layer = {"weight": _wide(weight), "bias": _wide(bias)}

    def make():
        def predict(h):
            logits = _linear(_wide(h), layer)
            return {"logits": logits, "probs": sigmoid(logits)}

        return predict

    kind = T.StructType([T.StructField("logits", LOGITS), T.StructField("probs", LOGITS)])
    return score(df, make, [col], "_head", kind, batch_size, [[layer["weight"].shape[1]]])


def action_projector(
    df: DataFrame, weights: Sequence[Mapping[str, np.ndarray]], col: str = "a_t", batch_size: int = 1024
) -> DataFrame:
    """Append ``action_emb``: three linear layers with ReLU between, on the transition vector."""
    first, second, third = weights

    def make():
        return lambda a: _linear(_relu(_linear(_relu(_linear(_wide(a), first)), second)), third)

    return score(df, make, [col], "action_emb", LOGITS, batch_size, [[first["weight"].shape[1]]])


def dynamics_predictor(
    df: DataFrame,
    weights: Mapping[str, Mapping[str, np.ndarray]],
    state: str = "h_t",
    action: str = "action_emb",
    batch_size: int = 1024,
) -> DataFrame:
    """Append ``h_t1_hat`` from the state and the action embedding.

    ``weights`` has the layers input, residual_in, residual_out and output.
    """
    dim = weights["output"]["weight"].shape[0]

    def make():
        def predict(h, a):
            both = np.concatenate([_wide(h), _wide(a)], axis=1)
            return _linear(_residual(both, weights), weights["output"])

        return predict

    action_dim = weights["input"]["weight"].shape[1] - dim
    return score(df, make, [state, action], "h_t1_hat", LOGITS, batch_size, [[dim], [action_dim]])


def action_predictor(
    df: DataFrame,
    weights: Mapping[str, Mapping[str, np.ndarray]],
    col: str = "d",
    batch_size: int = 1024,
) -> DataFrame:
    """Append ``onset_logits`` and ``resolution_logits`` from the displacement.

    ``weights`` has the layers input, residual_in, residual_out, onset and resolution.
    """

    def make():
        def predict(d):
            x = _residual(_wide(d), weights)
            return {
                "onset_logits": _linear(x, weights["onset"]),
                "resolution_logits": _linear(x, weights["resolution"]),
            }

        return predict

    kind = T.StructType(
        [T.StructField("onset_logits", LOGITS), T.StructField("resolution_logits", LOGITS)]
    )
    return score(df, make, [col], "_heads", kind, batch_size, [[weights["input"]["weight"].shape[1]]])


def transition_probabilities(
    df: DataFrame,
    weights: Mapping[str, Mapping[str, np.ndarray]],
    h_t: str = "h_t",
    h_t1: str = "h_t1",
    batch_size: int = 1024,
) -> DataFrame:
    """Append the probability vectors ``onset`` and ``resolution`` that `action_predictor` gives the displacement."""
    moved = df.withColumn("_d", displacement(h_t, h_t1))
    heads = action_predictor(moved, weights, "_d", batch_size)
    return heads.withColumns(
        {f"{n}": F.transform(f"{n}_logits", lambda x: 1.0 / (1.0 + F.exp(-x))) for n in ("onset", "resolution")}
    ).drop("_d")


def _probe_sums(weight: np.ndarray, dim: int):
    """Rows of a partition -> their number, and per class the loss and the gradient by weight and bias."""
    classes = len(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, np.zeros((classes, dim + 2))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, classes).astype(np.float64)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            margin = x @ weight.T
            rows += len(x)
            sums[:, 0] += (np.logaddexp(0, margin) - y * margin).sum(axis=0)
            sums[:, 1:] += (sigmoid(margin) - y).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([sums.reshape(-1).tolist()])], names=["n", "sums"])

    return run


def fit_probe(
    train: DataFrame,
    classes: int,
    features: str,
    labels: str,
    max_iter: int,
    reg: float,
    tolerance: float = 1e-7,
    stored: bool = False,
) -> np.ndarray:
    """(classes, dim + 1) weights and biases of one logistic model per class, all fitted together.

    Minimises mean loss + reg / 2 |w|^2 (the bias is free) by L-BFGS. One job an iteration, whatever
    the number of classes: each task sends its sums once. Rows with a null or a wrong size are left out.
    The rows are stored first, in the types they have, unless ``stored`` says that they lie in storage already.
    """
    rows = train.select(features, labels)
    rows = rows if stored else store(rows, "probe-rows")
    first = rows.where(F.col(features).isNotNull()).select(F.size(features).alias("n")).first()
    dim = first["n"] if first else 0
    if not dim:
        return np.zeros((classes, dim + 1))
    rows = rows.where((F.size(features) == dim) & (F.size(labels) == classes))

    def at(weight: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(_probe_sums(weight, dim), "n long, sums array<double>")
        by_place = parts.select("n", F.posexplode("sums").alias("place", "value")).groupBy("place")
        table = by_place.agg(F.sum("n").alias("n"), F.sum("value").alias("value")).orderBy("place").toArrow()
        n, sums = table["n"][0].as_py(), table["value"].to_numpy()
        sums = sums.reshape(classes, dim + 2) / max(1, n)
        free = np.ones(dim + 1)
        free[-1] = 0
        return sums[:, 0].sum() + reg / 2 * (weight**2 * free).sum(), sums[:, 1:] + reg * weight * free

    return minimise(at, np.zeros((classes, dim + 1)), max_iter, tolerance)


def minimise(at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tolerance: float) -> np.ndarray:
    """L-BFGS with the last ten steps and halving line search."""
    value, slope = at(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(slope).max() < tolerance:
            break
        way, shares = slope.copy(), []
        for s, y in reversed(steps):
            shares.append((s * way).sum() / (s * y).sum())
            way -= shares[-1] * y
        if steps:
            s, y = steps[-1]
            way *= (s * y).sum() / (y * y).sum()
        for (s, y), share in zip(steps, reversed(shares)):
            way += (share - (y * way).sum() / (s * y).sum()) * s
        length = 1.0
        while True:
            moved, grown = at(x - length * way)
            if moved <= value - 1e-4 * length * (slope * way).sum() or length < 1e-8:
                break
            length /= 2
        step, change = -length * way, grown - slope
        x, value, slope = x + step, moved, grown
        if (step * change).sum() > 1e-14:
            steps = [*steps[-9:], (step, change)]
    return x


def linear_probe(
    train: DataFrame,
    test: DataFrame,
    classes: int,
    features: str = "embedding",
    labels: str = "labels",
    max_iter: int = 50,
    reg: float = 0.0,
) -> DataFrame:
    """Fit one logistic model per class on frozen embeddings of ``train`` and append its ``probs`` to ``test``."""
    fitted = fit_probe(train, classes, features, labels, max_iter, reg)
    return linear_head(test, fitted[:, :-1], fitted[:, -1], features).drop("logits")


def displacement_probe(
    train: DataFrame,
    test: DataFrame,
    classes: int,
    h_t: str = "h_t",
    h_t1: str = "h_t1",
    a_t: str = "a_t",
    max_iter: int = 50,
    reg: float = 0.0,
    moved: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Append ``onset`` and ``resolution`` to ``test``: what linear models on the displacement say of each label.

    Two logistic models per class, for labels that come and labels that go, are fitted on the pairs of
    ``train``, all together. Pairs with a null or a wrong size are left out of the fit and score null.
    ``moved`` names a column that has the displacement already; for ``stored`` see `fit_probe`.
    """
    change = F.col(moved) if moved else displacement(h_t, h_t1)
    fit = train.select(change.alias("moved"), F.concat(*transition_targets(a_t)).alias("targets"))
    fitted = fit_probe(fit, 2 * classes, "moved", "targets", max_iter, reg, stored=stored)
    scored = linear_head(test.withColumn("_moved", change), fitted[:, :-1], fitted[:, -1], "_moved")
    heads = {"onset": F.slice("probs", 1, classes), "resolution": F.slice("probs", classes + 1, classes)}
    return scored.withColumns(heads).drop("_moved", "probs", "logits")
