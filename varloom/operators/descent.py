"""Gradient descent of Spark's feed-forward networks on sparse rows, for several networks at once.

Spark's own fit copies the training rows into dense blocks and keeps these (8 bytes an
input and row: 32 KB for 4,096 inputs), once for each fit that runs. Here the rows stay
sparse: an iteration is one pass over them, in which each task adds up the gradients of
all the networks; the sums are added by network and piece. The driver holds the weights,
``WEIGHTS_AT_ONCE`` of those that descend together, and no rows.

The steps are those of the ``gd`` solver: constant step size, the mean gradient of all
rows, stop where the weights move by less than ``tol`` of their length. (Spark takes the
mean over blocks of rows, in which a row of a short block counts more.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Weights of the networks that descend in one pass (one network at least), and of a piece of a gradient.
WEIGHTS_AT_ONCE, PIECE = 2_000_000, 1 << 14
#: Rows whose layers are computed together.
ROWS_AT_ONCE = 512


def sparse_rows(train: DataFrame, features: str, label: str) -> DataFrame:
    """label, at, x: the label and the places and values of a row's features."""
    row = train.select(F.col(label).cast("double").alias("label"), F.unwrap_udt(F.col(features)).alias("v"))
    at = F.coalesce("v.indices", F.transform("v.values", lambda _, i: i))
    return row.select("label", at.alias("at"), F.col("v.values").alias("x"))


def gradient(weights: np.ndarray, layers: list[int], label: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gradient of the summed loss of rows (entries: row, at, x); sigmoid layers, softmax and cross entropy at the end."""
    parts, used = [], 0
    for n, m in zip(layers, layers[1:]):
        parts.append((weights[used : used + n * m].reshape(n, m), weights[used + n * m : used + n * m + m]))
        used += n * m + m
    # The inputs that any of the rows has, side by side.
    inputs, place = np.unique(at, return_inverse=True)
    dense = np.zeros((len(label), len(inputs)))
    dense[row, place] = x
    z = dense @ parts[0][0][inputs] + parts[0][1]
    out = []
    for w, b in parts[1:]:
        out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        z = out[-1] @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    delta = p / p.sum(axis=1, keepdims=True)
    delta[np.arange(len(label)), label.astype(int)] -= 1
    found = []
    for (w, _), a in zip(parts[:0:-1], reversed(out)):
        found.append(np.concatenate([(a.T @ delta).ravel(), delta.sum(axis=0)]))
        delta = (delta @ w.T) * a * (1 - a)
    first = np.zeros(parts[0][0].shape)
    first[inputs] = dense.T @ delta
    found.append(np.concatenate([first.ravel(), delta.sum(axis=0)]))
    return np.concatenate(found[::-1])


def _gradients(rows: DataFrame, weights: dict[int, np.ndarray], layers: dict[int, list[int]]) -> dict[int, np.ndarray]:
    """The gradient of each network's summed loss over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                label = batch.column(0).to_numpy()
                length = np.diff(batch.column(1).offsets.to_numpy())
                row = np.repeat(np.arange(len(label)), length)
                at, x = (batch.column(i).flatten().to_numpy() for i in (1, 2))
                for t, w in shared.value.items():
                    found = gradient(w, layers[t], label, row, at, x)
                    sums[t] = sums[t] + found if t in sums else found
        for t, total in sums.items():
            for k in range(0, len(total), PIECE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([k]), pa.array([total[k : k + PIECE].tobytes()], pa.binary())],
                    names=["net", "piece", "sums"],
                )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for t, k, raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(raw)
                sums[t, k] = sums[t, k] + part if (t, k) in sums else part
        for (t, k), total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), pa.array([k]), pa.array([total.tobytes()], pa.binary())], names=["net", "piece", "sums"]
            )

    schema = "net int, piece long, sums binary"
    pieces = rows.mapInArrow(run, schema).repartition("net", "piece").mapInArrow(add, schema).collect()
    shared.unpersist()
    out = {t: np.zeros(len(w)) for t, w in weights.items()}
    for t, k, raw in pieces:
        part = np.frombuffer(raw)
        out[t][k : k + len(part)] = part
    return out


def _descended(rows: DataFrame, n: int, start: dict[int, np.ndarray], nets: dict[int, MultilayerPerceptronClassifier], steps: int):
    """The weights after ``steps`` iterations from ``start``."""
    weights, moving = dict(start), sorted(start)
    for i in range(steps):
        found = _gradients(rows, {t: weights[t] for t in moving}, {t: nets[t].getLayers() for t in moving})
        for t in list(moving):
            step = nets[t].getStepSize() * found[t] / n
            weights[t] = weights[t] - step
            if i and np.linalg.norm(step) < nets[t].getTol() * max(np.linalg.norm(weights[t]), 1.0):
                moving.remove(t)
        if not moving:
            break
    return weights


def descend(
    train: DataFrame, nets: dict[int, MultilayerPerceptronClassifier], before: dict[int, Model | None], steps: int
) -> dict[int, Model]:
    """A model of each network (solver ``gd``) after ``steps`` iterations more, from a model's weights on (None: from its seed)."""
    spark = train.sparkSession
    one = next(iter(nets.values()))

    def model(net: MultilayerPerceptronClassifier, weights: np.ndarray | None = None) -> Model:
        """Spark's model of these weights (None: those it starts with): a fit of no iterations, of one row without features."""
        extra = {net.maxIter: 0} if weights is None else {net.maxIter: 0, net.initialWeights: Vectors.dense(weights)}
        row = [(Vectors.sparse(net.getLayers()[0], [], []), 0.0)]
        empty = spark.createDataFrame(row, [net.getFeaturesCol(), net.getLabelCol()]).coalesce(1)
        fitted = net.copy(extra).fit(empty)
        return fitted.copy({fitted.maxIter: steps})

    rows = sparse_rows(train, one.getFeaturesCol(), one.getLabelCol()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit on")
        fresh: dict[str, np.ndarray] = {}
        out: dict[int, Model] = {}
        left = sorted(nets)
        while left:
            now: dict[int, np.ndarray] = {}
            while left and (not now or sum(map(len, now.values())) < WEIGHTS_AT_ONCE):
                t = left.pop(0)
                if before[t] is not None:
                    now[t] = before[t].weights.toArray()
                    continue
                kind = f"{nets[t].getLayers()} {nets[t].getSeed()}"
                if kind not in fresh or nets[t].isSet(nets[t].initialWeights):
                    fresh[kind] = model(nets[t]).weights.toArray()
                now[t] = fresh[kind]
            for t, w in _descended(rows, n, now, nets, steps).items():
                out[t] = model(nets[t], w)
        return {t: out[t] for t in nets}
    finally:
        rows.unpersist()
