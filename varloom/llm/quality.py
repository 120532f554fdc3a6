"""Quality scores by Bradley-Terry pairwise ranking.

A preference pair is a document labelled good and one labelled bad. The score of a
document is linear in text features (repetition, symbols, word and line shapes); the
weights minimise the logistic loss of the pairs' feature differences, so that the
probability that one document is preferred depends on the difference of the scores
only. Every labelled document that may be learned from meets every one of the other class:
the loss needs of a score only how many documents of the other class lie how far away, so
a step counts the documents and sums their features by narrow ``BINS`` of the score, in
Spark, and pairs the bins. The cut is a quantile of the labelled documents' scores: the share
of bad labels at which good and bad separate best; ``score`` maps the linear score to (0, 1)
so that this quantile is ``CUT`` = 0.7, and ``predicted`` is 1 from there on.

Fitted on all labelled documents, whole texts whatever their length; a row counts once for
each time it is there. ``shaped`` takes the features in one pass over the texts; the fit and
the scores then read these alone. The driver holds sums of a bin, never a document. Null or
empty texts have zero features. Repeated rows get equal scores. Labels without both
classes give every document the share of good labels (0 without any). Extra columns pass
through ``score_documents``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, require_free, text_slices
from varloom.llm.labelled import labelled_ids

#: The column of a document's features.
SHAPE = "quality_shape"
#: Weight of a document's pairs together, against the ridge.
PAIRS_EACH = 8
#: Standardised features are clipped here, which bounds the score.
CLIP = 8
#: Bins of the whole range that scores can have; where the cut is looked for, ``FINER`` times as many.
BINS, FINER = 2048, 8
#: Gain of a step, as a share of the loss, under which the weights stay.
ENOUGH = 1e-5
CUT = 0.7

_ALPHA = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _ALPHA + _DIGITS + b".,")
_KEEP = {name: bytes(b for b in range(256) if b not in chars) for name, chars in {
    "alpha": _ALPHA, "upper": bytes(range(65, 91)), "digit": _DIGITS, "symbol": _SYMBOLS, "stop": b".", "comma": b",",
}.items()}


def features(text: str | None) -> list[float]:
    """Shape of a text; shares are of its bytes, words or lines."""
    raw = (text or "").encode("utf-8")
    words, size = raw.split(), max(1, len(raw))
    n = max(1, len(words))
    count = {name: len(raw.translate(None, drop)) for name, drop in _KEEP.items()}
    times = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    top = max(times.values(), default=0)
    odd = sum(k for w, k in times.items() if w.translate(None, _ALPHA + b".,"))
    short = sum(k for w, k in times.items() if len(w) == 1)
    return [
        np.log1p(len(words)),
        len(times) / n, top / n, (len(words) - 1 - len(pairs)) / n if words else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / m if lines else 0.0, np.log1p(n / m),
        count["alpha"] / size, count["upper"] / size, count["digit"] / size, count["symbol"] / size,
        count["stop"] / n, count["comma"] / n, odd / n, short / n,
        sum(map(len, words)) / n, float(raw.rstrip().endswith(b".")),
        raw.count(b"|") / n, raw.count(b"http") / n, raw.count(b"\n") / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: float
    width: float
    constant: float | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def linear(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (self.linear(x) - self.at) / self.width + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Documents of one class by bin of their score: bin, how many, sums of their features.
Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def bin_width(w: np.ndarray, bins: int = BINS) -> float:
    return max(1e-9, 2 * CLIP * float(np.abs(w).sum()) / bins)


def cells(x: np.ndarray, w: np.ndarray, width: float) -> Cells:
    bins, at = np.unique(np.floor(x @ w / width).astype(np.int64), return_inverse=True)
    sums = np.zeros((len(bins), x.shape[1]))
    np.add.at(sums, at, x)
    return bins, np.bincount(at, minlength=len(bins)).astype(float), sums


def second_moments(x: np.ndarray, w: np.ndarray, width: float, bins: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the rows, each by the share of its bin."""
    at = np.searchsorted(bins, np.floor(x @ w / width).astype(np.int64))
    own = share[np.minimum(at, len(bins) - 1)]
    return (x * own[:, None]).T @ x


@dataclass
class Pairs:
    """All pairs of a good and a bad document at weights ``w``, by the bins of both."""

    w: np.ndarray
    good: Cells
    bad: Cells

    def __post_init__(self):
        (_, n, x), (_, m, y) = self.good, self.bad
        apart = ((x @ self.w) / n)[:, None] - ((y @ self.w) / m)[None, :]
        self.each = PAIRS_EACH * (n.sum() + m.sum()) / (n.sum() * m.sum())
        self.loss = self.each * float(n @ np.logaddexp(0, -apart) @ m)
        miss = 1 / (1 + np.exp(np.clip(apart, -30, 30)))
        self.gradient = self.each * (y.T @ (n @ miss) - x.T @ (miss @ m))
        self.spread = self.each * miss * (1 - miss)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """What a good and what a bad document's outer product counts, by bin."""
        return self.spread @ self.bad[1], self.good[1] @ self.spread

    def hessian(self, moments: np.ndarray) -> np.ndarray:
        cross = self.good[2].T @ self.spread @ self.bad[2]
        return moments - cross - cross.T


def newton(pairs: Callable[[np.ndarray], Pairs], moments: Callable[[Pairs], np.ndarray], n: int,
           ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights that minimise the logistic loss of all pairs, by Newton steps that are halved where the loss would rise."""

    def loss(p: Pairs) -> float:
        return p.loss + ridge / 2 * float(p.w @ p.w)

    at = pairs(np.zeros(n))
    for _ in range(steps):
        step = np.linalg.solve(at.hessian(moments(at)) + ridge * np.eye(n), at.gradient + ridge * at.w)
        after = pairs(at.w - step)
        while loss(after) > loss(at) * (1 + ENOUGH) and np.abs(step).max() >= ENOUGH:
            step /= 2
            after = pairs(at.w - step)
        gain, at = loss(at) - loss(after), after
        if gain <= ENOUGH * loss(at):
            break
    return at.w


@dataclass
class Rows:
    """Standardised features of two small classes, by label."""

    x: dict[int, np.ndarray]

    def cells(self, w: np.ndarray, width: float) -> dict[int, Cells]:
        return {k: cells(x, w, width) for k, x in self.x.items()}

    def second_moments(self, p: Pairs) -> np.ndarray:
        sides = zip((1, 0), (p.good, p.bad), p.shares())
        return sum(second_moments(self.x[k], p.w, bin_width(p.w), c[0], share) for k, c, share in sides)


def weights(rows: Rows | Table, n: int, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    def pairs(w: np.ndarray) -> Pairs:
        found = rows.cells(w, bin_width(w))
        return Pairs(w, found[1], found[0])

    return newton(pairs, rows.second_moments, n, ridge, steps)


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """The weights of two small classes, rows of standardised features."""
    return weights(Rows({1: good, 0: bad}), good.shape[1], ridge, steps)


def _matrix(shapes: pa.Array) -> np.ndarray:
    return shapes.flatten().to_numpy(zero_copy_only=False).reshape(len(shapes), -1)


@dataclass
class Table:
    """label and ``SHAPE`` of the documents to learn from; sums are taken in Spark."""

    rows: DataFrame
    model: Model

    def cells(self, w: np.ndarray, width: float) -> dict[int, Cells]:
        model = self.model

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels, x = batch.column(0).to_numpy(), model.standard(_matrix(batch.column(1)))
                for label in np.unique(labels):
                    bins, n, sums = cells(x[labels == label], w, width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(bins), label), pa.int32()), pa.array(bins), pa.array(n),
                         pa.array(list(sums), pa.list_(pa.float64()))],
                        names=["label", "bin", "n", "sums"],
                    )

        partial = self.rows.mapInArrow(run, "label int, bin long, n double, sums array<double>")
        each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(w))]
        rows = sorted(partial.groupBy("label", "bin").agg(F.sum("n").alias("n"), *each).collect())
        found = np.array(rows, dtype=float).reshape(len(rows), 3 + len(w))
        return {k: (c[:, 1].astype(np.int64), c[:, 2], c[:, 3:]) for k in (0, 1) for c in [found[found[:, 0] == k]]}

    def second_moments(self, p: Pairs) -> np.ndarray:
        model, w, width, size = self.model, p.w, bin_width(p.w), len(p.w)
        sides = {k: (c[0], share) for k, c, share in zip((1, 0), (p.good, p.bad), p.shares())}

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, size))
            for batch in batches:
                labels, x = batch.column(0).to_numpy(), model.standard(_matrix(batch.column(1)))
                for label, (bins, share) in sides.items():
                    if (own := labels == label).any():
                        total += second_moments(x[own], w, width, bins, share)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["moments"])

        parts = self.rows.mapInArrow(run, "moments array<double>").select(F.posexplode("moments").alias("at", "x"))
        rows = parts.groupBy("at").agg(F.sum("x")).collect()
        return np.array([x for _, x in sorted(rows)]).reshape(size, size)


def _cut(good: Cells, bad: Cells, width: float) -> float:
    """The score, a quantile of all, from which on good and below which bad documents have the largest shares together."""
    bins = np.union1d(good[0], bad[0])
    n, m = np.zeros(len(bins)), np.zeros(len(bins))
    n[np.searchsorted(bins, good[0])], m[np.searchsorted(bins, bad[0])] = good[1], bad[1]
    quantiles = np.searchsorted(np.cumsum(n + m) / (n + m).sum(), np.linspace(0, 1, 401) - 1e-12)
    at = np.unique(np.minimum(quantiles, len(bins) - 1))
    right = 1 - (np.cumsum(n) - n)[at] / n.sum() + (np.cumsum(m) - m)[at] / m.sum()
    best = at[right >= right.max() - 1e-12]
    return float((bins[best[0]] + bins[best[-1]]) / 2 * width)


def _fitted(n_good: int, n_bad: int, mean: np.ndarray, scale: np.ndarray, rows: Callable[[Model], Rows | Table]) -> Model:
    if n_good < 2 or n_bad < 2:
        total = n_good + n_bad
        return Model(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 1.0, n_good / total if total else 0.0)
    # Sums come in any order; the last digits are dropped, so that reruns agree.
    model = Model(np.round(mean, 10), np.maximum(np.round(scale, 10), 1e-6), np.zeros(len(mean)), 0.0, 1.0)
    train = rows(model)
    model.weights = np.round(weights(train, len(mean)), 8)
    width = bin_width(model.weights, BINS * FINER)
    found = train.cells(model.weights, width)
    model.at = _cut(found[1], found[0], width)
    return model


def fit(texts: dict[int, list[str]]) -> Model:
    """A model of a few texts at hand."""
    x = {k: np.array([features(t) for t in texts.get(k, [])]).reshape(-1, len(features(None))) for k in (1, 0)}
    both = np.concatenate([x[1], x[0]])
    mean, scale = (both.mean(axis=0), both.std(axis=0)) if len(both) else (None, None)
    return _fitted(len(x[1]), len(x[0]), mean, scale, lambda model: Rows({k: model.standard(v) for k, v in x.items()}))


def shaped(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``SHAPE`` in place of the text, written once."""
    require_free(docs, SHAPE)
    at = docs.columns.index("text")
    schema = docs.drop("text").withColumn(SHAPE, F.array(F.lit(0.0))).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            x = [features(t.as_py()) for t in batch.column(at)]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(x, pa.list_(pa.float64()))],
                names=[*[batch.schema.names[i] for i in kept], SHAPE],
            )

    return Scratch(docs.sparkSession, "quality").stage(docs.mapInArrow(run, schema), "shapes")


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Model:
    """A model fitted on all labelled rows but those whose crc remainder is ``held_out``.

    ``docs`` have texts, or are ``shaped`` already.
    """
    docs = docs if SHAPE in docs.columns else shaped(docs.select("doc_id", "text"))
    ids = labelled_ids(labels, "quality", modulus, held_out)
    train = docs.select("doc_id", SHAPE).join(ids, "doc_id").select("label", SHAPE)
    train = Scratch(docs.sparkSession, "quality_fit").stage(train, "train")
    size = len(features(None))
    columns = [F.col(SHAPE)[i] for i in range(size)]
    counts = [F.count(F.when(F.col("label") == k, 1)) for k in (1, 0)]
    n_good, n_bad, *row = train.agg(*counts, *map(F.avg, columns), *map(F.stddev_pop, columns)).first()
    moments = [np.array(m, dtype=float) for m in (row[:size], row[size:])]
    return _fitted(n_good, n_bad, *moments, lambda model: Table(train, model))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` and ``column``, higher where the text is likelier of good quality. A column of that name in ``docs`` is an error.

    ``docs`` have texts, or are ``shaped`` already.
    """
    require_free(docs, column)
    known = SHAPE in docs.columns
    schema, at = docs.withColumn(column, F.lit(0.0)).schema, docs.columns.index(SHAPE if known else "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if known else text_slices(batches, at):
            rows = batch.column(at)
            x = _matrix(rows) if known else np.array([features(t.as_py()) for t in rows]).reshape(len(rows), -1)
            scores = shared.value.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column]
            )

    return docs.mapInArrow(run, schema)
