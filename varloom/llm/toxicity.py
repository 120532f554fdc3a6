"""Toxicity by compression distance with zstandard dictionaries.

Fit, on a bounded sample of labelled documents (``PER_CLASS`` texts of ``MAX_CHARS``
characters at most): for each class, the byte strings that mark it (``GRAM``-byte
grams found in clearly more of its documents than of the other class's, joined into
their maximal runs) are put in a dictionary, the commonest next to the text. Both
dictionaries share the same neutral text, so that words which mark no class cost the
same in both. Score: a text is cut, at spaces, into windows of about ``WINDOW``
bytes; each window, after a fixed neutral prefix, is compressed with either dictionary, and the bytes that the toxic
one saves are compared with ``THRESHOLDS``. How many windows pass each of them, in
all and by share, is calibrated to a probability by logistic regression on the half
of the sample that the dictionaries have not seen; then the dictionaries are trained
again on the whole sample.

Whole texts are scored, whatever their length. Null or empty texts have one empty
window and get the score of no evidence. Repeated rows get equal scores. A sample
without both classes gives the share of toxic labels (0 without any) as every score.
Extra columns pass through ``score_documents``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import require_free, text_slices
from varloom.llm.labelled import sample

#: Bounds of the sample that the model is fitted on.
PER_CLASS = {1: 1000, 0: 2500}
MAX_CHARS = 12_000
GRAM = 6
MIN_Z = 6.0
WINDOW = 32
SEGMENT_BYTES = 6_144
NEUTRAL_BYTES = 512
THRESHOLDS = (3, 5, 7)
#: Bytes of shared text before each window: without something to compress, zstandard
#: stores so short a window as it is and no dictionary shows.
PREFIX_BYTES = 48
#: Small tables, since each window resets them; lazy matching, which finds short matches.
SEARCH = dict(
    window_log=14, hash_log=12, chain_log=12, search_log=5, min_match=4, target_length=8,
    strategy=zstandard.STRATEGY_LAZY,
)


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """The text in pieces of ``size`` bytes or a little more, cut after spaces; one empty piece if empty."""
    out, at, end = [], 0, len(raw)
    while at < end:
        cut = raw.find(b" ", at + size)
        cut = end if cut < 0 or cut - at > 8 * size else cut + 1
        if cut == end and end - at > 8 * size:  # no space for long: a fixed length
            cut = at + 4 * size
        out.append(raw[at:cut])
        at = cut
    return out or [b""]


def _grams(raw: bytes) -> np.ndarray:
    """Each ``GRAM``-byte gram of the text, blanks added at both ends, as one integer.

    A gram that crosses a blank (one inside, not at an end) is 0: it marks neighbours, not words.
    """
    data = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint64)
    n = max(0, len(data) - GRAM + 1)
    codes = np.zeros(n, np.uint64)
    for i in range(GRAM):
        codes = (codes << np.uint64(8)) | data[i : i + n]
    blank = data <= 32
    for i in range(1, GRAM - 1):
        codes[blank[i : i + n]] = 0
    return codes


def marking_grams(own: list[bytes], other: list[bytes]) -> np.ndarray:
    """Grams in clearly more of the own documents: a two-proportion z of ``MIN_Z`` or more."""

    def counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(_grams(t)) for t in texts]), return_counts=True)

    (grams, k), (others, counted) = counts(own), counts(other)
    often = k >= max(3, len(own) // 100)
    grams, k = grams[often], k[often]
    at = np.minimum(np.searchsorted(others, grams), len(others) - 1)
    j = np.where(others[at] == grams, counted[at], 0)
    n, m = len(own), len(other)
    p = (k + j) / (n + m)
    z = (k / n - j / m) / np.maximum(1e-9, np.sqrt(p * (1 - p) * (1 / n + 1 / m)))
    return grams[(z >= MIN_Z) & (grams > 0)]


def _runs(raw: bytes, grams: np.ndarray) -> set[bytes]:
    """The maximal stretches of the text that marking grams cover."""
    hit = np.isin(_grams(raw), grams)
    raw = b" " + raw + b" "
    cover = np.zeros(len(raw) + 2, np.int8)
    for i in range(GRAM):
        cover[1 + i : 1 + i + len(hit)] |= hit
    edge = np.diff(cover)
    return {raw[a:b] for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])}


def train_dictionary(own: list[bytes], other: list[bytes], neutral: bytes) -> bytes:
    """Raw dictionary content of a class: neutral text, then its segments, the commonest last."""
    grams = marking_grams(own, other)
    counts: Counter = Counter()
    for raw in own:
        counts.update(_runs(raw, grams))
    chosen, size = [], 0
    for segment, n in sorted(counts.items(), key=lambda s: (-s[1], s[0])):
        if n < 3 or size + len(segment) > SEGMENT_BYTES:
            break
        if not any(segment in c for c in chosen):
            chosen.append(segment)
            size += len(segment)
    return neutral + b"".join(reversed(chosen))


def _neutral(texts: list[bytes]) -> bytes:
    """Pieces of many documents of both classes, a little of each."""
    out, size = [], 0
    step = max(64, NEUTRAL_BYTES // max(1, len(texts)))
    for raw in texts:
        piece = raw[:step].rsplit(b" ", 1)[0] + b" "
        if size + len(piece) > NEUTRAL_BYTES:
            break
        out.append(piece)
        size += len(piece)
    return b"".join(out)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        **SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    content = content if len(content) >= 8 else content + b" " * 8
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


class Distance:
    """Window-wise bytes that the toxic dictionary saves."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        # Both dictionaries begin with the neutral text. The blank stands before a first word.
        self.prefix = toxic[: PREFIX_BYTES - 1] + b" "

    def saved(self, raw: bytes) -> np.ndarray:
        toxic, ordinary, prefix = self.toxic.compress, self.ordinary.compress, self.prefix
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in (prefix + w for w in windows(raw + b" "))])

    def features(self, raw: bytes) -> list[float]:
        saved = self.saved(raw)
        n = len(saved)
        out = []
        for t in THRESHOLDS:
            k = int((saved >= t).sum())
            out += [np.log1p(k), np.log((k + 0.25) / (n + 4))]
        return [*out, np.log1p(n)]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: dict[int, list[str]]) -> Model:
    raw = {k: [t.encode("utf-8") for t in v] for k, v in texts.items()}
    toxic, ordinary = raw.get(1, []), raw.get(0, [])
    if len(toxic) < 4 or len(ordinary) < 4:
        total = len(toxic) + len(ordinary)
        return Model(b"", b"", np.zeros(0), np.ones(0), np.zeros(1), len(toxic) / total if total else 0.0)

    def dictionaries(t: list[bytes], o: list[bytes]) -> tuple[bytes, bytes]:
        neutral = _neutral([x for pair in zip(o, t) for x in pair] + o[len(t) :])
        return train_dictionary(t, o, neutral), train_dictionary(o, t, neutral)

    x, y = [], []
    for half in (0, 1):  # each half is calibrated with dictionaries of the other
        distance = Distance(*dictionaries(toxic[half::2], ordinary[half::2]))
        for label, docs in ((1, toxic[1 - half :: 2]), (0, ordinary[1 - half :: 2])):
            x += [distance.features(d) for d in docs]
            y += [label] * len(docs)
    x, y = np.array(x), np.array(y, dtype=float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Model(*dictionaries(toxic, ordinary), mean, scale, logistic_fit((x - mean) / scale, y))


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Model:
    """A model fitted on the bounded sample; rows whose crc remainder is ``held_out`` take no part."""
    return fit(sample(docs, labels, "toxic", modulus, held_out, PER_CLASS, MAX_CHARS))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` and ``column``, the calibrated probability that the text is toxic; one pass, no shuffle.

    A column of that name in ``docs`` is an error.
    """
    require_free(docs, column)
    schema, at = docs.withColumn(column, F.lit(0.0)).schema, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        distance = None if m.constant is not None else Distance(m.toxic, m.ordinary)
        for batch in text_slices(batches, at):
            scores = []
            for text in batch.column(at):
                if distance is None:
                    scores.append(m.constant)
                    continue
                x = (np.array(distance.features((text.as_py() or "").encode("utf-8"))) - m.mean) / m.scale
                scores.append(float(1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column]
            )

    return docs.mapInArrow(run, schema)
