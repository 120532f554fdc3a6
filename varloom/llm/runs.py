"""Periodic runs of words, by seeds that are extended along diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
and at least ``max(min_length, exponent * q)`` words, which no neighbouring word extends
keeping that period. Words stand between ASCII blanks and compare by their bytes.

A run of period q is a stretch of equal words on the diagonal of lag q, at least
``max(min_length, exponent * q) - q`` long. Lags are searched in classes ``2**c`` to
``2**(c + 1) - 1``; the least such overlap of a class, k, is the length of its seeds.
Windows of k words are named exactly: a window of ``2**j`` words by the names of its two
halves, one of k words by the two windows of ``2**j`` words that cover it, and only those
whose parts occur twice in the document go on. The positions of one window, in order,
give the seeds: neighbouring occurrences whose lag is in the class. No other pairs are
needed. k is at least q, so were a window of a run to occur again closer than q, the run
would have a smaller period (theorem of Fine and Wilf); hence each position of a run is
a seed with lag q, every seed has the smallest period, and a class has one seed a
position at most, however often a window occurs. Seeds that overlap on a diagonal are
one stretch; a stretch is extended word by word to both sides, and a table holds, per
lag, how far the stretches found so far reach, so none is extended twice.

Documents are worked through in slices of ``SLICE_BYTES`` of text, whole documents each.

A null or empty text has no words and no runs; long texts are read whole; rows with one
doc_id are rows of their own; a null doc_id comes back null. Extra columns pass through
``collapse_runs`` whatever their names and are ignored by ``periodic_runs``; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from varloom.llm.common import importable

EXPONENT, MIN_LENGTH = 4, 6
#: Text bytes that are searched together; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20

RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUN_SQL = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _repeated(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A name for the window at each of n positions, -1 where its key stands once; ``at`` are the keys' positions."""
    codes = pd.factorize(keys)[0]
    often = np.bincount(codes)[codes] > 1 if len(codes) else np.zeros(0, bool)
    names = np.full(n, -1, np.int64)
    names[at[often]] = codes[often]
    return names


def _joined(names: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of the windows made of the named one and the named one ``shift`` words on."""
    at = np.nonzero(names[: max(0, len(names) - shift)] >= 0)[0]
    second = names[at + shift]
    at, second = at[second >= 0], second[second >= 0]
    return names[at] << 32 | second, at


def _seeds(keys: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of neighbouring occurrences of a window, lags from low to high, by lag and position."""
    codes = pd.factorize(keys)[0]
    order = np.argsort(codes, kind="stable")
    codes, place = codes[order], at[order]
    lag = np.diff(place)
    good = (codes[1:] == codes[:-1]) & (lag >= low) & (lag <= high)
    place, lag = place[:-1][good], lag[good]
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def seed_classes(longest: int, exponent: int, min_length: int) -> list[tuple[int, int, int]]:
    """(least lag, greatest lag, words of a seed) of each class that documents of ``longest`` words can have.

    A seed is as long as the least overlap in its own and all later classes, so that
    seeds never get shorter from class to class.
    """
    out: list[tuple[int, int, int]] = []
    low = 1
    while max(min_length, exponent * low) <= longest:
        high = 2 * low - 1
        turn = min(high, max(low, min_length // exponent))  # the overlap falls up to here and then rises
        out.append((low, high, min(max(min_length, exponent * q) - q for q in (turn, min(high, turn + 1)))))
        low *= 2
    for i in range(len(out) - 2, -1, -1):
        out[i] = (*out[i][:2], min(out[i][2], out[i + 1][2]))
    return out


def find_runs(
    words: np.ndarray, starts: np.ndarray, exponent: int = EXPONENT, min_length: int = MIN_LENGTH
) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of every run, starts counted within the document.

    ``words`` are the word ids of documents laid end to end, ``starts`` their bounds (one more than documents).
    """
    if exponent < 3:
        raise ValueError("the exponent must be 3 or more: seeds shorter than a period miss runs")
    n = len(words)
    sizes = np.diff(starts)
    longest = int(sizes.max()) if len(sizes) else 0
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    names, span = _repeated(doc << 32 | words, np.arange(n), n), 1
    found: list[tuple[int, int, int, int]] = []
    covered: dict[int, int] = {}
    for low, high, k in seed_classes(longest, exponent, min_length):
        while 2 * span <= k:
            names, span = _repeated(*_joined(names, span), n), 2 * span
        keys, at = _joined(names, k - span)
        if not len(at):
            break
        place, lag = _seeds(keys, at, low, high)
        if len(place):
            fresh = np.concatenate(([True], (np.diff(lag) != 0) | (np.diff(place) > k)))
            first, last = place[fresh], place[np.concatenate((fresh[1:], [True]))]
            for a, b, q, d in zip(first.tolist(), (last + k).tolist(), lag[fresh].tolist(), doc[first].tolist()):
                if a < covered.get(q, 0):
                    continue
                left, right = int(starts[d]), int(starts[d + 1])
                while a > left and words[a - 1] == words[a - 1 + q]:
                    a -= 1
                while b + q < right and words[b] == words[b + q]:
                    b += 1
                covered[q] = b
                if b - a + q >= max(min_length, exponent * q):
                    found.append((d, a - left, b - a + q, q))
    return found


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repetitions of a run (all of it but its first period), joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.nonzero(keep)[0].tolist()])


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each row) of consecutive rows, about SLICE_BYTES of text together."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text.as_py() or "").encode("utf-8")
        if held and size + len(raw) > SLICE_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw.split())
        size += len(raw)
    if held:
        yield first, held


def _runs_of(docs: list[list[bytes]], exponent: int, min_length: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, by start, then period."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    starts = np.concatenate(([0], np.cumsum([len(words) for words in docs], dtype=np.int64)))
    words = np.fromiter((i for doc in docs for i in map(ids.__getitem__, doc)), np.int64, int(starts[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for d, start, length, period in find_runs(words, starts, exponent, min_length):
        out[d].append((start, length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (the text without the repetitions) of every row."""
    importable(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in _slices(batch.column(1)):
                runs = _runs_of(words, exponent, min_length)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in each] for each in runs]
                texts = [_collapse(each, r).decode("utf-8") for each, r in zip(words, runs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(words)), pa.array([len(w) for w in words], pa.int64()),
                     pa.array(rows, RUN_TYPE), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id bigint, n_words bigint, runs {RUN_SQL}, collapsed string"
    )


def collapse_runs(docs: DataFrame, exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with the repetitions of each run cut from the text, same columns; texts without runs stay as they are."""
    importable(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in _slices(batch.column(at)):
                part = batch.slice(first, len(words))
                texts = part.column(at).to_pylist()
                for i, (each, runs) in enumerate(zip(words, _runs_of(words, exponent, min_length))):
                    if runs:
                        texts[i] = _collapse(each, runs).decode("utf-8")
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
