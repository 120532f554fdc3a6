"""Benchmark decontamination with a generalised suffix automaton.

Texts are normalised to words: A-Z lower-cased, then runs of digits, a-z and
non-ASCII characters. A window is ``WINDOW`` consecutive words of an item; an item
with fewer words, but some, is one window. The automaton over the items' words reads
each document word by word and keeps the longest match that ends there; where it
reaches a window's length, the window occurs and its words are hit.

The items are cut into blocks of ``BLOCK_WORDS`` words at most (a longer item alone
makes a block). The items are streamed through the driver, each block's automaton is
built there once and sent to the tasks; a task holds the automata of all blocks (about
200 bytes a word), reads each document once and merges its hits of all blocks. Finding
and cutting are one map: texts pass through one Python worker a task, in slices of
bounded size.

Null or empty texts and items have no words, no hit and no window; long texts are
read whole; repeated items count as items of their own; repeated documents are each
judged. A null item_id counts as an item and is listed as ``null``. Extra columns of
the documents pass through; a benchmark without words hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from varloom.llm.common import importable, text_slices

WINDOW = 10
#: Words of benchmark text in one automaton; about 200 bytes a word in each Python worker.
BLOCK_WORDS = 200_000
#: Limits of the cleaning step: spans of at least this many words go (1: every hit span,
#: also that of an item shorter than a window), and a document with at least this share
#: of its words in such spans goes as a whole.
MIN_SPAN = 1
MAX_COVERAGE = 0.5

_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words; on UTF-8 bytes, since ASCII bytes never occur inside other characters."""
    return (text or "").encode("utf-8").translate(_WORD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, marked with the windows of each item."""

    def __init__(self, items: Sequence[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for i, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shortest = min((min(len(s), window) for _, s in coded), default=0)
        # windows[state]: {length: items}; a state stands for strings of several lengths.
        self.windows: dict[int, dict[int, set]] = {}
        for item, seq in coded:
            n = min(window, len(seq))
            for _, state, length in self._read(seq, n):
                if length == n:
                    self.windows.setdefault(state, {}).setdefault(n, set()).add(item)
        # The nearest state on the suffix links, itself included, that holds a window.
        self.holder = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.size.__getitem__):
            self.holder[s] = s if s in self.windows else self.holder[self.link[s]] if s else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._split(last, q, c)
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _read(self, seq: Iterable[int], most: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each position, ``most`` words at most."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        for i, c in enumerate(seq):
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
                if length > most:
                    length = most
                while size[link[state]] >= length > 0:
                    state = link[state]
            else:
                length = 0
            yield i, state, length

    def matches(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans (start, end) in words, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, found
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        # Only runs of benchmark words that are long enough can hold a window.
        edge = np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0])))
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        for a, b in zip(starts, ends):
            if b - a < self.shortest:
                continue
            for i, state, length in self._read(ids[a:b].tolist(), self.window):
                holder = self.holder[state]
                while holder >= 0:
                    for n, items in self.windows[holder].items():
                        if n <= length:
                            found |= items
                            end = int(a) + i + 1
                            while spans and end - n <= spans[-1][1] and spans[-1][0] >= end - n:
                                spans.pop()
                            if spans and end - n <= spans[-1][1]:
                                spans[-1] = (spans[-1][0], max(spans[-1][1], end))
                            else:
                                spans.append((end - n, end))
                    holder = self.holder[self.link[holder]] if holder else -1
        return spans, found


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of (item_id, words), streamed: the driver holds one block at a time."""
    block, n = [], 0
    rows = benchmark.select("item_id", "text").toLocalIterator()
    for row in rows:
        words = words_of(row["text"])
        if not words:
            continue
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((row["item_id"], words))
        n += len(words)
    if block:
        yield block


def _automata(benchmark: DataFrame, window: int, block_words: int) -> list[Broadcast]:
    """One broadcast automaton a block of items, built one after the other."""
    spark = benchmark.sparkSession
    importable(spark)
    return [spark.sparkContext.broadcast(SuffixAutomaton(block, window)) for block in _blocks(benchmark, block_words)]


def _hits(text: str | None, automata: list[Broadcast]) -> dict:
    """The merged hit spans of a text (in words) and the item ids whose windows occur, over all blocks."""
    words = words_of(text)
    spans, items = [], set()
    for automaton in automata:
        own, found = automaton.value.matches(words)
        spans += own
        items |= {"null" if i is None else str(i) for i in found}
    spans = merge_spans(spans)
    return {
        "n_words": len(words), "starts": [a for a, _ in spans], "ends": [b for _, b in spans], "items": sorted(items),
    }


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, column: str = "hits"
) -> DataFrame:
    """Every column of ``docs`` and ``column``: struct(n_words, starts, ends, items).

    starts and ends are the merged hit spans in words, items the item ids (as
    strings, each once) whose windows occur. The documents are read once, in one map
    without a shuffle. A column of that name in ``docs`` is an error.
    """
    if "text" not in docs.columns:
        raise ValueError("documents need a text column")
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {column!r} already: name another")
    hits_type = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"
    schema = docs.select("*", F.lit(None).cast(hits_type).alias(column)).schema
    at, arrow_type = docs.columns.index("text"), to_arrow_type(schema[-1].dataType)
    automata = _automata(benchmark, window, block_words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            hits = pa.array([_hits(text.as_py(), automata) for text in batch.column(at)], arrow_type)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.coalesce(
        F.aggregate(F.zip_with("hits.starts", "hits.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x),
        F.lit(0).cast("long"),
    )
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("hits.items", ","), "UTF-8"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _word_bounds(raw: bytes) -> list[tuple[int, int]]:
    """Byte bounds of each word in the UTF-8 text."""
    is_word = np.frombuffer(raw.translate(_WORD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))


def _cut(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the spans of words (in words); what separates them stays once."""
    raw = text.encode("utf-8")
    bounds = _word_bounds(raw)
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(raw[at : bounds[a][0]])
        at = bounds[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE
) -> DataFrame:
    """``docs`` without benchmark passages, same columns.

    Hit spans of ``min_span`` words or more are cut from the text; a document with
    ``max_coverage`` of its words in such spans is dropped; all others stay, n_chars
    following a changed text. Documents without a hit are returned unchanged.
    """
    automata = _automata(benchmark, WINDOW, BLOCK_WORDS)
    at = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at["text"]):
            keep, changed = [], {}
            for i, text in enumerate(batch.column(at["text"])):
                text = text.as_py()
                h = _hits(text, automata)
                spans = [(a, b) for a, b in zip(h["starts"], h["ends"]) if b - a >= min_span]
                if spans and sum(b - a for a, b in spans) >= max_coverage * h["n_words"]:
                    continue
                if spans:
                    changed[len(keep)] = _cut(text, [a for a, _ in spans], [b for _, b in spans])
                keep.append(i)
            kept = batch.take(pa.array(keep, pa.int64()))
            arrays = list(kept.columns)
            for name, values in (("text", changed), ("n_chars", {i: len(t) for i, t in changed.items()})):
                if changed and name in at:
                    old = arrays[at[name]]
                    arrays[at[name]] = pa.array([values.get(i, v) for i, v in enumerate(old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
