"""Exact substring dedup with a threshold-bounded suffix index.

Every text is read as UTF-8 bytes. A byte is removed when a ``LENGTH``-byte string
covers it that also starts earlier: in a document with a smaller doc_id, or further
up in the same one. Matches never cross documents and are judged on the input.

1. Anchors. Each window of ``LENGTH`` bytes picks its leftmost smallest ``GRAM``-byte
   gram by hash. Equal windows pick equal grams at equal offsets, so they meet under
   the gram's hash; consecutive windows with one anchor form a fragment. Fragments
   that equal an earlier one within a batch are settled there (every window of them
   starts earlier), so a passage that most documents share leaves a map task once.
2. Candidates. Packed fragments meet by anchor. Equal ones are settled: all but the
   first are repeats. Anchors with different fragments go on, one fragment of each
   kind: only around the ends of a repeat, or where a short string is common.
3. Suffix index. Those fragments' bytes meet by anchor in bounded groups (an anchor
   with very many fragments is dealt on by the content of each window, which keeps
   equal windows together; a map task sends the first of each content, and of equal
   pieces that meet only the first is indexed, the others are settled). Per block of groups, the suffixes are sorted to the
   threshold, and breadth-first backward extension on the Burrows-Wheeler transform
   derives the common-prefix boundaries by increasing value and stops at ``LENGTH``:
   what is not split then shares a whole window. The first of such windows stays.
4. The runs found are cut from each text. Only documents with a repeat move again.

Null texts count as empty. Texts shorter than ``LENGTH`` bytes lose nothing; long ones
are read in blocks. Repeated rows (one doc_id, one text) are one document: neither
starts earlier, both lose the same. A null doc_id sorts before all. Extra columns pass
through ``remove_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, id_order, keep_keys, require_free, shuffle_width

LENGTH = 100
GRAM = 32
SEED = 5
#: Bytes hashed at once; positions in a block take this many bits of a gram's sort key.
_BITS = 17
BLOCK = 1 << _BITS
#: Bytes of fragments in one suffix index, and fragments of one anchor before it is dealt on.
INDEX_BYTES = 1 << 18
GROUP_FRAGMENTS = 1_000
#: Windows of dealt anchors that a task holds to settle equal ones before they are sent.
HELD_WINDOWS = 100_000
_SEPARATOR = 0xFF  # occurs in no UTF-8 text

_rng = np.random.default_rng(SEED)
_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xC2B2AE3D27D4EB4F
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(BLOCK - 1)


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, from prefix and suffix minima of blocks."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def block_fragments(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, windows, content hash) of each fragment; texts lie at starts..ends."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return np.zeros(0, np.uint64), empty, empty, np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[data] * _POWER[:n], dtype=np.uint64)))
    h = (sums[GRAM:] - sums[:-GRAM]) * _INVERSE[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    least = _window_minima(v, LENGTH - GRAM + 1)
    inside = np.zeros(len(least) + 2, bool)  # window starts within one text
    change = np.zeros(n + 2, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - LENGTH + 1, -1)
    inside[1:-1] = np.cumsum(change)[: len(least)] > 0
    anchor = least & _LOW
    new = inside[1:-1].copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[1:-2]
    first = np.nonzero(new)[0]
    stop = np.append(first[1:], len(least))
    over = np.nonzero(inside[1:-1] & ~inside[2:])[0] + 1  # ends of the texts' windows
    stop = np.minimum(stop, over[np.searchsorted(over, first, "right")]) if len(first) else stop
    content = (sums[stop + LENGTH - 1] - sums[first]) * _INVERSE[first]
    content ^= content >> np.uint64(30)
    content *= _MIX2
    return least[first] >> np.uint64(_BITS), first, stop - first, content >> np.uint64(16)


_RECORD = np.dtype([("mh", "<u8"), ("fh", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u1")])


def _batch_fragments(ids: list[int], texts: Iterable[str | None]) -> np.ndarray:
    """The fragments of all texts of a batch, as records."""
    out: list[np.ndarray] = []
    parts: list[bytes] = []
    owners: list[tuple[int, int, int, int]] = []  # doc, offset in the text, start and end in the block
    size = 0

    def flush() -> None:
        nonlocal size
        if not parts:
            return
        raw = b"".join(parts)
        own = np.array(owners, np.int64).reshape(-1, 4)
        mh, at, n, content = block_fragments(raw, own[:, 2], own[:, 3])
        record = np.zeros(len(mh), _RECORD)
        which = np.searchsorted(own[:, 2], at, "right") - 1
        record["mh"] = mh
        record["fh"] = content
        record["doc"] = own[which, 0]
        record["at"] = at - own[which, 2] + own[which, 1]
        record["n"] = n
        out.append(record)
        parts.clear()
        owners.clear()
        size = 0

    for doc, text in zip(ids, texts):
        raw = (text or "").encode("utf-8")
        at = 0
        while len(raw) - at >= LENGTH:
            if size + min(len(raw) - at, BLOCK) > BLOCK:
                flush()
            piece = raw[at : at + BLOCK]
            owners.append((doc, at, size, size + len(piece)))
            parts.append(piece)
            size += len(piece)
            if at + len(piece) >= len(raw):
                break
            at += len(piece) - LENGTH + 1  # the next block begins with the next window
    flush()
    return np.concatenate(out) if out else np.zeros(0, _RECORD)


def _pack(r: np.ndarray) -> bytes:
    """Columns one after another, each as narrow as it goes, so that shuffles compress them."""
    docs, doc = np.unique(r["doc"], return_inverse=True)
    heads = np.diff(r["mh"], prepend=np.uint64(0))  # sorted by mh
    return b"".join((
        np.array([len(r), len(docs)], "<u4").tobytes(), heads.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(),
        (r["fh"].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), docs.astype("<i8").tobytes(),
        doc.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
        r["at"].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), r["n"].tobytes(),
    ))


def _unpack(data: bytes) -> np.ndarray:
    n, m = np.frombuffer(data, "<u4", 2)
    n, m, at = int(n), int(m), 8
    raw = np.frombuffer(data, np.uint8)

    def take(k: int) -> np.ndarray:
        nonlocal at
        at += k
        return raw[at - k : at]

    out = np.zeros(n, _RECORD)
    heads = np.ascontiguousarray(take(8 * n).reshape(8, n).T).view("<u8").ravel()
    out["mh"] = np.cumsum(heads, dtype=np.uint64)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = take(6 * n).reshape(n, 6)
    out["fh"] = wide.view("<u8").ravel()
    docs = take(8 * m).copy().view("<i8")
    out["doc"] = docs[np.ascontiguousarray(take(4 * n).reshape(4, n).T).view("<u4").ravel()]
    out["at"] = np.ascontiguousarray(take(4 * n).reshape(4, n).T).view("<u4").ravel()
    out["n"] = take(n)
    return out


def _settle(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted records, whether an equal fragment stands earlier)."""
    # One key for anchor and content; should two contents of an anchor share its low bits, their
    # records may mix and count as different ones, which the suffix index then settles.
    key = (r["mh"] << np.uint64(_BITS)) | (r["fh"] & _LOW)
    r = r[np.lexsort((r["at"], r["doc"], key))]
    same = np.zeros(len(r), bool)
    same[1:] = (r["mh"][1:] == r["mh"][:-1]) & (r["fh"][1:] == r["fh"][:-1])
    # The first of each kind; records at its own place (repeated rows) are not earlier than it.
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(r)))) if len(r) else np.zeros(0, int)
    return r, (r["doc"] != r["doc"][head]) | (r["at"] != r["at"][head])


def _anchor_map(buckets: int):
    """Batches of texts to packed fragments by bucket; repeats within the batch go in bucket -1 - i."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, again = _settle(_batch_fragments(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))))
            rows: list[tuple[int, bytes]] = []
            settled = r[again]
            for i in range(0, len(settled), 1 << 15):
                rows.append((-1 - int(settled["doc"][i] % buckets), _pack(settled[i : i + (1 << 15)])))
            fresh = r[~again]
            bucket = (fresh["mh"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                if cut[b] < cut[b + 1]:
                    rows.append((b, _pack(fresh[order[cut[b] : cut[b + 1]]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())],
                names=["bucket", "payload"],
            )

    return run


_FOUND = "doc long, at long, n long, anchor long, parts long"


def _found_batch(r: np.ndarray, anchor: np.ndarray | None, parts: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(r), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(r["doc"].astype(np.int64)), pa.array(r["at"].astype(np.int64)), pa.array(r["n"].astype(np.int64)),
         none if anchor is None else pa.array(anchor.astype(np.int64)),
         none if parts is None else pa.array(parts.astype(np.int64))],
        names=["doc", "at", "n", "anchor", "parts"],
    )


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated fragments (anchor null), and first ones whose anchor has other fragments too."""
    kept = []
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            r = _unpack(payload.as_py())
            if bucket < 0:
                yield _found_batch(r, None, None)
            else:
                kept.append(r)
    if not kept:
        return
    r, again = _settle(np.concatenate(kept))
    yield _found_batch(r[again], None, None)
    first = r[~again]
    # Records at one place (repeated rows) count once.
    once = np.ones(len(first), bool)
    once[1:] = (first["mh"][1:] != first["mh"][:-1]) | (first["fh"][1:] != first["fh"][:-1])
    first = first[once]
    _, group, size = np.unique(first["mh"], return_inverse=True, return_counts=True)
    open_ = size[group] > 1
    # A dealt anchor sends each window by itself: about GROUP_FRAGMENTS windows a part.
    windows = np.bincount(group, weights=first["n"]).astype(np.int64) if len(first) else size
    parts = np.where(size > GROUP_FRAGMENTS, -(-windows // GROUP_FRAGMENTS), 1)[group][open_]
    yield _found_batch(first[open_], first["mh"][open_], parts)


def _cut_pieces(buckets: int):
    """Rows (doc, text, fragments) to the fragments' bytes, or each window's where an anchor is dealt on.

    Of such windows a task sends on the first of each content, as far as ``HELD_WINDOWS`` reach; the
    others are repeats and go in bucket -1 - i, with the number of windows in the anchor's place.
    """
    schema = ["bucket", "anchor", "doc", "at", "piece"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bytes], tuple[int, int, int]] = {}  # anchor, window: doc, at, parts
        out: list[tuple[int, int, int, int, bytes | None]] = []

        def settled(doc: int, at: int, n: int) -> None:
            out.append((-1 - doc % buckets, n, doc, at, None))

        def send() -> None:
            for (anchor, window), (doc, at, parts) in first.items():
                share = anchor + 1 + xxhash.xxh3_64_intdigest(window) % parts
                out.append((share * 2654435761 % buckets, share, doc, at, window))
            first.clear()

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row in sorted(range(len(ids)), key=ids.__getitem__):  # so that few firsts are replaced
                doc = ids[row]
                raw = (batch.column(1)[row].as_py() or "").encode("utf-8")
                for f in sorted(batch.column(2)[row].as_py(), key=lambda f: f["at"]):
                    at, n, anchor = f["at"], f["n"], f["anchor"]
                    if f["parts"] == 1:
                        out.append((anchor % buckets, anchor, doc, at, raw[at : at + n + LENGTH - 1]))
                        continue
                    again = 0
                    for i in range(at, min(at + n, len(raw) - LENGTH + 1)):
                        key = (anchor, raw[i : i + LENGTH])
                        held = first.setdefault(key, (doc, i, f["parts"]))
                        if held[:2] < (doc, i):
                            again += 1
                            continue
                        if held[:2] > (doc, i):
                            settled(*held[:2], 1)
                            first[key] = (doc, i, f["parts"])
                        if again:
                            settled(doc, i - again, again)
                            again = 0
                    if again:
                        settled(doc, min(at + n, len(raw) - LENGTH + 1) - again, again)
                if len(first) >= HELD_WINDOWS:
                    send()
                if len(out) >= 20_000:
                    yield _pieces_batch(out, schema)
                    out.clear()
        send()
        yield _pieces_batch(out, schema)

    return run


def _pieces_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def first_bytes(text: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each suffix as one integer."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    return key


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffixes' order by their first 128 bytes, by prefix doubling from 8-byte words."""
    n = len(text)
    rank = first_bytes(text)
    order = np.argsort(rank)
    step = 8
    while True:
        ordered = rank[order]
        number = np.zeros(n, np.int64)
        number[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if step >= 128 or number.max(initial=0) == n - 1:
            return order
        later = np.full(n, -1, np.int64)
        later[: n - step] = number[step:] if step < n else number[:0]
        rank = (number.astype(np.uint64) << np.uint64(32)) | (later + 1).astype(np.uint64)
        order = np.argsort(rank)
        step *= 2


def prefix_groups(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, group of each place in it): equal groups share their first ``depth`` bytes.

    Breadth-first backward extension: the interval of a string w in the order is
    extended by each byte c before it, through the Burrows-Wheeler transform, to the
    interval of cw. Strings are handled by length, so a boundary between suffixes is
    found first at the length of their common prefix; an interval whose end is known
    already is not followed. Boundaries of ``depth`` or more are never derived. The
    search starts where it stands after the lengths 0 to 7, which the sort keys show.
    Groups that hold the separator within their first bytes may stay unsplit.
    """
    n = len(text)
    order = sorted_suffixes(text)
    before = text[order - 1].astype(np.int64)  # the transform; before the first suffix stands the last byte
    by_byte = np.argsort(before, kind="stable")
    target = np.empty(n, np.int64)
    target[by_byte] = np.arange(n)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    previous[by_byte[1:][same]] = by_byte[:-1][same]

    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    key = first_bytes(text)[order]
    bound[1:-1] = key[1:] != key[:-1]
    edges = np.nonzero(bound)[0]
    fresh = key[edges[1:-1] - 1] >> np.uint64(8) == key[edges[1:-1]] >> np.uint64(8)  # a common prefix of 7
    low, high = edges[:-2][fresh], edges[1:-1][fresh]
    for _ in range(8, depth):
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)
        byte = before[place]
        last = (following[place] >= np.repeat(high, size)) & (byte != _SEPARATOR)
        first = (previous[place] < np.repeat(low, size)) & (byte != _SEPARATOR)

        def ends(mask: np.ndarray) -> np.ndarray:
            # By string and byte; each pair occurs once, so any sort will do.
            return target[place[mask][np.argsort((which[mask] << 8) | byte[mask])]]

        left, right = ends(first), ends(last) + 1
        new = ~bound[right]
        low, high = left[new], right[new]
        bound[high] = True
        if not len(low):
            break
    return order, np.cumsum(bound[:-1]) - 1


def repeated_windows(pieces: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """Runs (doc, first, windows) of the windows that also start earlier in these (doc, at, bytes) pieces."""
    size = np.array([len(p) for _, _, p in pieces])
    text = np.frombuffer(b"".join(p + b"\xff" for _, _, p in pieces), np.uint8)
    begin = np.cumsum(size + 1) - (size + 1)
    order, group = prefix_groups(text)
    owner = np.searchsorted(begin, order, "right") - 1
    offset = order - begin[owner]
    whole = offset + LENGTH <= size[owner]
    order, group, owner, offset = order[whole], group[whole], owner[whole], offset[whole]
    doc = np.array([d for d, _, _ in pieces], np.int64)[owner]
    at = np.array([a for _, a, _ in pieces], np.int64)[owner] + offset
    by = np.lexsort((at, doc, group))
    group, doc, at = group[by], doc[by], at[by]
    if not len(group):
        return []
    new = np.concatenate(([True], group[1:] != group[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    again = (doc != doc[head]) | (at != at[head])
    doc, at = doc[again], at[again]
    by = np.lexsort((at, doc))
    doc, at = doc[by], at[by]
    if not len(doc):
        return []
    start = np.nonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))))[0]
    stop = np.append(start[1:], len(doc)) - 1
    return [(int(doc[a]), int(at[a]), int(at[b] - at[a] + 1)) for a, b in zip(start, stop)]


def _index_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor, doc and at to runs of repeated windows; whole anchors, about INDEX_BYTES at a time.

    Of equal pieces of an anchor only the first is indexed, so what is held follows the different ones.
    """
    held: list[tuple[int, int, bytes]] = []
    first: dict[bytes, tuple[int, int]] = {}  # of the anchor at hand
    settled: list[tuple[int, int, int]] = []
    size, last = 0, None

    def runs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "at", "n"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for bucket, anchor, doc, at, piece in zip(*columns, batch.column(4)):
            if bucket < 0:
                settled.append((doc, at, anchor))
                continue
            raw = piece.as_py()
            if len(raw) < LENGTH:
                continue
            if anchor != last:
                first.clear()
                if size >= INDEX_BYTES:
                    yield runs(repeated_windows(held))
                    held.clear()
                    size = 0
            last = anchor
            place = first.get(raw)
            if place is None:
                first[raw] = (doc, at)
                held.append((doc, at, raw))
                size += len(raw)
            elif place != (doc, at):
                settled.append((doc, at, len(raw) - LENGTH + 1))
        if len(settled) >= 20_000:
            yield runs(settled)
            settled.clear()
    if held:
        yield runs(repeated_windows(held))
    yield runs(settled)


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, at, n: runs of window starts whose windows also start earlier (they may overlap)."""
    width = shuffle_width(docs.sparkSession)
    buckets = 4 * width
    texts = docs.select(id_order("doc_id").alias("doc"), "text")
    packed = texts.mapInArrow(_anchor_map(buckets), "bucket long, payload binary")
    found = scratch.stage(packed.repartition(width, "bucket").mapInArrow(_resolve, _FOUND), "found")

    open_ = found.filter(F.col("anchor").isNotNull())
    owners = scratch.stage(open_.select("doc").distinct(), "owners")
    asked = open_.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "anchor", "parts")).alias("asked"))
    wanted = keep_keys(texts, owners, "doc").join(asked, "doc").select("doc", "text", "asked")
    pieces = wanted.mapInArrow(
        _cut_pieces(1 << 20), "bucket long, anchor long, doc long, at long, piece binary"
    )
    by_anchor = pieces.repartition(width, "bucket").sortWithinPartitions("anchor", "doc", "at")
    verified = scratch.stage(by_anchor.mapInArrow(_index_pieces, "doc long, at long, n long"), "verified")
    return found.filter(F.col("anchor").isNull()).select("doc", "at", "n").unionByName(verified)


def _merged(runs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Byte spans (start, end) that the windows of all runs cover."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(runs):
        a, b = at, min(size, at + n + LENGTH - 1)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` and kept (remaining bytes), n_bytes, n_removed, n_spans; a column of these names is an error."""
    require_free(docs, "kept", "n_bytes", "n_removed", "n_spans", "__doc", "__runs")
    scratch = Scratch(docs.sparkSession, "substrings")
    runs = repeated_runs(docs, scratch)
    by_doc = scratch.stage(
        runs.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("__runs")).withColumnRenamed("doc", "__doc"),
        "runs",
    )
    scratch.drop("found", "verified", "owners")
    rows = docs.withColumn("__doc", id_order("doc_id"))
    touched = by_doc.select("__doc")
    kind = by_doc.schema["__runs"].dataType
    if by_doc.count() * 16 <= 32 << 20:  # the others stay where they are
        touched = F.broadcast(touched)
        clean = rows.join(touched, "__doc", "left_anti").withColumn("__runs", F.lit(None).cast(kind))
        both = rows.join(touched, "__doc", "left_semi").join(by_doc, "__doc").select(*clean.columns).unionByName(clean)
    else:
        both = rows.join(by_doc, "__doc", "left")
    both = both.select(*docs.columns, "__runs")
    extra = "kept binary, n_bytes long, n_removed long, n_spans long"
    schema = docs.limit(0).select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in extra.split(", ")]).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, removed, spans = [], [], [], []
            text_at, runs_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("__runs")
            for text, found in zip(batch.column(text_at), batch.column(runs_at)):
                raw = (text.as_py() or "").encode("utf-8")
                cut = _merged([(r["at"], r["n"]) for r in found.as_py() or []], len(raw))
                at, left = 0, []
                for a, b in cut:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                kept.append(b"".join(left))
                size.append(len(raw))
                removed.append(sum(b - a for a, b in cut))
                spans.append(len(cut))
            columns = [batch.column(i) for i in range(batch.num_columns) if i != runs_at]
            new = [pa.array(kept, pa.binary())] + [pa.array(c, pa.int64()) for c in (size, removed, spans)]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=schema.names)

    return both.mapInArrow(run, schema)


def kept_digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
