"""MinHash near-duplicate detection.

A document's set holds its distinct word shingles (runs of ``width`` words, A-Z
lower-cased, words between ASCII blanks; with fewer words the whole sequence is one
shingle). Documents with equal sets form a class; one member stands for it. Each set
gets ``BANDS * ROWS`` minima of universal hash functions; representatives that agree
on all ``ROWS`` minima of a band share a bucket. A pair in a bucket is checked on its
signatures, then confirmed on the full sets: intersection / union >= ``percent``/100.

A bucket is worked through in two steps. First, each bucket names one hub, the member that
shares the most bucket places with others (a central one; hardly differing buckets name
the same), and every member is compared with it: first the signatures, then, of pairs they
do not rule out, the full sets. Components are taken from these links. Then only buckets
whose other members are in several components go on: these are cut into cells by
component (the hub's, or another) and distance to the hub, large cells into chunks of
``CHUNK`` members, and chunks meet in pairs, except two of the hub's component and those
whose distances to the hub differ by more than a link can (Jaccard distance is a metric).
A task compares the signatures of two chunks as one matrix. What agrees enough goes on to the
full sets: as pairs where there are no more of them than members, else the two chunks as a
whole, whose intersections are one matrix product that returns a forest of the links between
different components, never the pairs. So every two members of a
bucket are linked by a path, compared or excluded, and what moves is linear in the
members but for the chunks of a bucket that stays mixed, which meet pairwise.
A pair at exactly 0.8 shares no bucket with a chance of 5e-6.

Null or empty texts have the empty set, link with nothing and are their own
component; long texts are read whole. Rows with one doc_id are one document whose
texts all count. A null doc_id sorts first and comes back null. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import NARROW_ROWS, Scratch, hinted, id_order, keep_keys, text_slices, unused
from varloom.llm.components import connected_components

ROWS, BANDS = 6, 40
SEED = 11
#: Signatures that agree on less than the limit by this many standard errors are rejected.
SIGNATURE_MARGIN = 6.0
#: Members of a bucket that are compared as one matrix, and bytes of their sets.
CHUNK, CHUNK_BYTES = 128, 1 << 20
#: Chunk pairs that a Python worker takes at a time.
CHUNK_ROWS = 32
#: Width of a cell's distances to the hub, in hundredths.
CELL = 5
NO_ID = -(2**63)

_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BAND_SEED = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A word's hash is a polynomial in random codes of its bytes; powers reach over one block of text.
_BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 2**64), _BLOCK)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (bytes between ASCII blanks), in order."""
    out = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _BLOCK)
        while end < len(raw) and end > at and not _BLANK[raw[end - 1]]:
            end -= 1
        if end == at:  # one word longer than a block
            end = at + _BLOCK
            while end < len(raw) and not _BLANK[raw[end]]:
                end += 1
        block = np.frombuffer(raw, np.uint8, end - at, at)
        edge = np.diff(np.concatenate(([0], (~_BLANK[block]).view(np.int8), [0])))
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        power, inverse = (
            (_POWER, _INVERSE) if len(block) <= _BLOCK
            else (_powers(_BASE, len(block)), _powers(pow(_BASE, -1, 2**64), len(block)))
        )
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_CODE[block] * power[: len(block)], dtype=np.uint64)))
        h = (sums[ends] - sums[starts]) * inverse[starts]
        h ^= h >> np.uint64(32)
        out.append(h * _MIX)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles."""
    h = word_hashes((text or "").encode("utf-8").lower())
    if not len(h):
        return h
    w = min(width, len(h))
    n = len(h) - w + 1
    codes = np.full(n, w, np.uint64)
    for i in range(w):
        codes = (codes ^ h[i : i + n]) * _MIX
        codes ^= codes >> np.uint64(29)
    return np.unique(codes)


def signature(codes: np.ndarray) -> np.ndarray:
    """Minima of the universal hash functions a * x + b modulo 2**32, x the set's hashes."""
    x = (codes >> np.uint64(32)).astype(np.uint32)
    out = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 4096):
        block = _A[:, None] * x[None, i : i + 4096]
        block += _B[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    keys = _BAND_SEED.copy()
    for column in minima.reshape(BANDS, ROWS).T:
        keys = (keys ^ column.astype(np.uint64)) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _sketch(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            n, keys, bands, signatures = [], [], [], []
            for text in batch.column(1):
                codes = shingle_set(text.as_py(), width)
                n.append(len(codes))
                keys.append(xxhash.xxh128_digest(codes.tobytes()))
                minima = signature(codes) if len(codes) else None
                bands.append(band_keys(minima) if len(codes) else None)
                signatures.append((minima % np.uint32(251)).astype(np.uint8).tobytes() if len(codes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["id", "n", "set_key", "bands", "signature"],
            )

    return run


def _codes(width: int):
    """set_key, n and the set itself (codes, 8 bytes a shingle)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            raw = [shingle_set(text.as_py(), width).tobytes() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                names=["set_key", "codes"],
            )

    return run


def _least(percent: int) -> float:
    """Agreeing minima under which a signature rules a link out."""
    m, limit = ROWS * BANDS, percent / 100
    return (limit - SIGNATURE_MARGIN * np.sqrt(limit * (1 - limit) / m)) * m


def _agreeing(percent: int):
    """The pairs whose signatures do not rule a link out."""
    least = _least(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (_matrix(batch.column(batch.schema.get_field_index(c))) for c in ("hub_signature", "signature"))
            keep = np.nonzero((one == two).sum(axis=1) >= least)[0]
            yield batch.take(pa.array(keep)).select(["hub", "hub_rep", "set_key", "rep"])

    return run


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(len(signatures), ROWS * BANDS)


def _confirm(percent: int):
    """hub, set_key, the ids of both, linked, distance of each pair, from the full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, distance = [], []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("hub_codes", "codes")]
            for one, two in zip(*columns):
                one, two = (np.frombuffer(c.as_py(), np.uint64) for c in (one, two))
                common = len(np.intersect1d(one, two, assume_unique=True))
                union = len(one) + len(two) - common
                linked.append(100 * common >= percent * union)
                distance.append(1 - common / union)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["hub", "hub_rep", "set_key", "rep"]).columns, pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())],
                names=["hub", "hub_rep", "set_key", "rep", "linked", "distance"],
            )

    return run


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many codes each set of ``one`` has in common with each of ``two`` (sorted, distinct codes)."""
    shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
    out = np.zeros((len(one), len(two)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(c) for c in sets])
        codes = np.concatenate(sets)
        at = np.searchsorted(shared, codes)
        at[at == len(shared)] = 0
        known = shared[at] == codes
        return owner[known], at[known]

    if not len(shared):
        return out.astype(np.int64)
    sides = places(one), places(two)
    for low in range(0, len(shared), 8192):
        dense = []
        for (owner, at), sets in zip(sides, (one, two)):
            inside = (at >= low) & (at < low + 8192)
            x = np.zeros((len(sets), min(8192, len(shared) - low)), np.float32)
            x[owner[inside], at[inside] - low] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def may_link(one: dict, two: dict, percent: int) -> np.ndarray:
    """Which members of two chunks are in different components and have signatures that do not rule a link out."""
    agree = np.stack([(two["signature"] == s).sum(axis=1) for s in one["signature"]]) >= _least(percent)
    return agree & (one["component"][:, None] != two["component"][None, :])


def chunk_links(one: dict, two: dict, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components of two chunks, as a forest; exact.

    A chunk has the arrays rep, component and signature, and codes (a list of sets).
    """
    agree = may_link(one, two, percent)
    rows, columns = np.nonzero(agree.any(axis=1))[0], np.nonzero(agree.any(axis=0))[0]
    if not len(rows):
        return []
    left, right = [one["codes"][i] for i in rows], [two["codes"][j] for j in columns]
    common = intersections(left, right)
    sizes = np.array([len(c) for c in left])[:, None] + np.array([len(c) for c in right])[None, :]
    linked = (100 * common >= percent * (sizes - common)) & agree[np.ix_(rows, columns)]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for i, j in np.argwhere(linked):
        u, v = rows[i], columns[j]
        a, b = find(int(one["component"][u])), find(int(two["component"][v]))
        if a != b:
            root[a] = b
            out.append((int(one["rep"][u]), int(two["rep"][v])))
    return out


def _chunk(members: pa.ListScalar) -> dict:
    """A chunk's members as arrays; the sets where they are there."""
    members = members.values
    field = lambda name: members.field(members.type.get_field_index(name))
    out = {"rep": field("rep").to_numpy(), "component": field("component").to_numpy(), "signature": _matrix(field("signature"))}
    if members.type.get_field_index("codes") >= 0:
        out["codes"] = [np.frombuffer(c.as_py(), np.uint64) for c in field("codes")]
    if members.type.get_field_index("set_key") >= 0:
        out["set_key"] = field("set_key").to_pylist()
    return out


def _meeting_chunks(percent: int):
    """What may be a new link by the signatures of two chunks: the pairs, if there are no more of them than members.

    Otherwise (near copies that do not link) the two chunks' names alone, to be compared as matrices.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("name", "name2", "list", "list2"))):
                one, two = _chunk(row[2]), _chunk(row[3])
                pairs = np.argwhere(may_link(one, two, percent))
                if len(pairs) > len(one["rep"]) + len(two["rep"]):
                    rows.append((row[0].as_py(), row[1].as_py(), None, None, None, None))
                    continue
                for i, j in pairs:
                    ends = sorted(((one["set_key"][i], int(one["rep"][i])), (two["set_key"][j], int(two["rep"][j]))))
                    rows.append((None, None, *ends[0], *ends[1]))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["name", "name2", "hub", "hub_rep", "set_key", "rep"]
            )

    return run


def _compare_chunks(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for one, two in zip(batch.column(0), batch.column(1)):
                links += chunk_links(_chunk(one), _chunk(two), percent)
            u, v = ([link[i] for link in links] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _hub_links(members: DataFrame, signs: DataFrame, known: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """hub, hub_rep, set_key, rep, linked, distance of every member that its bucket's hub's signature does not rule out."""
    small, large = F.least("n", "hub_n"), F.greatest("n", "hub_n")
    pairs = (
        members.filter((F.col("set_key") != F.col("hub")) & (100 * small >= percent * large))
        .select("hub", "hub_rep", "set_key", "rep").distinct()
    )
    hub_signs = signs.select(F.col("set_key").alias("hub"), F.col("signature").alias("hub_signature"))
    agreeing = pairs.join(signs, "set_key").join(hub_signs, "hub").mapInArrow(_agreeing(percent), PAIR)
    return _confirmed(scratch.stage(agreeing, "agreeing"), known, percent)


PAIR = "hub binary, hub_rep long, set_key binary, rep long"


def _confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a written table) with linked and distance, by the full sets; sets of no pair do not move."""
    n = pairs.count()
    sides = [pairs.select(F.col(c).alias("set_key")).distinct() for c in ("set_key", "hub")]
    # Few pairs go to where the sets are.
    codes = known if n <= NARROW_ROWS else keep_keys(known, sides[0], "set_key")
    hub_codes = keep_keys(known, sides[1], "set_key").select(F.col("set_key").alias("hub"), F.col("codes").alias("hub_codes"))
    return hinted(pairs, n).join(codes, "set_key").join(hub_codes, "hub").mapInArrow(
        _confirm(percent), f"{PAIR}, linked boolean, distance double"
    )


def _chunk_links(open_: DataFrame, signs: DataFrame, known: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """u, v: links between members of different components in the buckets that are still mixed."""
    spark = open_.sparkSession
    cell = ["key", "main", "near"]
    sizes = open_.groupBy(*cell).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    parts = F.ceil(F.greatest(F.col("members") / CHUNK, 8 * F.col("total") / CHUNK_BYTES))
    dealt = open_.join(sizes.select(*cell, parts.alias("parts")), cell)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("set_key"), F.col("parts")))
    chunks = dealt.join(signs, "set_key").groupBy(*cell, "chunk").agg(
        F.collect_list(F.struct("set_key", "rep", "component", "signature")).alias("list")
    )
    chunks = scratch.stage(chunks.withColumn("name", F.xxhash64(*cell, "chunk", F.lit(SEED))), "chunks")
    places = chunks.select("key", "main", "near", "name")
    other = places.select("key", *[F.col(c).alias(f"{c}2") for c in ("main", "near", "name")])
    # Cells of ``CELL`` hundredths: these many cells apart, the distances differ by over (100 - percent) / 100.
    apart = -(-(100 - percent) // CELL) + 2
    meet = (F.col("name") <= F.col("name2")) & ~(F.col("main") & F.col("main2")) & (
        (F.col("near") < 0) | (F.col("near2") < 0) | (F.abs(F.col("near") - F.col("near2")) < apart)
    )

    def paired(pairs: DataFrame, lists: DataFrame) -> DataFrame:
        return pairs.join(lists, "name").join(lists.select(F.col("name").alias("name2"), F.col("list").alias("list2")), "name2")

    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(CHUNK_ROWS))  # a row holds two chunks
    try:
        pairs = paired(places.join(other, "key").filter(meet).select("name", "name2"), chunks.select("name", "list"))
        meeting = scratch.stage(pairs.mapInArrow(_meeting_chunks(percent), f"name long, name2 long, {PAIR}"), "meeting")
        # Sets move for what may be a new link only.
        few = meeting.filter(F.col("name").isNull()).select("hub", "hub_rep", "set_key", "rep").distinct()
        linked = _confirmed(few, known, percent).filter("linked").select(F.col("hub_rep").alias("u"), F.col("rep").alias("v"))
        linked = scratch.stage(linked, "few_links")
        meeting = meeting.filter(F.col("name").isNotNull()).select("name", "name2")
        if meeting.isEmpty():
            return linked
        names = meeting.select("name").union(meeting.select(F.col("name2").alias("name"))).distinct()
        asked = chunks.join(names, "name", "left_semi").select("name", F.explode("list").alias("m")).select("name", "m.*")
        sets = keep_keys(known, asked.select("set_key").distinct(), "set_key")
        full = asked.join(sets, "set_key").groupBy("name").agg(
            F.collect_list(F.struct("rep", "component", "signature", "codes")).alias("list")
        )
        both = paired(meeting, scratch.stage(full, "chunk_sets")).select("list", "list2")
        return linked.unionByName(scratch.stage(both.mapInArrow(_compare_chunks(percent), "u long, v long"), "chunk_links"))
    finally:
        spark.conf.set(batch, before)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is its own)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(id_order("doc_id").alias("id"), "text")
    sketches = scratch.stage(
        texts.mapInArrow(_sketch(width), "id long, n long, set_key binary, bands array<long>, signature binary"),
        "sketches",
    )
    sizes = scratch.stage(sketches.select("id", "n", "set_key"), "sizes")
    some = sizes.filter("n > 0")
    classes = scratch.stage(some.groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("set_key").alias("rep_key"), "rep")
    first = sketches.filter("n > 0").join(reps, (F.col("set_key") == F.col("rep_key")) & (F.col("id") == F.col("rep")), "left_semi")
    first = scratch.stage(first, "first")
    scratch.drop("sketches")

    # Buckets of two different sets or more, and their members. A row a band: a set goes by a hash of its key alone;
    # what it is, only the members of these buckets are told. Sets of one hash would be members of each other's buckets.
    h = F.xxhash64("set_key")
    named = first.select(h.alias("h"), "set_key", F.col("id").alias("rep"), "n").distinct()
    banded = first.select(h.alias("h"), F.explode("bands").alias("key"))
    h = F.col("h")
    content = ["lo", "hi", "size", "low_sum", "high_sum"]
    shared = banded.groupBy("key").agg(
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("size"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low_sum"), F.sum(F.shiftrightunsigned(h, 32)).alias("high_sum"),
    )
    # Near copies meet in many bands: of the buckets with the same members one is worked through.
    shared = shared.filter("lo < hi").groupBy(*content).agg(F.min("key").alias("key"), F.count("*").alias("times"))
    shared = scratch.stage(shared.select("key", (F.col("size") * F.col("times")).alias("size")), "shared")
    places = keep_keys(banded, shared.select("key"), "key").join(shared, "key")
    members = scratch.stage(places.join(named, "h").drop("h").distinct(), "members")
    score = members.groupBy("set_key").agg(F.sum("size").alias("score"))
    hubs = members.join(score, "set_key").groupBy("key").agg(F.max(F.struct("score", "set_key", "rep", "n")).alias("hub"))
    placed = members.drop("size").join(
        hubs.select("key", F.col("hub.set_key").alias("hub"), F.col("hub.rep").alias("hub_rep"), F.col("hub.n").alias("hub_n")), "key"
    )
    placed = scratch.stage(placed, "placed")

    # Signatures and sets of the members; those of other documents do not move.
    ids = scratch.stage(members.select(F.col("rep").alias("id")).distinct(), "ids")
    asked = scratch.stage(members.select("set_key").distinct(), "asked")
    signs = scratch.stage(keep_keys(first, ids, "id").select("set_key", "signature").distinct().join(asked, "set_key", "left_semi"), "signs")
    read = keep_keys(texts, ids, "id").select("text").mapInArrow(_codes(width), "set_key binary, codes binary")
    known = scratch.stage(read.join(asked, "set_key", "left_semi").distinct(), "known")

    # Rows with one doc_id are one document: its classes are linked through the id.
    several = some.groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo < hi")
    same_id = some.join(several, "id", "left_semi").join(classes, "set_key").select(
        F.col("id").alias("u"), F.col("rep").alias("v")
    )

    found = scratch.stage(_hub_links(placed, signs, known, percent, scratch), "found")
    edges = found.filter("linked").select(F.col("hub_rep").alias("u"), F.col("rep").alias("v")).unionByName(same_id)
    edges = scratch.stage(edges, "edges")
    links = connected_components(edges, scratch, "links_0")

    # Buckets whose members are not all in one component yet.
    roots = links.select(F.col("node").alias("rep"), "component")
    with_roots = placed.join(roots, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    hub_roots = links.select(F.col("node").alias("hub_rep"), F.col("component").alias("hub_component"))
    with_roots = with_roots.join(hub_roots, "hub_rep", "left").withColumn("hub_component", F.coalesce("hub_component", "hub_rep"))
    near = F.coalesce(F.floor(F.col("distance") * 100 / CELL).cast("int"), F.lit(-1))
    # The hub has met every member; what is left is the others among themselves.
    rest = with_roots.filter(F.col("set_key") != F.col("hub"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    open_ = (
        rest.join(mixed.select("key"), "key", "left_semi")
        .join(found.select("hub", "set_key", "distance"), ["hub", "set_key"], "left")
        .select("key", "set_key", "rep", "n", "component", (F.col("component") == F.col("hub_component")).alias("main"), near.alias("near"))
    )
    open_ = scratch.stage(open_, "open")
    if not open_.isEmpty():
        more = _chunk_links(open_, signs, known, percent, scratch)
        links = connected_components(edges.unionByName(more), scratch, "links_1")
    n_links = links.count()
    scratch.drop("first", "shared", "members", "placed", "ids", "asked", "signs", "known", "agreeing", "found", "open", "chunks", "meeting", "chunk_sets")

    roots = hinted(links.select(F.col("node").alias("rep"), "component"), n_links)
    return (
        sizes.join(classes, "set_key", "left")
        .join(roots, "rep", "left")
        .withColumn("root", F.coalesce("component", "rep", "id"))
        .select(
            F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
            F.nullif("root", F.lit(NO_ID)).alias("component_id"), (F.col("id") == F.col("root")).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; same columns."""
    scratch = Scratch(docs.sparkSession, "minhash_kept")
    gone_id = unused(docs, "gone_id")
    gone = near_duplicates(docs, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id))
    gone = scratch.stage(gone.distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
