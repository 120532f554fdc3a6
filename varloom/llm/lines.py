"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line of ``MIN_CHARS`` characters or more is removed when an equal line, or one within
``max_edits`` edits (insertions, deletions, substitutions of characters), occurs
earlier: in a document with a smaller doc_id, or further up in the same one. Lines are
judged on the input, not on what is left. Shorter lines always stay.

Join: equal lines are first grouped (map-side minima), so each distinct line is one
row, named by its first place. Two lines within ``max_edits`` edits, the longer one
probing: of the shorter line's ``max_edits + 1`` even segments, one at least occurs
unchanged in the longer one, near its own place. Each line is indexed under its
segments' (line length, segment number, content) and probes, for each shorter or equal
length in reach, only the substrings that the multi-match rule leaves; an equi join
gives the pairs. A segment that very many lines share (more than ``HEAVY`` pairs) is not
paired: its lines meet under longer keys, all of the line but one of ``DEEP_PARTS``
segments, which lines one edit apart share too, so that only lines which differ in that
one segment meet. Where these crowd as well (lines of one template), the segment is keyed
once for each of its places, without the character there: only lines one edit apart meet
(for ``max_edits`` over 1 there are no such keys and crowded lines are paired). Pairs are verified by banded bit-parallel edit distance: bit d of
state k says that a prefix pair on diagonal d is within k edits, and one character of
the longer line moves all diagonals at once.

Null texts have no lines; an empty text is one empty line. Rows with one doc_id are
one document: lines with one number are in the same place, neither is earlier. A null
doc_id sorts first. Long texts and lines are read whole, ties cannot occur between
places. Extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import BROADCAST_KEY_BYTES, Scratch, id_order, keep_keys, require_free, unused

MAX_EDITS = 1
MIN_CHARS = 20
#: Pairs that one segment key may make before its lines take the longer keys instead.
HEAVY = 400
DEEP_PARTS = 16
#: Lines of one document that share a mask word.
_MASK_BITS = 60


def _shift(side: str, bits: Column, by: Column) -> Column:
    return F.call_function(f"shift{side}", bits, by.cast("int"))


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of ``parts`` even ones; the last are the longer."""
    short = F.floor(length / parts).cast("int")
    longer = F.pmod(length, F.lit(parts)).cast("int")
    first_longer = F.lit(parts) - longer
    start = short * i + F.greatest(F.lit(0), F.lit(i) - first_longer) + 1
    return start, short + (F.lit(i) >= first_longer).cast("int")


def _key(length: Column, i: int, content: Column) -> Column:
    return F.xxhash64(F.lit(i), length.cast("int"), content)


def index_keys(line: Column, length: Column, max_edits: int) -> Column:
    """One key per segment of the line."""
    keys = []
    for i in range(max_edits + 1):
        start, size = _segment(length, i, max_edits + 1)
        keys.append(_key(length, i, F.substr(line, start, size)))
    return F.array(*keys)


def probe_keys(line: Column, length: Column, max_edits: int) -> Column:
    """Keys of the substrings that can equal a segment of a line ``0..max_edits`` characters shorter."""
    keys = []
    for shorter in range(max_edits + 1):
        target = length - shorter
        for i in range(max_edits + 1):
            start, size = _segment(target, i, max_edits + 1)
            low = max(-i, shorter - (max_edits - i))
            high = min(i, shorter + (max_edits - i))
            for shift in range(low, high + 1):
                at = start + shift
                inside = (at >= 1) & (at + size - 1 <= length) & (target > max_edits)
                keys.append(F.when(inside, _key(target, i, F.substr(line, at, size))))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def deep_keys(line: Column, length: Column, longer: int) -> Column:
    """Per segment, the line without it (key) and the segment (part): as of ``length - longer`` characters with ``longer`` added there."""
    target = length - longer
    keys = []
    for i in range(DEEP_PARTS):
        start, size = _segment(target, i, DEEP_PARTS)
        rest = F.substr(line, start + size + longer)
        key = F.xxhash64(F.lit(i), target.cast("int"), F.substr(line, F.lit(1), start - 1), rest)
        keys.append(F.struct(key.alias("key"), F.substr(line, start, size + longer).alias("part")))
    return F.array(*keys)


def _each_place(deep: DataFrame, key: Callable[[Column, Column], Column]) -> DataFrame:
    """key, doc, pos: ``key(place, part without the character there)`` for each place of the part."""
    part = F.col("part")

    def at(j: Column) -> Column:
        return key(j, F.concat(F.substr(part, F.lit(1), j - 1), F.substr(part, j + 1)))

    return deep.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(part)), at)).alias("key"), "doc", "pos")


def within_edits(left: Column, right: Column, max_edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``max_edits``."""
    # Bound as a lambda variable: the strings are taken apart once, not once a character.
    both = F.array(F.struct(F.split(left, "").alias("a"), F.split(right, "").alias("b")))
    same = F.transform(both, lambda s: _banded(s["a"], s["b"], max_edits))[0]
    return F.when(F.abs(F.length(left) - F.length(right)) > max_edits, F.lit(False)).when(
        (left == "") | (right == ""), F.greatest(F.length(left), F.length(right)) <= max_edits
    ).otherwise(same)


def _banded(a: Column, b: Column, max_edits: int) -> Column:
    """The banded automaton over two non-empty character arrays."""
    k, width = max_edits, 2 * max_edits + 1
    full = (1 << width) - 1
    # Diagonal d = (characters of a read) - (characters of b read), bit d + k.
    # Before any character of b: i characters of a read cost i edits.
    start = F.struct(*[
        F.lit(sum(1 << (d + k) for d in range(0, e + 1))).cast("long").alias(f"s{e}") for e in range(k + 1)
    ])

    def step(state: Column, j: Column) -> Column:
        char = F.get(b, j)
        hit = F.lit(0).cast("long")
        for d in range(-k, k + 1):
            same = F.coalesce((j + d >= 0) & (F.get(a, F.greatest(j + d, F.lit(0))) == char), F.lit(False))
            hit = hit.bitwiseOR(F.when(same, F.lit(1 << (d + k)).cast("long")).otherwise(F.lit(0).cast("long")))
        out = []
        for e in range(k + 1):
            old = state[f"s{e}"]
            new = old.bitwiseAND(hit)
            if e:
                less = state[f"s{e - 1}"]
                new = new.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1))
                new = new.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full).cast("long"))
            out.append(new)
        return F.struct(*[x.alias(f"s{e}") for e, x in enumerate(out)])

    end = F.size(a) - F.size(b)
    last = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step, lambda s: s[f"s{k}"])
    return _shift("right", last, end + k).bitwiseAND(F.lit(1).cast("long")) == 1


def _lines(docs: DataFrame) -> DataFrame:
    """doc, pos, line of the lines that are long enough to be compared."""
    rows = docs.select(id_order("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.withColumn("length", F.length("line")).filter(F.col("length") >= MIN_CHARS)


def _heavy_keys(held: DataFrame, asked: DataFrame) -> DataFrame:
    """Keys under which more than ``HEAVY`` pairs would meet."""
    both = held.select("key", F.lit(1).alias("h"), F.lit(0).alias("a")).unionByName(
        asked.select("key", F.lit(0).alias("h"), F.lit(1).alias("a"))
    )
    counts = both.groupBy("key").agg(F.sum("h").alias("h"), F.sum("a").alias("a"))
    return counts.filter(F.col("h") * F.col("a") > HEAVY).select("key")


def _meet(held: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs of different lines under one key: doc, pos (the earlier place), doc2, pos2."""
    other = asked.select("key", F.col("doc").alias("doc2"), F.col("pos").alias("pos2"))
    one, two = F.struct("doc", "pos"), F.struct(F.col("doc2").alias("doc"), F.col("pos2").alias("pos"))
    return (
        held.join(other, "key")
        .filter((F.col("doc") != F.col("doc2")) | (F.col("pos") != F.col("pos2")))
        .select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
        .distinct()
        .select("a.doc", "a.pos", F.col("b.doc").alias("doc2"), F.col("b.pos").alias("pos2"))
    )


def _texts_at(docs: DataFrame, places: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc, pos, line of the given places; only their documents are read."""
    owners = scratch.stage(places.select("doc").distinct(), f"{name}_owners")
    wanted = keep_keys(docs.select(id_order("doc_id").alias("doc"), "doc_id", "text"), owners, "doc")
    found = _lines(wanted).join(places, ["doc", "pos"], "left_semi").select("doc", "pos", "line").distinct()
    return scratch.stage(found, f"{name}_lines")


def _deep_pairs(same: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of crowded lines one edit apart, and some more: ``_meet`` under the deep keys, or by place where these crowd too."""
    heavy = scratch.stage(_heavy_keys(same, same.unionByName(more)), "deep_heavy")
    if heavy.isEmpty():
        return _meet(same.drop("part"), same.unionByName(more))
    many = F.broadcast(heavy) if heavy.count() * 16 <= BROADCAST_KEY_BYTES else heavy
    light, light_more = (d.drop("part").join(many, "key", "left_anti") for d in (same, more))
    crowd, crowd_more = (d.join(many, "key", "left_semi") for d in (same, more))
    changed = _each_place(crowd, lambda j, rest: F.xxhash64(j, "key", rest))
    whole = crowd.select(F.xxhash64(F.lit(-1), "key", "part").alias("key"), "doc", "pos")
    shorter = _each_place(crowd_more, lambda j, rest: F.xxhash64(F.lit(-1), F.col("key"), rest))
    # One after the other: as one plan their shuffles run at a time, and the driver holds the state of all of them.
    return (
        scratch.stage(_meet(light, light.unionByName(light_more)), "deep_light")
        .unionByName(scratch.stage(_meet(changed, changed), "deep_changed"))
        .unionByName(scratch.stage(_meet(whole, shorter), "deep_whole"))
    )


def line_links(docs: DataFrame, max_edits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (doc, pos of the first place) and links between them (doc, pos < doc2, pos2)."""
    lines = _lines(docs).select(
        "doc", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "length",
        index_keys(F.col("line"), F.col("length"), max_edits).alias("index"),
        probe_keys(F.col("line"), F.col("length"), max_edits).alias("probe"),
    )
    distinct = scratch.stage(
        lines.groupBy("h1", "h2", "length")
        .agg(F.min(F.struct("doc", "pos", "index", "probe")).alias("f"))
        .select("f.doc", "f.pos", "f.index", "f.probe"),
        "distinct",
    )
    held = distinct.select(F.explode("index").alias("key"), "doc", "pos")
    asked = distinct.select(F.explode("probe").alias("key"), "doc", "pos")
    heavy = scratch.stage(_heavy_keys(held, asked), "heavy") if max_edits == 1 else None
    if heavy is None or heavy.isEmpty():
        pairs = _meet(held, asked)
    else:
        many = F.broadcast(heavy) if heavy.count() * 16 <= BROADCAST_KEY_BYTES else heavy
        crowd = held.unionByName(asked).join(many, "key", "left_semi").select("doc", "pos").distinct()
        crowd = _texts_at(docs, scratch.stage(crowd, "crowd"), scratch, "crowd")
        deep = crowd.withColumn("length", F.length("line"))
        same, more = (
            deep.select(F.explode(deep_keys(F.col("line"), F.col("length"), n)).alias("d"), "doc", "pos")
            .select("d.key", "d.part", "doc", "pos")
            for n in (0, 1)
        )
        light = scratch.stage(_meet(held.join(many, "key", "left_anti"), asked.join(many, "key", "left_anti")), "light")
        pairs = light.unionByName(_deep_pairs(same, more, scratch)).distinct()
    pairs = scratch.stage(pairs, "pairs")
    scratch.drop("light", "deep_light", "deep_changed", "deep_whole")
    # Texts of the lines in pairs only: their documents are few, the others are not read again.
    places = scratch.stage(pairs.select("doc", "pos").union(pairs.select("doc2", "pos2")).distinct(), "places")
    texts = _texts_at(docs, places, scratch, "places")
    other = texts.select(F.col("doc").alias("doc2"), F.col("pos").alias("pos2"), F.col("line").alias("line2"))
    spelled = (
        pairs.join(texts, ["doc", "pos"]).join(other, ["doc2", "pos2"])
        .filter(within_edits(F.col("line"), F.col("line2"), max_edits))
    )
    links = spelled.select("doc", "pos", "doc2", "pos2")
    links = scratch.stage(links.distinct(), "links")
    scratch.drop("heavy", "deep_heavy", "crowd", "crowd_owners", "crowd_lines", "places", "places_owners", "places_lines", "pairs")
    return distinct.select("doc", "pos"), links


COUNTS = ("n_lines", "n_removed", "n_links")


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, names: tuple[str, str, str] = COUNTS) -> DataFrame:
    """Every column of ``docs``, the text without its repeated lines, and n_lines, n_removed, n_links (or ``names``).

    A column of one of these names in ``docs`` is an error.

    n_links counts the near links of the distinct lines that have their first place in the document.
    """
    require_free(docs, *names, "__doc", "__mask", "__links", "__lines", "__left")
    scratch = Scratch(docs.sparkSession, "lines")
    first, links = line_links(docs, max_edits, scratch)
    later = links.select(F.col("doc2").alias("doc"), F.col("pos2").alias("pos")).distinct()
    kept = first.join(later, ["doc", "pos"], "left_anti")
    word = kept.groupBy("doc", F.floor(F.col("pos") / _MASK_BITS).cast("int").alias("word")).agg(
        F.bit_or(_shift("left", F.lit(1).cast("long"), F.pmod("pos", F.lit(_MASK_BITS)))).alias("bits")
    )
    by_doc = word.groupBy("doc").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"), F.max("word").alias("top"),
        F.sum(F.bit_count("bits")).alias("n_kept"),
    )
    masks = by_doc.select(
        "doc", "n_kept", F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.coalesce(F.col("words")[w], F.lit(0).cast("long"))).alias("mask")
    )
    ends = links.select("doc").unionAll(links.select(F.col("doc2").alias("doc")))
    counted = ends.groupBy("doc").agg(F.count("*").alias("n_links"))
    # Documents of one row that keep all their long lines and have no link stay where they are.
    long_ = docs.select(
        id_order("doc_id").alias("doc"), F.size(F.filter(F.split("text", "\n"), lambda line: F.length(line) >= MIN_CHARS)).alias("n_long")
    ).groupBy("doc").agg(F.max("n_long").alias("n_long"), F.count(F.lit(1)).alias("rows"))
    touched = (F.col("rows") > 1) | (F.col("n_long") != F.coalesce("n_kept", F.lit(0))) | F.col("n_links").isNotNull()
    marks = long_.join(masks, "doc", "left").join(counted, "doc", "left").filter(touched)
    marks = scratch.stage(marks.select("doc", "mask", "n_links"), "marks")

    def stays(line: Column, i: Column) -> Column:
        bits = F.coalesce(F.get(F.col("__mask"), F.floor(i / _MASK_BITS).cast("int")), F.lit(0).cast("long"))
        bit = _shift("right", bits, F.pmod(i, F.lit(_MASK_BITS))).bitwiseAND(F.lit(1).cast("long"))
        return (F.length(line) < MIN_CHARS) | (bit == 1)

    keyed = docs.withColumn("__doc", id_order("doc_id"))
    marks = marks.select(F.col("doc").alias("__doc"), F.col("mask").alias("__mask"), F.col("n_links").alias("__links"))
    ids = marks.select("__doc")
    ids = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_KEY_BYTES else ids
    changed = keyed.join(ids, "__doc", "left_semi").join(marks, "__doc").withColumn("__lines", F.split("text", "\n"))
    changed = changed.withColumn("__left", F.filter("__lines", stays))
    same = keyed.join(ids, "__doc", "left_anti").select(
        "*", F.lit(None).cast(marks.schema["__mask"].dataType).alias("__mask"), F.lit(None).cast("long").alias("__links")
    )
    lines = F.split("text", "\n")
    rest = changed.unionByName(same.withColumns({"__lines": lines, "__left": lines}))
    named = {c: F.col(c) for c in docs.columns}
    named["text"] = F.when(F.size("__left") < F.size("__lines"), F.array_join("__left", "\n")).otherwise(F.col("text"))
    named[names[0]] = F.coalesce(F.size("__lines"), F.lit(0)).cast("long")
    named[names[1]] = F.coalesce(F.size("__lines") - F.size("__left"), F.lit(0)).cast("long")
    named[names[2]] = F.coalesce("__links", F.lit(0).cast("long"))
    return rest.select(*[c.alias(n) for n, c in named.items()])


def drop_repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """``docs`` without repeated lines, same columns; a document with nothing left but had text goes.

    Documents that lose no line are returned unchanged; n_chars follows a changed text.
    """
    counts = tuple(unused(docs, n) for n in COUNTS)
    clean = dedup_lines(docs, max_edits, counts)
    changed = F.col(counts[1]) > 0
    out = clean.filter(~(changed & (F.trim("text") == "")))
    columns = {c: F.col(c) for c in docs.columns}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[c.alias(n) for n, c in columns.items()])
