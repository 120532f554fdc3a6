"""Substring, line and near-duplicate removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varloom.llm import components, lines, minhash, substrings
from varloom.llm.common import Scratch

from .helpers import DOC, corpus, documents, prose


def repeats(texts):
    """Per text: (bytes, removed, spans, kept) by looking at every window."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 99):
            window = raw[i : i + 100]
            if window in seen:
                cover[i] += 1
                cover[i + 100] -= 1
            seen.add(window)
        gone = np.cumsum(cover)[: len(raw)] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def removed(df):
    rows = substrings.remove_repeats(df).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows}


def test_substrings_match_brute_force(spark):
    texts = corpus()
    got = removed(documents(spark, texts).repartition(5))
    assert got == dict(enumerate(repeats(texts)))
    assert any(v[1] for v in got.values())


def test_substrings_deal_on_a_common_anchor(spark, monkeypatch):
    rng = random.Random(4)
    common = "this is a short passage of more than thirty-two bytes"
    texts = [prose(rng, 12) + " " + common + " " + prose(rng, 12) for _ in range(30)]
    texts += [t[3:] for t in texts[:5]]
    monkeypatch.setattr(substrings, "GROUP_FRAGMENTS", 4)
    assert removed(documents(spark, texts)) == dict(enumerate(repeats(texts)))


def test_substrings_hold_a_common_window_once(monkeypatch):
    rng = random.Random(6)
    common = " ".join(f"shared{i}" for i in range(30))
    texts = [prose(rng, 6) + " " + common + " " + prose(rng, 6) for _ in range(600)] + [None, common]
    monkeypatch.setattr(substrings, "GROUP_FRAGMENTS", 20)
    monkeypatch.setattr(substrings, "INDEX_BYTES", 1 << 13)
    order = list(range(len(texts)))
    rng.shuffle(order)
    tasks = [order[i::6] for i in range(6)]

    def batch(ids, *more):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([texts[i] for i in ids], pa.string()), *more],
                                          names=["doc", "text", "asked"][: 2 + len(more)])

    packed = [b for ids in tasks for b in substrings._anchor_map(1)([batch(ids)])]
    found = pa.Table.from_batches(list(substrings._resolve(packed))).to_pylist()
    asked = {i: [] for i in order}
    for r in found:
        if r["anchor"] is not None:
            asked[r["doc"]].append({k: r[k] for k in ("at", "n", "anchor", "parts")})
    assert any(f["parts"] > 1 for a in asked.values() for f in a)
    indexed = []
    real = substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda pieces: indexed.append(sum(len(p[2]) for p in pieces)) or real(pieces))
    for held in (1_000_000, 50):  # the latter: tasks send what they hold over and over
        monkeypatch.setattr(substrings, "HELD_WINDOWS", held, raising=False)
        sent = [b for ids in tasks for b in substrings._cut_pieces(64)([batch(ids, pa.array([asked[i] for i in ids]))])]
        rows = pa.Table.from_batches(sent).sort_by([("anchor", "ascending"), ("doc", "ascending"), ("at", "ascending")])
        runs = [(r["doc"], r["at"], r["n"]) for r in found if r["anchor"] is None]
        for b in substrings._index_pieces(rows.to_batches(max_chunksize=500)):
            runs += [(r["doc"], r["at"], r["n"]) for r in b.to_pylist()]
        for i, (n, gone, spans, _) in enumerate(repeats(texts)):
            cut = substrings._merged([(at, k) for doc, at, k in runs if doc == i], n)
            assert (sum(b - a for a, b in cut), len(cut)) == (gone, spans)
    assert max(indexed) < 4 * (1 << 13)


def test_substrings_edges(spark):
    text = prose(random.Random(2), 80)
    rows = [(None, text, "en", "a", 1), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (4, None, "en", "a", 1)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, DOC)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    n = len(text.encode())
    assert by_id == {None: [(n, 0)], 3: [(n, n), (n, n)], 4: [(0, 0)]}
    empty = substrings.remove_repeats(spark.createDataFrame([], DOC))
    assert empty.count() == 0
    extra = substrings.remove_repeats(documents(spark, ["a", None], extra=True).drop("kept"))
    assert extra.count() == 2


def test_long_text_spans_blocks(spark):
    rng = random.Random(9)
    text = prose(rng, 40_000)
    assert len(text) > 2 * substrings.BLOCK
    texts = [text, text[1_000:], text[131_000:131_300]]
    got = removed(documents(spark, texts))
    assert [got[i][1] for i in range(3)] == [0, len(texts[1].encode()), len(texts[2].encode())]


def test_backward_extension_finds_every_group():
    rng = random.Random(3)
    base = bytes(rng.choice(b"abc ") for _ in range(300))
    text = np.frombuffer(base + b"\xff" + base[20:250] + b"\xff" + base[:150] + b"\xff", np.uint8)
    order, group = substrings.prefix_groups(text, 100)
    raw = text.tobytes()
    whole = {}
    for place, g in zip(order, group):
        window = raw[place : place + 100]
        if len(window) == 100 and b"\xff" not in window:
            whole.setdefault(window, set()).add(int(g))
    assert all(len(g) == 1 for g in whole.values())
    assert len({g for s in whole.values() for g in s}) == len(whole)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_lines(texts, k):
    places = [
        ((i, j), line) for i, t in enumerate(texts) if t is not None for j, line in enumerate(t.split("\n"))
        if len(line) >= lines.MIN_CHARS
    ]
    first = {}
    for place, line in places:
        first.setdefault(line, place)
    gone = set()
    for place, line in places:
        if first[line] < place or any(
            p < place and abs(len(x) - len(line)) <= k and edit_distance(x, line) <= k for x, p in first.items()
        ):
            gone.add(place)
    return ["\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) if t is not None else None
            for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [1, 2])
def test_lines_match_brute_force(spark, k):
    rng = random.Random(k)
    texts = corpus(seed=5, n=15)
    for _ in range(25):
        line = prose(rng, 5)
        other = list(line)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(other))
            rng.choice([lambda: other.pop(at), lambda: other.insert(at, "q"), lambda: other.__setitem__(at, "é")])()
        texts += [line + "\nshort", "".join(other)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, texts), max_edits=k).collect()}
    want = brute_lines(texts, k)
    assert [got[i] for i in range(len(texts))] == want
    assert want != texts


def test_lines_of_a_common_segment_take_longer_keys(spark, monkeypatch):
    rng = random.Random(8)
    head = prose(rng, 8)
    texts = [head + " " + "".join(rng.choice("ab") for _ in range(rng.choice([60, 61]))) for _ in range(60)]
    for t in texts[:30]:  # near lines within the crowd: changed, longer, shorter
        at = rng.randrange(len(t))
        texts.append(rng.choice([t[:at] + "é" + t[at + 1 :], t[:at] + "é" + t[at:], t[:at] + t[at + 1 :]]))
    monkeypatch.setattr(lines, "HEAVY", 10)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, texts)).collect()}
    want = brute_lines(texts, 1)
    assert [got[i] for i in range(len(texts))] == want and sum(t == "" for t in want) >= 25


def test_lines_of_a_template_meet_by_place(spark, monkeypatch):
    numbers = [f"{7 * i:04d}" for i in range(500)] + [f"{i:03d}" for i in range(0, 1000, 9)]
    head, tail = "one template of sixteen segments, all the same but for the one at ".ljust(66, "."), " and so on".ljust(58, ".")
    count, met = len(numbers), []
    real = lines._meet
    monkeypatch.setattr(lines, "HEAVY", 20)
    monkeypatch.setattr(lines, "_meet", lambda held, asked: met.append(real(held, asked).count()) or real(held, asked))
    first, links = lines.line_links(documents(spark, [head + n + tail for n in numbers]), 1, Scratch(spark, "t"))
    assert first.count() == count
    want = {(i, j) for j in range(count) for i in range(j) if edit_distance(numbers[i], numbers[j]) <= 1}
    assert {(r["doc"], r["doc2"]) for r in links.collect()} == want and want
    assert sum(met) < count * (count - 1) // 2 // 10, (met, len(want))


def test_pairs_of_each_kind_are_written_on_their_own(spark, monkeypatch):
    """No plan holds the joins of all kinds: their shuffles would run at a time."""
    head, tail = "one template of sixteen segments, all the same but for the one at ".ljust(66, "."), " and so on".ljust(58, ".")
    joins, real = {}, Scratch.stage

    def stage(self, df, name):
        joins[name] = len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString()))
        return real(self, df, name)

    monkeypatch.setattr(lines, "HEAVY", 20)
    monkeypatch.setattr(Scratch, "stage", stage)
    lines.line_links(documents(spark, [f"{head}{7 * i:04d}{tail}" for i in range(100)]), 1, Scratch(spark, "t"))
    assert joins["pairs"] == 0
    assert all(0 < joins[name] <= 7 for name in ("light", "deep_light", "deep_changed", "deep_whole")), joins


def test_lines_use_no_python(spark):
    plan = lines.dedup_lines(documents(spark, corpus()))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_many_lines_in_one_document(spark):
    texts = ["\n".join(f"line number {i:06d} of a long document" for i in range(0, 900, 3)), "line number 000300 of a long document"]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert got[1] == (1, 1) and got[0][0] == 300


def test_lines_edges(spark):
    assert lines.dedup_lines(spark.createDataFrame([], DOC)).count() == 0
    df = documents(spark, [None, "", "a line of twenty characters or more", "a line of twenty characters or more"], extra=True)
    kept = lines.drop_repeated_lines(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_components(texts, width, percent=80):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, width):
    rng = random.Random(width)
    texts = corpus(seed=7)
    base = prose(rng, 120).split()
    for i in range(25):  # chains: each differs a little from the one before
        base[rng.randrange(len(base))] = f"new{i}"
        texts.append(" ".join(base))
    rows = minhash.near_duplicates(documents(spark, texts), width=width).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == brute_components(texts, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_edges(spark):
    text = prose(random.Random(1), 30)
    rows = [(None, text, "en", "a", 1), (5, text, "en", "a", 1), (5, text, "en", "a", 1), (6, None, "en", "a", 0), (7, "", "en", "a", 0)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {(None, None, True), (5, None, False), (6, 6, True), (7, 7, True)}
    assert minhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    df = documents(spark, [text, text, "other"], extra=True)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_rows_with_one_id_are_one_document(spark):
    a, b = prose(random.Random(1), 30), prose(random.Random(2), 30)
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1)]
    got = {r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    random.Random(1).shuffle(path)
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame(path + star + [(7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_word_hashes_follow_words_only():
    text = b"a bb  ccc\n a" + b"x" * 300_000 + b" bb"
    h = minhash.word_hashes(text)
    assert len(h) == 6 - 1 and h[1] == h[4] and h[0] != h[3]
    assert hashlib.sha256(minhash.word_hashes(b"a bb")).digest() == hashlib.sha256(h[:2].tobytes()).digest()


def test_no_python_in_pipeline_line_stage(spark):
    df = lines.drop_repeated_lines(documents(spark, corpus()))
    assert isinstance(df.agg(F.count("*")).first()[0], int)
