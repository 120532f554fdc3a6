"""Decontamination, mixing, formatting, archives, search and classifiers on small tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import chat, common, decontam, mixing, neighbours, quality, queries, toxicity, warc

from .helpers import DOC, documents, prose, rows_of

SF = "/root/testdata/sf0.001"


# Scratch tables


def test_stage_collects_the_garbage_of_a_grown_heap(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = [b for b in beans if not any(word in b.getName() for word in ("Young", "Copy", "Scavenge", "Concurrent"))]
    scratch, counts = common.Scratch(spark, "t"), []
    for share in (1.0, 0.0):  # a heap that may grow to its limit, and one that is past its share
        monkeypatch.setattr(common, "HEAP_SHARE", share)
        before = sum(b.getCollectionCount() for b in full)
        assert scratch.stage(spark.range(9), "some").count() == 9
        counts.append(sum(b.getCollectionCount() for b in full) - before)
    assert counts[0] == 0 and counts[1] > 0


# Decontamination


def words(text):
    return decontam.words_of(text)


def brute_hits(text, items):
    doc = words(text)
    hit, found = set(), set()
    for item, other in items:
        w = words(other)
        k = min(10, len(w))
        if not k:
            continue
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(doc) - k + 1):
            if tuple(doc[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(doc), len(hit), sorted(found)


def bench_case():
    rng = random.Random(5)
    small = ("a", "b", "c")
    items = [(i, prose(rng, rng.randrange(8, 30))) for i in range(8)]
    items += [(20, "Three Short Words"), (21, "same. words! here"), (22, "SAME words here"), (23, None), (24, "")]
    items += [(30 + i, " ".join(rng.choice(small) for _ in range(14))) for i in range(4)]
    texts = [None, "", "three short words", "x " + " ".join(rng.choice(small) for _ in range(400))]
    for i in range(20):
        k = rng.randrange(8)
        piece = items[k][1].split()
        a = rng.randrange(len(piece))
        texts.append(prose(rng, 20) + " " + " ".join(piece[a:]) + ", " + prose(rng, 5) + " Same words here.")
    return texts, items


@pytest.mark.parametrize("block", [200_000, 25])
def test_decontamination_matches_brute_force(spark, block):
    texts, items = bench_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontam.find_hits(documents(spark, texts, extra=True).drop("hits"), bench, block_words=block)
    for r in hits.collect():
        h = r["hits"]
        covered = sum(b - a for a, b in zip(h["starts"], h["ends"]))
        assert (h["n_words"], covered, h["items"]) == brute_hits(texts[r["doc_id"]], items)


def test_decontaminate_cuts_and_keeps(spark):
    texts, items = bench_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, texts)
    out = {r["doc_id"]: r for r in decontam.decontaminate(df, bench).collect()}
    for i, text in enumerate(texts):
        n, hit, _ = brute_hits(text, items)
        if hit == 0:
            assert out[i]["text"] == text
        elif 2 * hit >= n:
            assert i not in out
        else:
            assert brute_hits(out[i]["text"], items)[1] == 0 and out[i]["n_chars"] == len(out[i]["text"])
    assert decontam.decontaminate(df, bench.limit(0)).count() == len(texts)
    assert decontam.decontaminate(df.limit(0), bench).count() == 0


# Mixing


def test_targets_fill_and_cap():
    got = mixing.targets([("b", 100), ("a", 10), (None, 50), ("c", 0)])
    # order a, b, c, null with weights 5, 2, 1, 5; a is capped at 30 and c at 0
    assert got["a"] == 30 and got["c"] == 0
    assert abs(sum(got.values()) - 160) < 1e-9 and abs(got["b"] - 130 * 2 / 7) < 1e-9


def test_closest_subset_is_the_best_one():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 30), 4))
        counts = [rng.randrange(0, 4) for _ in lengths]
        budget = rng.randrange(0, 120)
        take = mixing.closest_subset(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(t * n for t, n in zip(take, lengths)) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("share", [0.9, 0.95, 0.99])
def test_fit_uses_every_length(share):
    lengths, counts = np.arange(1, 701), np.ones(700, np.int64)
    budget = int(share * lengths.sum())
    take = mixing.fit_counts(lengths, counts, budget)
    assert ((0 <= take) & (take <= counts)).all() and int((take * lengths).sum()) == budget
    rng = np.random.default_rng(7)
    lengths = np.sort(rng.choice(np.arange(20, 3_000), 1_200, replace=False))
    counts = rng.integers(1, 3, 1_200)
    budget = int(share * (lengths * counts).sum())
    take = mixing.fit_counts(lengths, counts, budget)
    assert ((0 <= take) & (take <= counts)).all() and int((take * lengths).sum()) == budget


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice(["x", "y", "z", None]), 0) for i in range(400)]
    rows += [(900 + i, "five words in each text", "en", "x", 0) for i in range(300)]  # one length with a third of all
    rows += [(2000, None, None, None, None), (2001, "", "en", "y", 0), (5, "again the same id", "en", "z", 0)]
    df = spark.createDataFrame(rows, DOC)
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by.setdefault(r["source"], [r["target"], r["source_size"], 0])[2] += r["taken"]
    assert sum(v[1] for v in by.values()) == pytest.approx(sum(v[0] for v in by.values()))
    assert all(abs(v[2] - v[0]) <= 2 for v in by.values())
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert mixing.mix_sources(df.limit(0)).count() == 0


# Chat


def test_chat_round_trip(spark):
    nasty = ["\\", "\\\\", "a\\", "###", "####", "</turn>", "\\</turn>\n### User: x", "### Assistant: </turn>\n", "", None, "é\n\n: x", "#"]
    rows = [(1, i, ["user", "assistant", "User", "a: b", "\\x", None][i % 6], t) for i, t in enumerate(nasty * 3)]
    rows += [(None, 0, "assistant", "y"), (2, 0, "assistant", "t"), (2, 0, "assistant", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    want = [(r or "", t or "") for _, _, r, t in rows[: len(nasty) * 3]]
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == want
    assert list(back[1]["loss"]) == [t for r, t in want if r == "assistant"]
    assert list(back[None]["loss"]) == ["y"] and list(back[2]["loss"]) == ["t", "t"]
    for text in back.values():
        assert text["formatted"].endswith("</turn>\n")
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_escapes_only_conflicts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "plain # text"), (1, 1, "user", "### x")], "conv_id long, turn long, role string, text string")
    pieces = {r["turn"]: r["piece"] for r in chat.render_turns(turns).collect()}
    assert pieces == {0: "### User: plain # text", 1: "### User: \\#\\#\\# x"}


def test_chat_uses_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_conversations(turns))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# Archives


def test_warc_round_trip(spark):
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\n", "<p>é</p>\r\n\r\nWARC/1.1\r\n", "", None, "x", "\n", "x"]
    rows = [(i, None if i == 4 else f"https://www.b{i % 2}.example.org/P?q={i}#f\n", h, "k") for i, h in enumerate(html)]
    rows += [(None, "http://a/", "y", "k"), (9, "http://a/", "y", "k"), (6, "http://a/", "x", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, run string")
    got = warc.capture_history(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    first = {}
    for pid, _, h, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        first.setdefault(h or "", pid)
    for pid, _, h, _ in rows:
        raw = (h or "").encode()
        for r in by[pid]:
            assert r["payload_bytes"] == len(raw)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            same = first[h or ""] == pid
            assert r["record_type"] == ("response" if same else "revisit")
            assert r["refers_to"] == (None if same else first[h or ""])
    assert warc.capture_history(pages.limit(0)).count() == 0


def test_merged_index_is_in_global_order(spark):
    from varloom.llm.common import Scratch, table

    path = Scratch(spark, "t").path("w")
    warc.write_archives(warc.captures(table(spark, SF, "pages")).repartition(6), path)
    index = warc.read_archives(spark, path)
    merged = warc.merge_index(index).select("url_key", "captured_at", "page_id").collect()
    assert merged == sorted(merged, key=tuple) and len(merged) == table(spark, SF, "pages").count()
    assert index.select("run").distinct().count() > 1


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_torn_record_raises():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


# Neighbours


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 16)).astype(np.float32)
    x[100:160] = x[7]  # one vector of many ids
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(5001, None, 1), (5002, [0.0] * 16, 1), (5003, [float("nan")] * 16, 1), (5004, [1.0] * 3, 1), (None, rows[0][1], 1)]
    rows += [rows[50]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.search(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(float)
    n = np.sqrt((d * d).sum(1))
    hit = 0
    for q in range(0, 1200, 50):
        s = (d * d[q]).sum(1) / (n * n[q])
        order = [i for i in np.lexsort((np.arange(1200), -s)) if i != q][:5]
        rows_ = sorted(got[q])
        assert [r for r, _, _ in rows_] == [1, 2, 3, 4, 5]
        hit += len({i for _, i, _ in rows_} & set(order))
        assert all(abs(sc - s[i]) < 1e-12 for _, i, sc in rows_)
    assert hit >= 0.9 * 24 * 5
    assert [i for _, i, _ in sorted(got[100])] == [7, 101, 102, 103, 104]
    assert neighbours.search(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.search(few).collect()] == [(0, 1)]


# Classifiers


def held_out(spark, op, column, modulus, remainder):
    out = queries.QUERIES[op](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").select("doc_id", "score", "predicted", F.col(column).alias("y")).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder for r in rows)
    return rows


def auc(rows):
    good = [r["score"] for r in rows if r["y"] == 1]
    bad = [r["score"] for r in rows if r["y"] == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_on_held_out_rows(spark):
    rows = held_out(spark, "op2_quality", "quality", 4, 2)
    assert auc(rows) > 0.98
    assert np.mean([r["predicted"] == r["y"] for r in rows]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    rows = held_out(spark, "op10_toxicity", "toxic", 5, 0)
    assert auc(rows) > 0.85
    clean = [r["predicted"] for r in rows if r["y"] == 0]
    assert np.mean(clean) < 0.08
    assert np.mean([r["predicted"] for r in rows if r["y"] == 1]) > 0.7


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_awkward_rows(spark, module):
    rng = random.Random(1)
    good = [prose(rng, 60) + "." for _ in range(20)]
    bad = ["junk " * rng.randrange(20, 60) for _ in range(20)]
    model = module.fit({1: good, 0: bad})
    df = documents(spark, [None, "", "x" * 50_000, good[0], good[0], bad[0]], extra=True).drop("score")
    rows = {r["doc_id"]: r["score"] for r in module.score_documents(df, model).collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and rows[0] == rows[1] and rows[3] == rows[4]
    assert rows[3] > rows[5]
    none = module.fit({1: [], 0: []})
    assert {r["score"] for r in module.score_documents(df, none).collect()} == {0.0}
    assert module.score_documents(df.limit(0), model).count() == 0


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.standard_normal((50, 3)) + [1, 0, 0], rng.standard_normal((50, 3))
    w = quality.bradley_terry(good, bad)
    assert w[0] > 3 * abs(w[1]) and w[0] > 3 * abs(w[2])


def test_bradley_terry_minimises_the_loss_of_all_pairs():
    rng = np.random.default_rng(2)
    good, bad = rng.standard_normal((90, 3)) + [1, 0.5, 0], rng.standard_normal((40, 3))
    w = quality.bradley_terry(good, bad)
    d = (good[:, None, :] - bad[None, :, :]).reshape(-1, 3)
    each = quality.PAIRS_EACH * (len(good) + len(bad)) / len(d)
    miss = 1 / (1 + np.exp(d @ w))
    assert np.abs(w - each * (d.T @ miss)).max() < 1e-3 * each * np.abs(d).sum()


def test_quality_is_fitted_on_all_labelled_rows(spark):
    """Long texts and more of a class than any bound count: the mean is that of every row that may be learned from."""
    texts = {i: ("plain words here. " * (1 + i % 5) if i % 2 else "| 77 # " * (1 + i % 7)) for i in range(6000)}
    texts |= {6000: "a long good text. " * 2000, 6001: "9 | 9 " * 9000, 6002: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2 if i != 6000 else 1, 0) for i in texts], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    seen = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.array([quality.features(texts[i]) for i in seen])
    y = np.array([i % 2 if i != 6000 else 1 for i in seen])
    assert model.mean == pytest.approx(x.mean(axis=0), abs=1e-8) and model.scale == pytest.approx(np.maximum(x.std(axis=0), 1e-6), abs=1e-8)
    same = quality.fit({k: [texts[i] for i in seen if (i % 2 if i != 6000 else 1) == k] for k in (0, 1)})
    assert model.weights == pytest.approx(same.weights, abs=1e-6) and model.at == pytest.approx(same.at, abs=1e-6)
    plain = quality.score_documents(docs, model).select("doc_id", "score")
    by_shape = quality.score_documents(quality.shaped(docs), model).select("doc_id", "score")
    assert dict(plain.collect()) == dict(by_shape.collect())
    assert np.mean((model.score(x) >= 0.7) == (y == 1)) > 0.99


def test_windows_cover_the_text():
    for raw in (b"", b"a", b"some words " * 30, b"x" * 1000, b"x" * 400 + b" y " * 50):
        assert b"".join(toxicity.windows(raw)) == raw


def test_rows_of_helper():
    assert rows_of(["a", None])[1][4] is None
