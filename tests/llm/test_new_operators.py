"""Exact dedup, periodic runs and centroid clustering against brute force, and their awkward inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOC, corpus, documents, rows_of
from varloom.llm import centroids, exact, runs
from varloom.llm.queries import _repeating_tenth

CLASHES = ("digest", "__digest", "id", "__id", "row", "last", "__last", "n", "kept", "keep_id", "runs", "collapsed", "n_words")


def with_clashes(df, *left_out):
    for name in CLASHES:
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


# --- exact dedup -----------------------------------------------------------------------


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def groups_of(rows):
    out = {}
    for doc_id, text in rows:
        out.setdefault(lowered(text), []).append(doc_id)
    return out


def hot_rows():
    """A text with a third of all rows, one with a tenth, pairs, cases, accents, nulls and empties."""
    rng = random.Random(3)
    texts = ["The SAME text İ" if rng.random() < 0.5 else "the same text İ" for _ in range(300)]
    texts += ["Ärger"] * 60 + ["ärger"] * 30 + [None, "", "", " "]
    texts += [f"Text {i // 2}" for i in range(300)] + [f"single {i}" for i in range(200)]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("share", [5, 50, 1_000])
def test_exact_groups_equal_brute_force(spark, share):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in exact.duplicate_groups(df, share).collect()}
    assert len(got) == len(rows)
    for text, ids in groups_of(rows).items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_frequent_digests_hold_every_heavy_one(spark):
    """Adversarial order: the heavy digests come last, after many single ones, in every partition."""
    rows = [(p, f"d{p}-{i}") for p in range(8) for i in range(3_000)]
    rows += [(p, f"heavy{i % 6}") for p in range(8) for i in range(120)]
    df = spark.createDataFrame(rows, "p int, digest string").repartition(8, "p").sortWithinPartitions("p", "digest")
    found = [r[0] for r in exact.frequent_digests(df, 200).collect()]
    assert {f"heavy{i}" for i in range(6)} <= set(found)
    assert len(found) <= 250 and len(set(found)) == len(found)


def test_heavy_winners_are_counted_exactly(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}", i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, digest string, row long").repartition(5)
    winners = {r["digest"]: (r["n"], r["last"]["id"]) for r in exact.heavy_winners(df, 100).collect()}
    assert winners == {"hot": (1_000, 2_997)}


def test_heavy_rows_do_not_shuffle(spark):
    """Only rows of digests that are not heavy reach the window's exchange."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3_000)]
    out = exact.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("share", [4, 1_000])
def test_remove_duplicates_keeps_one_row_and_all_columns(spark, share):
    rows = hot_rows()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    out = exact.remove_duplicates(df, share)
    assert out.columns == df.columns
    kept = out.collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(max(ids) for ids in groups_of(rows).values())
    texts = dict(rows)
    assert all(r["text"] == texts[r["doc_id"]] and r["__digest"] == "own __digest" and r["n"] == "own n" for r in kept)


@pytest.mark.parametrize("share", [3, 1_000])
def test_exact_ties_and_null_ids(spark, share):
    rows = [(7, "a", 1), (7, "A", 2), (7, "a", 3), (3, "a", 4), (None, "b", 5), (None, "B", 6), (2, "c", 7), (None, "c", 8), (7, "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    marks = exact.duplicate_groups(df, share).collect()
    for sha, keep in (("a", 7), ("b", None), ("c", 2), ("z", 7)):
        group = [r for r in marks if r["text_sha256"] == hashlib.sha256(sha.encode()).hexdigest()]
        assert sum(r["kept"] for r in group) == 1
        assert {r["keep_id"] for r in group} == {keep} and {r["group_size"] for r in group} == {len(group)}
        assert [r["doc_id"] for r in group if r["kept"]] == [keep]
    kept = exact.remove_duplicates(df, share).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"].lower()) for r in kept) == [
        (False, 2, "c"), (False, 7, "a"), (False, 7, "z"), (True, 0, "b"),
    ]


def test_exact_empty_table(spark):
    none = spark.createDataFrame([], DOC)
    assert exact.duplicate_groups(none).collect() == [] and exact.remove_duplicates(none).collect() == []


# --- periodic runs ---------------------------------------------------------------------


def slow_runs(words, exponent=4, min_length=6):
    """Every run, from the definition: each lag's stretches of equal words, those with a smaller period left out."""
    n, out = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if length >= max(min_length, exponent * q):
                out.setdefault((a, length), q)
    return sorted((a, length, q) for (a, length), q in out.items())


def slow_collapse(words, found):
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts():
    """Words over small alphabets (many runs), long periods, nested runs and cycles whose short windows all recur."""
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x" + " y" * 500, "a b\x0bc\x0ca b\tc\na b\rc a b c"]
    for letters, n in ((1, 30), (2, 60), (2, 300), (3, 120), (4, 200)):
        texts += [" ".join(rng.choice("abcd"[:letters]) for _ in range(n)) for _ in range(12)]
    for period in (2, 3, 7, 8, 13, 31, 64):
        unit = [rng.choice("ab") for _ in range(period)]
        lead = [f"l{rng.randrange(9)}" for _ in range(rng.randrange(9))]
        for times in (3.9, 4, 5.5):
            texts.append(" ".join(lead + (unit * 6)[: int(period * times)] + lead))
    inner = "p p p p p p p q".split()
    texts.append(" ".join(inner * 5 + ["z"] + inner * 4))
    half = "a a a b a b b b".split()  # its 3-grams occur once each; doubled with a twist every 3-gram occurs twice
    texts.append(" ".join((half + half[3:] + half[:3]) * 5))
    texts.append(" ".join(["é", "É"] * 9 + ["ß"] * 7 + [" ", " "] * 6))
    texts.append("the same line again\n" * 40 + "and an end")
    return texts


def test_runs_equal_brute_force(spark):
    texts = run_texts()
    got = {r["doc_id"]: r for r in runs.periodic_runs(documents(spark, texts)).collect()}
    total = 0
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        want = slow_runs(words)
        total += len(want)
        assert [(r["start"], r["length"], r["period"]) for r in got[i]["runs"]] == want, t
        assert got[i]["collapsed"] == slow_collapse(words, want) and got[i]["n_words"] == len(words)
    assert total > 100


@pytest.mark.parametrize("exponent, min_length", [(3, 1), (3, 20), (4, 6), (5, 9), (6, 50)])
def test_runs_at_other_thresholds(exponent, min_length):
    docs = [(t or "").encode().split() for t in run_texts()]
    got = runs._runs_of(docs, exponent, min_length)
    assert got == [slow_runs(d, exponent, min_length) for d in docs]


def test_seeds_are_one_a_position_and_class():
    """A document of one word 20,000 times: 1.6 pairs a word in all, not one a pair of occurrences."""
    words = np.zeros(20_000, np.int64)
    assert runs.find_runs(words, np.array([0, 20_000])) == [(0, 0, 20_000, 1)]
    keys = np.zeros(20_000 - 4, np.int64)
    place, lag = runs._seeds(keys, np.arange(len(keys)), 1, 1)
    assert len(place) == len(keys) - 1 and set(lag.tolist()) == {1}
    assert len(runs._seeds(keys, np.arange(len(keys)), 2, 3)[0]) == 0


def test_small_exponent_is_an_error():
    with pytest.raises(ValueError, match="3 or more"):
        runs.find_runs(np.zeros(4, np.int64), np.array([0, 4]), exponent=2)


def test_slices_do_not_change_runs(spark, monkeypatch):
    docs = [(t or "").encode().split() for t in run_texts()]
    whole = runs._runs_of(docs, 4, 6)
    assert [runs._runs_of([d], 4, 6)[0] for d in docs] == whole


def test_collapse_runs_passes_columns_through(spark):
    texts = ["a b " * 6 + "c", "no  runs\nhere", None, "", "w " * 5_000 + "end"]
    df = with_clashes(documents(spark, texts))
    out = runs.collapse_runs(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["text"] for i in range(5)] == ["a b c", "no  runs\nhere", None, "", "w end"]
    assert all(r["runs"] == "own runs" and r["n_words"] == "own n_words" for r in got.values())
    assert runs.periodic_runs(df).count() == 5
    none = spark.createDataFrame([], DOC)
    assert runs.collapse_runs(none).collect() == [] and runs.periodic_runs(none).collect() == []


def test_repeated_rows_and_null_ids_keep_their_rows(spark):
    rows = [(1, "a " * 8), (1, "a " * 8), (None, "b c " * 4), (None, None)]
    out = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, len(r["runs"])) for r in out) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_the_contracts_input(spark):
    df = spark.createDataFrame(rows_of(corpus(2, 200)), DOC)
    got = {r["doc_id"]: r["text"] for r in _repeating_tenth(df).collect()}
    changed = 0
    for i, t, *_ in rows_of(corpus(2, 200)):
        words = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            t = b" ".join(words[j] if j < a else words[a + (j - a) % p] for j in range(n)).decode()
            changed += 1
        assert got[i] == t
    assert changed > 10


# --- centroid clustering ---------------------------------------------------------------


def slow_clusters(rows, k=16, rounds=3, dim=64, seed=1):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [list(v) for _, v in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        near = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            near.append((min(far), far.index(min(far))))
        if turn == rounds:
            break
        for c in range(len(centres)):
            own = [v for (_, v), (_, j) in zip(kept, near) if j == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    return kept, near, centres


def vectors(n, dim=64, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((5, dim))
    return [(i, [float(np.float32(x)) for x in middle[i % 5] + spread * rng.standard_normal(dim)]) for i in range(n)]


VEC = "vec_id long, embedding array<float>"


def awkward_vectors():
    rows = vectors(150)
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63),
             (205, [float("nan")] * 64), (206, [float("inf")] + [0.0] * 63), (207, [0.0] * 64), (208, [-0.001] * 64),
             (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    return rows + [(300 + i, rows[0][1]) for i in range(60)]


@pytest.mark.parametrize("options", [{}, {"k": 3, "pivots": 1}, {"k": 40, "rounds": 1, "pivots": 12}, {"k": 1}])
def test_clusters_equal_brute_force(spark, options):
    rows = awkward_vectors()
    df = spark.createDataFrame(rows, VEC).repartition(5).withColumn("cluster", F.lit("own")).withColumn("apex", F.lit(1))
    plain = {k: v for k, v in options.items() if k != "pivots"}
    kept, near, centres = slow_clusters(rows, **plain)
    inertia = [sum(d for d, j in near if j == c) for c in range(len(centres))]
    want = sorted(((-1 if i is None else i), c, d, inertia[c], sum(inertia), tuple(centres[c])) for (i, _), (d, c) in zip(kept, near))
    got = centroids.clustered(df, **options).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:5], tuple(r[5])) for r in got) == want


def test_few_and_no_vectors(spark):
    rows = vectors(3)
    got = centroids.clustered(spark.createDataFrame(rows, VEC)).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in got) == [(0, 0), (1, 0), (2, 0)]
    assert centroids.clustered(spark.createDataFrame([], VEC)).collect() == []
    assert centroids.clustered(spark.createDataFrame([(1, None), (2, [0.0])], VEC)).collect() == []
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(30)], VEC)
    assert {(r["cluster"], r["distance"]) for r in centroids.clustered(same).collect()} == {(0, 0)}


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [3e30] * 64), (2, [0.0] * 64)], VEC)
    with pytest.raises(Exception, match="distances are longs"):
        centroids.clustered(df).collect()


@pytest.mark.parametrize("pivots", [1, 2, 5, 16])
def test_bounds_hold_and_filter(pivots):
    """Every true distance lies between the bounds; on vectors in groups most centroids are never compared."""
    points = np.array([np.floor(64 * np.array(v)).astype(np.int64) for _, v in vectors(400, seed=3)])
    first = points[:16].copy()
    simplex = centroids.Simplex(first, pivots)
    assert 1 <= len(simplex.pivots) <= pivots
    a, c = simplex.apexes(points), simplex.apexes(first)
    level = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(axis=2)
    low = np.sqrt(level + (a[:, None, -1] - c[None, :, -1]) ** 2)
    high = np.sqrt(level + (a[:, None, -1] + c[None, :, -1]) ** 2)
    true = np.sqrt(((points[:, None] - first[None]) ** 2).sum(axis=2))
    assert (low <= true * (1 + 1e-9) + 1e-6).all() and (true <= high * (1 + 1e-9) + 1e-6).all()
    cluster, distance, computed = centroids.nearest(points, a, first, c)
    far = ((points[:, None] - first[None]) ** 2).sum(axis=2)
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    if pivots >= 5:
        assert computed < 0.5 * far.size


def test_dependent_pivots_are_left_out():
    line = np.array([[0, 0, 0], [2, 0, 0], [4, 0, 0], [4, 0, 0], [0, 3, 0]], np.int64)
    assert centroids.Simplex(line, 5).pivots.tolist() == [[0, 0, 0], [2, 0, 0], [0, 3, 0]]
