"""Near copies around the limit: hub step, chunk step and their arithmetic against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, prose
from tests.llm.test_dedup import brute_components
from varloom.llm import minhash
from varloom.llm.common import Scratch


def near_group(n, seed, least=0, most=25, words=150):
    """One text in n copies, each with between ``least`` and ``most`` words of its own."""
    rng = random.Random(seed)
    base = prose(rng, words).split()
    out = []
    for i in range(n):
        own = list(base)
        for j in rng.sample(range(words), rng.randint(least, most)):
            own[j] = f"w{seed}x{i}y{j}"
        out.append(" ".join(own))
    return out


def test_intersections_equal_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 20_000, n, dtype=np.uint64)) for n in (1, 5, 300, 9_000, 15_000, 2)]
    got = minhash.intersections(sets[:4], sets[2:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[2:]] for a in sets[:4]]
    assert minhash.intersections([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def chunk(texts, first, components=None):
    codes = [minhash.shingle_set(t, 2) for t in texts]
    rep = np.arange(first, first + len(texts))
    return {
        "rep": rep, "component": rep.copy() if components is None else np.array(components), "codes": codes,
        "signature": np.stack([(minhash.signature(c) % np.uint32(251)).astype(np.uint8) for c in codes]),
    }


def test_chunk_links_are_a_forest_of_all_links():
    texts = near_group(60, 1) + near_group(20, 2)
    want = {i: c for i, (_, c) in brute_components(texts, 2).items()}
    one, two = chunk(texts[:40], 0), chunk(texts[40:], 40)
    links = [e for a, b in ((one, one), (one, two), (two, two)) for e in minhash.chunk_links(a, b, 80)]
    root = list(range(80))

    def find(i):
        return i if root[i] == i else find(root[i])

    for u, v in links:
        root[max(find(u), find(v))] = min(find(u), find(v))
    assert {i: find(i) for i in range(80)} == want
    assert len(minhash.chunk_links(one, one, 80)) < 40  # a forest, not the pairs
    same = chunk(texts[:40], 0, components=[7] * 40)
    assert minhash.chunk_links(same, same, 80) == []


@pytest.mark.parametrize("chunk_size", [7, 128])
def test_near_copies_around_the_limit(spark, monkeypatch, chunk_size):
    monkeypatch.setattr(minhash, "CHUNK", chunk_size)
    texts = near_group(120, 3) + near_group(40, 4, 14, 30) + [prose(random.Random(i), 40) for i in range(20)]
    random.Random(5).shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, texts), 2).collect()}
    assert got == brute_components(texts, 2)


def test_hub_pairs_are_linear(spark, monkeypatch):
    """A group of near copies that do not link makes pairs with its buckets' hubs and a forest, never its own pairs."""
    seen = {}
    real = Scratch.stage

    def noting(self, df, name):
        out = real(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "stage", noting)
    for n in (50, 200):
        texts = near_group(n, 6, 12, 16)
        rows = minhash.near_duplicates(documents(spark, texts), 2).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, 2)
        assert seen["found"] <= n * minhash.BANDS and seen.get("chunk_links", 0) < n
