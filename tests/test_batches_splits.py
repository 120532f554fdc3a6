"""Global row numbers and batches, and the balanced group split, against plain Python."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.operators import balance, batches

ML = "NP_transcript string, position string, phenotype_list string, split string"


def ml_rows(n, seed=1):
    rng = random.Random(seed)
    parts = rng.choices(["train", "val", "test"], [7, 2, 1], k=n)
    return [(f"NP_{i % 37}", str(i), None if i % 50 == 0 else "p", s) for i, s in enumerate(parts)]


def test_numbers_follow_the_order(spark):
    values = random.Random(2).sample(range(10_000), 3_000) + [None]
    df = spark.createDataFrame([(v, "x") for v in values], "v int, row_number_ string").repartition(13)
    got = batches.number_rows(df, ["v"]).collect()
    want = sorted(values, key=lambda v: (v is not None, v or 0))
    assert [r["v"] for r in sorted(got, key=lambda r: r["row_number"])] == want
    assert sorted(r["row_number"] for r in got) == list(range(3_001))
    assert batches.number_rows(df.limit(0), ["v"]).collect() == []


def test_no_global_sort_in_one_task(spark):
    df = spark.range(1_000).withColumn("v", F.rand(1))
    plan = batches.number_rows(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "rangepartitioning" not in plan  # the sorted rows were written once
    assert plan.count("SinglePartition") <= 1  # the prefix sums of the partitions' counts


def test_every_batch_but_the_last_is_full(spark):
    rows = ml_rows(2_500)
    df = spark.createDataFrame(rows, ML)
    for width in (3, 11):  # whatever the partitions
        got = batches.assign_batches(df.repartition(width), size=64).collect()
        by = {}
        for r in got:
            by.setdefault((r["split"], r["batch_id"]), []).append(tuple(r)[:4])
        sizes = Counter(s for *_, s in rows)
        for split, n in sizes.items():
            assert [len(by[split, b]) for b in range(-(-n // 64))] == [64] * (n // 64) + ([n % 64] if n % 64 else [])
        batch_of = {tuple(r)[:4]: r["batch_id"] for r in got}
        assert len(batch_of) == len(rows)
        if width == 3:
            first = batch_of
    assert batch_of == first
    other = {tuple(r)[:4]: r["batch_id"] for r in batches.assign_batches(df, size=64, seed=7).collect()}
    assert other != first


def test_batches_without_parts_and_on_the_executors(spark):
    df = spark.createDataFrame(ml_rows(300), ML)
    got = batches.assign_batches(df, size=100, by=())
    assert sorted(Counter(r["batch_id"] for r in got.collect()).items()) == [(0, 100), (1, 100), (2, 100)]
    sizes = batches.map_global_batches(
        got, lambda pdf: pdf.iloc[:1].assign(n=len(pdf))[["batch_id", "n"]], "batch_id long, n long", by=()
    )
    assert sorted(map(tuple, sizes.collect())) == [(0, 100), (1, 100), (2, 100)]


def greedy(groups, ratios):
    """(part per group) one by one, largest first."""
    total = sum(groups)
    short = [Fraction(str(r)) * total for r in ratios]
    out = []
    for n in sorted(groups, reverse=True):
        p = max(range(len(short)), key=lambda q: (short[q], -q))
        short[p] -= n
        out.append((n, p))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=120), st.sampled_from([(0.7, 0.15, 0.15), (0.8, 0.2), (1.0,), (0.25, 0.25, 0.5), (1.0, 0.0)]))
def test_plan_equals_dealing_one_by_one(groups, ratios):
    plan = balance.plan_parts(list(Counter(groups).items()), ratios)
    want = Counter(greedy(groups, ratios))
    assert {(n, p): t for n, taken in plan for p, t in enumerate(taken) if t} == dict(want)


def test_very_many_groups_of_one_size_are_dealt_at_once():
    [(_, taken)] = balance.plan_parts([(1, 10**12)], (0.7, 0.15, 0.15))
    assert taken == [7 * 10**11, 15 * 10**10, 15 * 10**10]


def test_proteins_stay_whole_and_parts_are_close(spark):
    rng = random.Random(5)
    sizes = [900, 500] + [rng.randrange(1, 60) for _ in range(150)]
    rows = [(f"NP_{g}" if g else None, str(i), "p", "x") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, ML).drop("split").repartition(7)
    out = balance.assign_balanced(df)
    assert out.columns == [*df.columns, "split"]
    got = out.collect()
    assert len(got) == len(rows)
    part_of = {}
    for r in got:
        assert part_of.setdefault(r["NP_transcript"], r["split"]) == r["split"]
    n = Counter(r["split"] for r in got)
    for name, ratio in zip(("train", "val", "test"), (0.7, 0.15, 0.15)):
        assert abs(n[name] - ratio * len(rows)) <= max(sizes)
    spread = [s for s in sizes if s < 500]
    small = spark.createDataFrame([(f"NP_{g}", str(i), "p") for g, s in enumerate(spread) for i in range(s)], "NP_transcript string, position string, phenotype_list string")
    n = Counter(r["split"] for r in balance.assign_balanced(small).collect())
    assert all(abs(n[p] - r * sum(spread)) <= max(spread) for p, r in zip(("train", "val", "test"), (0.7, 0.15, 0.15)))
    again = {r["NP_transcript"]: r["split"] for r in balance.assign_balanced(df.repartition(3)).collect()}
    assert again == part_of
    with pytest.raises(ValueError, match="add up"):
        balance.assign_balanced(df, ratios=(0.5, 0.2, 0.2))
    assert balance.assign_balanced(df.limit(0)).collect() == []
