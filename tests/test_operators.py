"""Operators against brute-force Python on small inputs, plus property tests."""

import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.functions.amino import one_letter
from varloom.functions.vectors import context_dense, hot_positions, mutation_dense
from varloom.operators.context import context_positions
from varloom.operators.dedupe import keep_first
from varloom.operators.phenotypes import dedupe_phenotype_rows, phenotype_rows
from varloom.operators.split import assign_split, check_ratios
from varloom.operators.variation import attach_sequences

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_one_letter_codes_pass_unknown_through(spark):
    df = spark.createDataFrame([("Ala",), ("Ter",), ("",), (None,), ("Glx",)], "c string")
    got = [r[0] for r in df.select(one_letter(F.col("c"))).collect()]
    assert got == ["A", "Ter", "", None, "Z"]


def test_keep_first_is_total_order_and_partition_independent(spark):
    rows = [("k1", "b", 1), ("k1", "a", 2), ("k1", "a", 1), ("k2", None, 5), ("k2", "z", 0), (None, "x", 1), (None, "w", 9)]
    df = spark.createDataFrame(rows, "k string, a string, b int")
    expected = {("k1", "a", 1), ("k2", None, 5), (None, "w", 9)}
    for parts in (1, 3, 7):
        got = set(map(tuple, keep_first(df.repartition(parts), ["k"], ["a", "b"]).collect()))
        assert got == expected


def _full_rows(spark, rows):
    return spark.createDataFrame(
        rows, "name string, NP_transcript string, position string, phenotype_list string, is_pathogenic int"
    )


def test_phenotype_rows_rules(spark):
    full = _full_rows(spark, [
        ("a", "NP1", "5", "P1|not specified|P2", 1),
        ("b", "NP1", "6", None, 1),            # null list: no row
        ("c", "NP1", "7", "", 0),              # empty list: one empty phenotype
        ("d", "NP1", "", "P1", 0),             # empty position: dropped, no error
        ("e", "NP1", "0", "P1", 0),            # position 0: dropped
        ("f", "NP1", "2049", "P1", 0),         # beyond vector width: dropped
        ("g", "NP1", "2048", "not provided", 0),
        ("h", "NP1", "2048", "Not Provided", 0),  # exact, case-sensitive match
    ])
    got = sorted((r["name"], r["phenotype_list"]) for r in phenotype_rows(full).collect())
    assert got == [("a", "P1"), ("a", "P2"), ("c", ""), ("h", "Not Provided")]


def test_phenotype_dedupe_tie_break(spark):
    full = _full_rows(spark, [
        ("z", "NP1", "5", "P1", 1),
        ("a", "NP1", "5", "P1|P2", 0),
        ("a", "NP1", "5", "P1", 1),
    ])
    got = sorted(map(tuple, dedupe_phenotype_rows(phenotype_rows(full)).collect()))
    assert got == [("a", "NP1", "5", "P1", 0), ("a", "NP1", "5", "P2", 0)]


def test_split_ratio_check():
    check_ratios([0.7, 0.15, 0.15])
    try:
        check_ratios([0.7, 0.2, 0.15])
    except ValueError:
        pass
    else:
        raise AssertionError("ratios not summing to 1 must fail")


def test_split_disjoint_complete_stable(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", f"NP{rng.randint(0, 40)}", str(i), f"P{rng.randint(0, 5)}", rng.randint(0, 1)) for i in range(3000)]
    df = _full_rows(spark, rows)
    a = {r["position"]: r["split"] for r in assign_split(df.repartition(2)).collect()}
    b = {r["position"]: r["split"] for r in assign_split(df.repartition(5)).collect()}
    assert a == b and len(a) == 3000
    counts = {s: sum(1 for v in a.values() if v == s) for s in ("train", "val", "test")}
    assert abs(counts["train"] / 3000 - 0.70) < 0.04
    assert abs(counts["val"] / 3000 - 0.15) < 0.03
    by_protein = assign_split(df, key="protein").groupBy("NP_transcript").agg(F.countDistinct("split").alias("k"))
    assert by_protein.filter("k > 1").count() == 0
    exploded = _full_rows(spark, [(f"n{i}", f"NP{i % 50}", str(i % 97), f"P{j}", 1) for i in range(500) for j in range(3)])
    by_variant = assign_split(exploded, key="variant").groupBy("NP_transcript", "position").agg(
        F.countDistinct("split").alias("k"))
    assert by_variant.filter("k > 1").count() == 0


def _brute_context(rows, scope):
    out = {}
    for i, (name, np_, pos, ph, y, part) in enumerate(rows):
        ctx = set()
        for j, (_, np2, pos2, ph2, y2, part2) in enumerate(rows):
            if j == i or np2 != np_ or ph2 != ph or y2 != 1:
                continue
            if scope == "within_split" and part2 != part:
                continue
            if scope == "from_train" and part2 != "train":
                continue
            ctx.add(int(pos2))
        out[(np_, pos, ph)] = sorted(ctx)
    return out


row_strategy = st.lists(
    st.tuples(
        st.sampled_from(["NP1", "NP2", "NP3"]),
        st.integers(min_value=1, max_value=30),
        st.sampled_from(["P1", "P2"]),
        st.integers(min_value=0, max_value=1),
        st.sampled_from(["train", "val", "test"]),
    ),
    min_size=1,
    max_size=60,
)


@SETTINGS
@given(row_strategy, st.sampled_from(["within_split", "from_train"]))
def test_context_matches_brute_force(spark, raw, scope):
    seen, rows = set(), []
    for np_, pos, ph, y, part in raw:
        if (np_, pos, ph) in seen:
            continue
        seen.add((np_, pos, ph))
        rows.append((f"v{len(rows)}", np_, str(pos), ph, y, part))
    df = spark.createDataFrame(
        rows, "name string, NP_transcript string, position string, phenotype_list string, is_pathogenic int, split string"
    )
    got = {(r["NP_transcript"], r["position"], r["phenotype_list"]): list(r["context_positions"])
           for r in context_positions(df.repartition(3), scope=scope).collect()}
    assert got == _brute_context(rows, scope)


def test_context_excludes_own_position_only(spark):
    rows = [("a", "NP1", "10", "P", 1, "train"), ("b", "NP1", "010", "P", 1, "train"), ("c", "NP1", "3", "P", 1, "train")]
    df = spark.createDataFrame(
        rows, "name string, NP_transcript string, position string, phenotype_list string, is_pathogenic int, split string"
    )
    got = {r["name"]: list(r["context_positions"]) for r in context_positions(df).collect()}
    # "10" and "010" are different rows at the same index: each sees the other.
    assert got == {"a": [3, 10], "b": [3, 10], "c": [10]}


@SETTINGS
@given(st.sets(st.integers(min_value=1, max_value=64), max_size=20), st.integers(min_value=1, max_value=64))
def test_dense_vectors_match_numpy(spark, positions, pos):
    n = 64
    ctx = sorted(positions)
    df = spark.createDataFrame([(ctx, pos)], "ctx array<int>, pos int")
    row = df.select(
        context_dense(F.col("ctx"), n).alias("c"),
        mutation_dense(F.col("pos"), n).alias("m"),
        hot_positions(context_dense(F.col("ctx"), n)).alias("h"),
    ).first()
    want_c = np.zeros(n, dtype=int)
    for p in ctx:
        want_c[p - 1] = 1
    want_m = np.zeros(n, dtype=float)
    want_m[pos - 1] = 1.0
    assert list(row["c"]) == want_c.tolist()
    assert list(row["m"]) == want_m.tolist()
    assert list(row["h"]) == ctx


def test_mutated_sequence_differs_at_most_once(spark):
    full = spark.createDataFrame(
        [("n", "NP1", str(p), "P", 1, "M", "W") for p in range(1, 12)],
        "name string, NP_transcript string, position string, phenotype_list string, is_pathogenic int, "
        "REF_amino_acid string, ALT_amino_acid string",
    )
    seqs = spark.createDataFrame([("NP1", "MKTAYIAKQR")], "id string, sequence string")
    for r in attach_sequences(full, seqs).collect():
        seq, mut, p = r["sequence"], r["mutated_sequence"], int(r["position"])
        if p <= len(seq):
            assert len(mut) == len(seq)
            assert sum(a != b for a, b in zip(seq, mut)) <= 1
            assert mut[p - 1] == "W"
            assert r["ref_matches"] == (seq[p - 1] == "M")
        else:
            assert mut == seq + "W" and r["ref_matches"] is False


def test_transcript_match_exact_or_ignoring_version(spark):
    from varloom.operators.mapping import map_to_proteins, unmapped_variants

    variants = spark.createDataFrame([("1", "NM_1.2"), ("2", "NM_2.1"), ("3", None)], "VariationID string, transcription string")
    tmap = spark.createDataFrame([("NM_1.3", "NP_1.1"), ("NM_1.4", "NP_1.1"), ("NM_2.1", "NP_2.1")],
                                 "NM_transcript string, NP_transcript string")
    exact = sorted(r["VariationID"] for r in map_to_proteins(variants, tmap).collect())
    loose = sorted(r["VariationID"] for r in map_to_proteins(variants, tmap, ignore_version=True).collect())
    assert exact == ["2"] and loose == ["1", "2"]
    assert sorted(r["VariationID"] for r in unmapped_variants(variants, tmap).collect()) == ["1", "3"]


def test_context_with_many_spellings_of_one_position(spark):
    spellings = ["7", "07", "007", "0007"]
    rows = [(f"r{i}", "NP1", p, "P", 1, "train") for i, p in enumerate(spellings)] + [("x", "NP1", "3", "P", 1, "train")]
    df = spark.createDataFrame(
        rows, "name string, NP_transcript string, position string, phenotype_list string, is_pathogenic int, split string"
    )
    for partitions in (None, 3):
        got = {r["position"]: list(r["context_positions"]) for r in context_positions(df, partitions=partitions).collect()}
        assert got == {**{p: [3, 7] for p in spellings}, "3": [7]}
