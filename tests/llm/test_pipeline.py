"""The pipeline stage by stage, and the queries against DuckDB."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from varloom.llm import decontam
from varloom.llm.common import Scratch, table
from varloom.llm.oracle import ORACLE

from .test_dedup import brute_components, brute_lines
from .test_others import brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "t"), table(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        done = scratch.stage(stage(spark, docs, SF), name)
        out.append((name, docs, done))
        docs = done
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        if name != "mixing":
            assert after.columns == before.columns


def test_clean_documents_stay(spark, stages):
    before, after = stages["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    gone = set(texts(before)) - set(texts(after))
    clean = [d for d, t in labels.items() if t == 0]
    assert len(gone & set(clean)) <= 0.1 * len(clean)
    assert all(texts(after)[d] == texts(before)[d] for d in texts(after))


def test_line_stage(stages):
    before, after = map(texts, stages["line_dedup"])
    ids = sorted(before)
    want = dict(zip(ids, brute_lines([before[i] for i in ids], 1)))
    assert after == {i: t for i, t in want.items() if t == before[i] or (t or "").strip(" ")}


def test_near_stage(stages):
    before, after = map(texts, stages["near_duplicates"])
    ids = sorted(before)
    want = brute_components([before[i] for i in ids], 5)
    assert sorted(after) == [ids[i] for i, (_, root) in want.items() if i == root]


def test_benchmark_stage(spark, stages):
    before, after = map(texts, stages["decontamination"])
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for i, text in before.items():
        n, hit, _ = brute_hits(text, items)
        if not hit:
            assert after[i] == text
        elif hit >= decontam.MAX_COVERAGE * n:
            assert i not in after
        else:
            assert brute_hits(after[i], items)[1] == 0


def test_mix_stage(stages):
    before, after = stages["mixing"]
    assert after.count() == before.count()
    rows = after.filter("size > 0").groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("g"), F.min("size").alias("least"), F.count("*").alias("n")
    ).collect()
    # A source of few documents can miss its target by less than its smallest one.
    assert all(abs(r["t"] - r["g"]) <= max(60, r["least"]) for r in rows), rows


def test_run_gives_the_last_stage(spark, stages):
    got = cp.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["mixing"][1].collect()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, name):
    from tools.check_oracle import compare

    assert compare(spark, SF, [name], verbose=True) == []
