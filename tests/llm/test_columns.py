"""Extra columns named like what the operators compute or work with: values unchanged, or a clear error."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import corpus, documents
from varloom.llm import decontam, lines, minhash, quality, substrings, toxicity
from varloom.llm.common import text_slices

OWN = ("score", "hits", "kept", "gone_id", "n_lines", "n_removed", "n_links", "n_bytes", "n_spans", "spans", "id", "key", "n", "size")


def wide(spark, texts=None):
    df = documents(spark, corpus(3, 12) if texts is None else texts)
    for name in OWN:
        df = df.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    return df


def check(df, out, at_most=None):
    """Same columns, and each row's extra values still its own."""
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[name] == f"{name} of {r['doc_id']}" for r in rows for name in OWN)
    return rows


def test_filters_pass_every_column(spark):
    df = wide(spark)
    bench = spark.createDataFrame([(1, "alpha beta gamma nothing like it")], "item_id long, text string")
    check(df, decontam.decontaminate(df, bench))
    check(df, lines.drop_repeated_lines(df))
    check(df, minhash.drop_near_duplicates(df))


def test_toxicity_stage_passes_every_column(spark, tmp_path):
    df = wide(spark)
    where = str(tmp_path / "sf")
    df.select("doc_id", "text").write.parquet(f"{where}/documents.parquet")
    spark.range(5, 40).selectExpr("id AS doc_id", "0 AS quality", "CAST(id % 5 = 0 AS INT) AS toxic").write.parquet(f"{where}/labels.parquet")
    rows = check(df, corpus_pipeline.reject_toxic(spark, df, where))
    assert len(rows) > 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_take_another_name(spark, module):
    df = wide(spark)
    model = module.fit({1: ["good text " + str(i) for i in range(6)], 0: ["bad stuff " + str(i) for i in range(6)]})
    with pytest.raises(ValueError, match="column 'score' already"):
        module.score_documents(df, model)
    out = module.score_documents(df, model, "own_score")
    assert out.columns == [*df.columns, "own_score"]
    assert all(0 <= r["own_score"] <= 1 and r["score"] == f"score of {r['doc_id']}" for r in out.collect())


def test_added_columns_that_exist_are_an_error(spark):
    df = wide(spark)
    bench = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    for call, name in (
        (lambda: substrings.remove_repeats(df), "kept"), (lambda: lines.dedup_lines(df), "n_lines"),
        (lambda: decontam.find_hits(df, bench), "hits"), (lambda: lines.dedup_lines(df.drop("n_lines", "N_REMOVED"))  , "n_links"),
    ):
        with pytest.raises(ValueError, match=f"column '{name}' already"):
            call()
    assert decontam.find_hits(df, bench, column="own").columns == [*df.columns, "own"]
    named = lines.dedup_lines(df, names=("a", "b", "c"))
    assert named.columns == [*df.columns, "a", "b", "c"]


def test_slices_are_bounded_by_bytes():
    texts = ["x" * n for n in (0, 10, 3, 100, 0, 50, 50, 1)] + [None, "y"]
    batch = pa.record_batch([pa.array(range(10)), pa.array(texts)], names=["i", "text"])
    parts = list(text_slices([batch, batch.slice(0, 0)], 1, 100))
    assert [r for p in parts for r in p.column(1).to_pylist()] == texts
    sizes = [[len(t or "") for t in p.column(1).to_pylist()] for p in parts]
    assert all(sum(s) <= 100 or len(s) == 1 for s in sizes) and len(parts) == 4
