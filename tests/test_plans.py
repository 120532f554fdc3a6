"""Plan shape: no Python evaluation nodes, semi join, pruned scans, map-side dedupe."""

import pytest

from conftest import SF_SMALL
from varloom.plans import queries as q

JOB_QUERIES = ["variant_features", "missense_ids", "transcript_map", "full_variation_sequences",
               "phenotype_dedupe", "split_assign", "context_within_split", "mutation_vector", "context_vector",
               "model_report"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOB_QUERIES)
def test_no_python_nodes(spark, name):
    plan = _plan(q.QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan, name


def test_semi_join_for_missense_restriction(spark):
    plan = _plan(q.missense_variants(spark, SF_SMALL))
    assert "LeftSemi" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(q.missense_ids(spark, SF_SMALL))
    # the VCF relation needs four lineitem columns, not all eleven
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plan


def test_dedupe_combines_before_shuffle(spark):
    plan = _plan(q.variant_features(spark, SF_SMALL))
    assert "partial_min" in plan


def test_split_filter_prunes_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    from varloom.plans import jobs, sinks

    path = str(tmp_path / "ml")
    sinks.write_ml_table(jobs.ml_frame(q._full(spark, SF_SMALL)), path, dense=False)
    df = spark.read.parquet(path).filter(F.col("split") == "test").select("name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan


def test_semi_join_reuses_dedupe_partitioning(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        plan = q.missense_variants(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    lines = plan.split("\n")
    semi = next(i for i, l in enumerate(lines) if "LeftSemi" in l)
    # the first operator under the left child is the dedupe aggregate, not a new exchange
    left = [l for l in lines[semi + 1: semi + 6] if l.strip()]
    assert "SortAggregate" in " ".join(left[:3]) and "Exchange" not in " ".join(left[:2])


def test_ml_context_and_dense_sink_share_one_partitioning(spark):
    from varloom.operators.context import context_positions
    from varloom.plans import jobs, sinks
    from varloom.session import stage

    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        parts = stage(jobs.ml_parts(q._full(spark, SF_SMALL)), "plan_test_rows")
        df = sinks.with_dense_vectors(context_positions(parts, partitions=3))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # the rows and their pathogenic subset are each shuffled once; nothing else
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_names_without_a_transcript_are_dropped_before_the_shuffle(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        plan = _plan(q.mapped_variants(spark, SF_SMALL))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    lines = plan.split("\n")
    at = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning(transcription" in l)
    assert any("Filter" in l and ", 1) = ))" in l for l in lines[at : at + 8])


def test_inputs_are_not_shuffled_to_spread_them(spark):
    assert "REPARTITION_BY_NUM" not in _plan(q.variant_features(spark, SF_SMALL))


def test_search_reads_the_validation_rows_once(spark):
    from varloom.operators import fit
    from varloom.plans import jobs
    from varloom.session import stage

    rows = stage(fit.with_features(jobs.ml_frame(q._full(spark, SF_SMALL))), "plan_features")
    for trials in (1, 4):
        fitted = {i: fit.logistic(max_iter=1).fit(rows) for i in range(trials)}
        scored = fit.validation_scores(fitted, rows.filter("split = 'val'"))
        assert _plan(fit.report(scored, by=["trial"])).count("FileScan") == 1
