"""Counts in passing, ids before the dedupe, published versions, bucketed tables."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from varloom.operators.counts import PassCounts
from varloom.plans import cli, jobs, layout, publish, sinks
from varloom.plans import queries as q
from varloom.session import shared_path


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_need_no_second_scan(spark):
    full, counts = jobs.counted_full_variation_frame(
        q._fx(spark, SF_SMALL, "fx_variant_summary"), q._ids(spark, SF_SMALL), q._tmap(spark, SF_SMALL), q._sequences(spark, SF_SMALL)
    )
    plain = jobs.full_variation_frame(
        q._features(spark, SF_SMALL), q._ids(spark, SF_SMALL), q._tmap(spark, SF_SMALL), q._sequences(spark, SF_SMALL)
    )
    assert plan_of(full).count("FileScan parquet") == plan_of(plain).count("FileScan parquet") == 4
    path = shared_path(spark, "counted")
    written = sinks.write_parquet(full, path)
    got = counts.values()
    assert got["written_rows"] == written == plain.count()
    assert got["unmapped_variants"] + got["no_transcript"] == q.unmapped_variants(spark, SF_SMALL).count()
    assert sorted(map(repr, spark.read.parquet(path).collect())) == sorted(map(repr, plain.collect()))


def test_a_counter_is_named_once(spark):
    counts = PassCounts()
    counts.mark(spark.range(3), "n")
    with pytest.raises(ValueError, match="counted twice"):
        counts.mark(spark.range(3), "n")


def test_ids_come_before_the_dedupe(spark):
    summary, ids = q._fx(spark, SF_SMALL, "fx_variant_summary"), q._ids(spark, SF_SMALL)
    early = jobs.missense_features_frame(summary, ids)
    late = q._missense_variants(spark, SF_SMALL)
    assert sorted(map(repr, early.collect())) == sorted(map(repr, late.select(*early.columns).collect()))
    plan = plan_of(jobs.missense_features_frame(summary, ids))
    assert plan.index("SortAggregate(") < plan.index("LeftSemi")  # the join stands below the dedupe: it runs first


def test_large_id_tables_filter_before_the_shuffle(spark):
    """Above the broadcast threshold Spark's Bloom filter of the ids stands in front of the summary's exchange."""
    path = shared_path(spark, "bloom")
    q._fx(spark, SF_SMALL, "fx_variant_summary").write.parquet(f"{path}/summary")
    q._ids(spark, SF_SMALL).write.parquet(f"{path}/ids")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    }
    with sinks.session_conf(spark, settings):
        ids = spark.read.parquet(f"{path}/ids").filter("VariationID > '1'")
        out = jobs.missense_features_frame(spark.read.parquet(f"{path}/summary"), ids)
        plan = plan_of(out)
        assert "might_contain" in plan and "bloom_filter_agg" in plan
        n = out.count()
    assert n == q._missense_variants(spark, SF_SMALL).filter("VariationID > '1'").count()


def test_a_failed_run_leaves_the_old_one_readable(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "in")
    q.text.write_tsv(q._fx(spark, SF_SMALL, "fx_variant_summary"), f"{src}/vs")
    q._write_vcf(spark, q._fx(spark, SF_SMALL, "fx_vcf"), f"{src}/vcf")
    q.text.write_tsv(q._fx(spark, SF_SMALL, "fx_gene2accession"), f"{src}/g2a")
    q._write_fasta(q._fx(spark, SF_SMALL, "fx_protein"), f"{src}/fasta")
    root = str(tmp_path / "out")

    def run():
        return jobs.run_etl(spark, f"{src}/vs", f"{src}/vcf", f"{src}/g2a", f"{src}/fasta", root,
                            join_sequences=True, rejected=True, counts=True, versioned=True)

    paths = run()
    assert publish.versions(spark, root) == [1]
    before = publish.manifest(spark, root)
    assert before["tables"] == paths and set(paths) == {
        "missense_ids", "transcript_map", "protein_sequences", "full_variation", "run_counts", "rejected"
    }
    rows = spark.read.parquet(publish.resolve(spark, f"{root}#full_variation")).count()
    counts = dict(map(tuple, spark.read.parquet(paths["run_counts"]).collect()))
    assert counts["written_rows"] == rows and spark.read.parquet(paths["rejected"]).count() == 0

    real = sinks.write_parquet

    def failing(df, path, **options):
        if path.endswith("full_variation.parquet"):
            raise OSError("injected after three tables")
        return real(df, path, **options)

    monkeypatch.setattr(sinks, "write_parquet", failing)
    with pytest.raises(OSError, match="injected"):
        run()
    monkeypatch.undo()
    assert publish.manifest(spark, root) == before
    assert spark.read.parquet(publish.resolve(spark, f"{root}#full_variation")).count() == rows
    run()
    assert publish.versions(spark, root) == [1, 2]
    gone = publish.expire(spark, root, keep=1)
    assert len(gone) == 2 and publish.versions(spark, root) == [2]
    assert spark.read.parquet(publish.table_path(spark, root, "full_variation")).count() == rows


def test_publishing_needs_complete_tables(spark, tmp_path):
    root = str(tmp_path)
    assert publish.manifest(spark, root) is None and publish.resolve(spark, "/a/b") == "/a/b"
    run, folder = publish.begin(root)
    with pytest.raises(FileNotFoundError, match="not complete"):
        publish.publish(spark, root, run, {"t": f"{folder}/t"})
    with pytest.raises(LookupError):
        publish.table_path(spark, root, "t")
    with pytest.raises(ValueError):
        publish.expire(spark, root, keep=0)


def test_buckets_save_exchanges(spark):
    full, seqs = q._full(spark, SF_SMALL), q._sequences(spark, SF_SMALL)
    plain_full, plain_seqs = (shared_path(spark, n) for n in ("pf", "ps"))
    full.write.parquet(plain_full)
    seqs.write.parquet(plain_seqs)
    bucketed = [
        layout.write_bucketed(df, f"varloom_test_{n}", shared_path(spark, n), key, 4)
        for df, n, key in ((full, "full", layout.PROTEIN), (seqs, "seqs", layout.SEQUENCE_ID))
    ]
    plain = [spark.read.parquet(p) for p in (plain_full, plain_seqs)]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", **layout.BUCKET_CONF}
    try:
        with sinks.session_conf(spark, settings):
            counts, rows = {}, {}
            for name, (f, s) in (("plain", plain), ("bucketed", bucketed)):
                joined = layout.sequenced(f, s)
                context = layout.context_rows(joined)
                counts[name] = [plan_of(df).count("Exchange hashpartitioning") for df in (joined, context)]
                rows[name] = sorted(map(repr, context.select(*sorted(context.columns)).collect()))
        assert counts["bucketed"] == [0, 0] and counts["plain"][0] == 2 and counts["plain"][1] >= 4
        assert rows["bucketed"] == rows["plain"] and rows["plain"]
    finally:
        for n in ("full", "seqs"):
            spark.sql(f"DROP TABLE varloom_test_{n}")


def test_cli_knows_the_new_flags():
    args = cli._parser().parse_args(
        "etl --variant-summary a --vcf b --gene2accession c --fasta d --out-dir e --rejected --counts --versioned".split()
    )
    assert args.rejected and args.counts and args.versioned
    args = cli._parser().parse_args("fit --ml-table r#ml --out o --model perceptron --halving".split())
    assert args.halving and args.epochs is None
