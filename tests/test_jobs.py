"""End-to-end: the four input files → published tables, and sink round trips."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from varloom.plans import jobs, queries as q
from varloom.sources import text


def _inputs(spark, tmp_path):
    d = str(tmp_path)
    text.write_tsv(q._fx(spark, SF_SMALL, "fx_variant_summary"), f"{d}/variant_summary")
    q._write_vcf(spark, q._fx(spark, SF_SMALL, "fx_vcf"), f"{d}/variants_vcf")
    text.write_tsv(q._fx(spark, SF_SMALL, "fx_gene2accession"), f"{d}/gene2accession")
    q._write_fasta(q._fx(spark, SF_SMALL, "fx_protein"), f"{d}/protein_faa")
    return d


def test_run_etl_matches_in_memory_composition(spark, tmp_path):
    d = _inputs(spark, tmp_path)
    paths = jobs.run_etl(
        spark, f"{d}/variant_summary", f"{d}/variants_vcf", f"{d}/gene2accession", f"{d}/protein_faa",
        f"{d}/out", join_sequences=True, prepare_ml=True,
    )
    full = spark.read.parquet(paths["full_variation"])
    expected = q.full_variation_sequences(spark, SF_SMALL)
    assert sorted(full.columns) == sorted(expected.columns)
    assert sorted(map(tuple, full.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))

    ml = spark.read.parquet(paths["ml"])
    assert {f.name for f in ml.schema} >= {"mutation_vector", "context_vector", "split", "is_pathogenic"}
    widths = ml.select(F.size("mutation_vector").alias("m"), F.size("context_vector").alias("c")).distinct().collect()
    assert [(r["m"], r["c"]) for r in widths] == [(2048, 2048)]
    assert ml.filter(F.aggregate("mutation_vector", F.lit(0.0), lambda a, x: a + x) != 1.0).count() == 0


def test_empty_inputs_still_write_tables(spark, tmp_path):
    d = str(tmp_path)
    for name, content in {
        "vs.tsv": "Name\tVariationID\tGeneSymbol\tClinSigSimple\tPhenotypeIDS\tPhenotypeList\tReviewStatus\tType\tAssembly\tClinicalSignificance\n",
        "a.vcf": "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n",
        "g.tsv": "status\tRNA_nucleotide_accession.version\tprotein_accession.version\n",
        "p.faa": "",
    }.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(content)
    paths = jobs.run_etl(spark, f"{d}/vs.tsv", f"{d}/a.vcf", f"{d}/g.tsv", f"{d}/p.faa", f"{d}/out",
                         join_sequences=True, prepare_ml=True)
    for key in ("missense_ids", "transcript_map", "protein_sequences", "full_variation", "ml"):
        assert spark.read.parquet(paths[key]).count() == 0
    assert {"split", "mutation_vector", "context_vector"} <= set(spark.read.parquet(paths["ml"]).columns)


def test_model_side_names(spark):
    from varloom.plans.sinks import model_side_names, pad_vector

    df = spark.createDataFrame([([1.0, 0.0], [0, 1], 1)], "mutation_vector array<float>, context_vector array<int>, is_pathogenic int")
    out = model_side_names(df).withColumn("POS_vector", pad_vector("POS_vector", 4, "float"))
    row = out.first()
    assert out.columns == ["POS_vector", "Patho_Vector", "ClinSigSimple"]
    assert list(row["POS_vector"]) == [1.0, 0.0, 0.0, 0.0]


def test_cli_etl_and_score(spark, tmp_path):
    from varloom.plans import cli

    d = _inputs(spark, tmp_path)
    rc = cli.main(["etl", "--variant-summary", f"{d}/variant_summary", "--vcf", f"{d}/variants_vcf",
                   "--gene2accession", f"{d}/gene2accession", "--fasta", f"{d}/protein_faa",
                   "--out-dir", f"{d}/out", "--prepare-ml-dataset", "--sparse", "--context-scope", "from_train"])
    assert rc == 0
    ml = spark.read.parquet(f"{d}/out/ml.parquet")
    assert "context_positions" in ml.columns and ml.count() > 0
    q._fx(spark, SF_SMALL, "fx_scores").write.parquet(f"{d}/scores")
    assert cli.main(["score", "--scores", f"{d}/scores", "--by", "model", "split", "--out", f"{d}/report"]) == 0
    assert spark.read.parquet(f"{d}/report").count() == 12


def test_write_returns_observed_row_count(spark, tmp_path):
    from varloom.plans import sinks

    df = q._fx(spark, SF_SMALL, "fx_gene2accession")
    assert sinks.write_parquet(df, str(tmp_path / "g")) == df.count()


def test_read_features_projects_and_prunes(spark, tmp_path):
    from varloom.plans import sinks
    from varloom.sources.parquet import read_features

    path = str(tmp_path / "ml")
    sinks.write_ml_table(jobs.ml_frame(q._full(spark, SF_SMALL)), path, dense=False)
    df = read_features(spark, path, ["position", "context_positions"], "is_pathogenic", splits=["test"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.columns == ["position", "context_positions", "is_pathogenic"]
    assert "ReadSchema: struct<position:string,is_pathogenic:int,context_positions:array<int>>" in plan
    assert "PartitionFilters: [isnotnull(split" in plan
    assert df.count() == spark.read.parquet(path).filter("split = 'test'").count()


def test_feature_batches_run_on_the_executors_in_fixed_sizes(spark):
    import pandas as pd

    from varloom.sources.parquet import map_feature_batches

    df = spark.range(0, 1000, 1, 2).selectExpr("id", "id % 2 AS label")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = map_feature_batches(
            df, lambda b: pd.DataFrame({"n": [len(b)], "total": [b["label"].sum()]}), "n long, total long", 256
        ).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(r["n"] for r in out) == [244, 244, 256, 256] and sum(r["total"] for r in out) == 500


def test_too_narrow_vectors_raise(spark, tmp_path):
    import pytest

    from varloom.plans import sinks

    df = spark.createDataFrame([([1.0, 0.0],)], "v array<float>")
    assert list(df.select(sinks.pad_vector("v", 3, "float")).first()[0]) == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="longer than 1"):
        df.select(sinks.pad_vector("v", 1, "float")).collect()
    with pytest.raises(ValueError):
        sinks.write_ml_table(jobs.ml_frame(q._full(spark, SF_SMALL)), str(tmp_path / "x"), model_width=10)


def test_score_prints_every_group(spark, tmp_path, capsys):
    from varloom.plans import cli

    rows = [(f"m{i}", "test", 0.5, i % 2) for i in range(60)]
    spark.createDataFrame(rows, "model string, split string, logit double, label int").write.parquet(str(tmp_path / "s"))
    assert cli.main(["score", "--scores", str(tmp_path / "s")]) == 0
    said = capsys.readouterr().out
    assert all(f"m{i}\t" in said for i in range(60))


def test_fit_saves_a_model_that_scores_alike_after_reload(spark, tmp_path):
    from varloom.operators import fit as fit_ops
    from varloom.plans import cli, sinks

    d = str(tmp_path)
    sinks.write_parquet(q._full(spark, SF_SMALL), f"{d}/full")
    assert cli.main(["ml", "--full-variation", f"{d}/full", "--out", f"{d}/ml", "--model-width", "2056"]) == 0
    assert cli.main(["fit", "--ml-table", f"{d}/ml", "--out", f"{d}/search", "--trials", "2", "--model-out", f"{d}/best"]) == 0
    rows = fit_ops.with_features(fit_ops.ml_rows_of(spark.read.parquet(f"{d}/ml")))
    found = jobs.fit_and_select(fit_ops.ml_rows_of(spark.read.parquet(f"{d}/ml")), trials=2)
    again = fit_ops.load_model(spark, f"{d}/best")
    pick = lambda m: sorted(map(tuple, fit_ops.logits(m, rows).select("NP_transcript", "position", "phenotype_list", "logit").collect()))
    fit_ops.save_model(found.model, f"{d}/copy")
    assert pick(fit_ops.load_model(spark, f"{d}/copy")) == pick(found.model)
    assert len(pick(again)) == rows.count()

    assert cli.main(["evaluate", "--ml-table", f"{d}/ml", "--model", f"a={d}/best", f"b={d}/copy",
                     "--out", f"{d}/report", "--scores-out", f"{d}/scores"]) == 0
    report = spark.read.parquet(f"{d}/report").collect()
    assert {(r["model"], r["split"]) for r in report} == {(m, s) for m in "ab" for s in ("train", "val", "test")}
    assert spark.read.parquet(f"{d}/scores").count() == 2 * rows.count()
    one = jobs.score_stored_models(spark, f"{d}/ml", {"a": f"{d}/best"}, splits=["test"])
    assert one.select("split").distinct().collect()[0][0] == "test"


def test_perceptron_reloads(spark, tmp_path):
    from varloom.operators import fit as fit_ops

    rows = fit_ops.with_features(jobs.ml_frame(q._full(spark, SF_SMALL)))
    model = fit_ops.perceptron(hidden=(4,), max_iter=2).fit(rows)
    fit_ops.save_model(model, str(tmp_path / "m"))
    a, b = (fit_ops.logits(m, rows).select("logit").limit(50).collect() for m in (model, fit_ops.load_model(spark, str(tmp_path / "m"))))
    assert a == b


def test_null_labels_are_left_out_and_counted(spark):
    from varloom.operators import fit as fit_ops

    rows = spark.createDataFrame([("5", [1, 2], 1), ("6", [1], None)], "position string, context_positions array<int>, is_pathogenic int")
    assert fit_ops.with_features(rows).count() == 1 and fit_ops.unlabelled(rows) == 1


def test_sequences_of_an_earlier_run_are_reused(spark, tmp_path):
    d = _inputs(spark, tmp_path)
    base = (f"{d}/variant_summary", f"{d}/variants_vcf", f"{d}/gene2accession")
    first = jobs.run_etl(spark, *base, f"{d}/protein_faa", f"{d}/one", join_sequences=True)
    second = jobs.run_etl(spark, *base, None, f"{d}/two", join_sequences=True, sequences_path=first["protein_sequences"],
                          prepare_ml=True, n=64, condition={"significances": ["Pathogenic"]})
    a, b = (spark.read.parquet(p["full_variation"]) for p in (first, second))
    assert 0 < b.count() < a.count() and b.filter("sequence IS NULL").count() == 0
    assert spark.read.parquet(second["ml"]).select(F.size("mutation_vector")).distinct().collect()[0][0] == 64


def test_dense_table_reads_back_in_spark_and_arrow(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from varloom.plans import sinks

    rows = jobs.ml_frame(q._full(spark, SF_SMALL))
    path = str(tmp_path / "dense")
    sinks.write_ml_table(rows, path)
    assert spark.conf.get("spark.sql.parquet.writeLegacyFormat", "false") == "false"  # restored
    back = spark.read.parquet(path)
    got = {(r["NP_transcript"], r["position"], r["phenotype_list"]): (list(r["mutation_vector"]), list(r["context_vector"]))
           for r in back.collect()}
    for r in rows.collect():
        m, c = got[(r["NP_transcript"], r["position"], r["phenotype_list"])]
        assert m.index(1.0) == int(r["position"]) - 1 and sum(m) == 1.0
        assert [i + 1 for i, v in enumerate(c) if v] == list(r["context_positions"])
    table = pq.read_table(glob.glob(f"{path}/split=train/*.parquet")[0])
    assert len(table.column("mutation_vector")[0]) == 2048


def test_cli_ml_and_fit(spark, tmp_path):
    from varloom.plans import cli, sinks

    d = str(tmp_path)
    sinks.write_parquet(q._full(spark, SF_SMALL), f"{d}/full")
    assert cli.main(["ml", "--full-variation", f"{d}/full", "--out", f"{d}/ml", "--sparse"]) == 0
    assert cli.main(["fit", "--ml-table", f"{d}/ml", "--out", f"{d}/search", "--trials", "2"]) == 0
    out = spark.read.parquet(f"{d}/search").collect()
    assert len(out) == 2 and sum(r["is_best"] for r in out) == 1
    # the dense table gives the same search result
    assert cli.main(["ml", "--full-variation", f"{d}/full", "--out", f"{d}/ml_dense"]) == 0
    assert cli.main(["fit", "--ml-table", f"{d}/ml_dense", "--out", f"{d}/search_dense", "--trials", "2"]) == 0
    dense = spark.read.parquet(f"{d}/search_dense").collect()
    key = lambda r: (r["trial"], r["n"], r["n_correct"])
    assert sorted(map(key, dense)) == sorted(map(key, out))


def test_model_side_table_for_model_scripts(spark, tmp_path):
    from varloom.plans import cli, sinks

    d = str(tmp_path)
    sinks.write_parquet(q._full(spark, SF_SMALL), f"{d}/full")
    assert cli.main(["ml", "--full-variation", f"{d}/full", "--out", f"{d}/ml", "--model-width", "2056"]) == 0
    ml = spark.read.parquet(f"{d}/ml")
    assert {"POS_vector", "Patho_Vector", "ClinSigSimple"} <= set(ml.columns)
    widths = ml.select(F.size("POS_vector").alias("a"), F.size("Patho_Vector").alias("b")).distinct().collect()
    assert [(r["a"], r["b"]) for r in widths] == [(2056, 2056)]


def test_cli_ignore_version_maps_at_least_the_exact_matches(spark, tmp_path):
    from varloom.plans import cli

    d = _inputs(spark, tmp_path)
    base = ["etl", "--variant-summary", f"{d}/variant_summary", "--vcf", f"{d}/variants_vcf",
            "--gene2accession", f"{d}/gene2accession", "--fasta", f"{d}/protein_faa"]
    assert cli.main(base + ["--out-dir", f"{d}/exact"]) == 0
    assert cli.main(base + ["--out-dir", f"{d}/loose", "--ignore-version"]) == 0
    exact = spark.read.parquet(f"{d}/exact/full_variation.parquet")
    loose = spark.read.parquet(f"{d}/loose/full_variation.parquet")
    assert exact.exceptAll(loose).count() == 0
    assert loose.count() >= exact.count() > 0
    # each variant maps to each protein at most once (full_variation has no id, so check the mapped rows)
    mapped = jobs.mapped_variants_frame(
        q._features(spark, SF_SMALL), q._ids(spark, SF_SMALL), q._tmap(spark, SF_SMALL), ignore_version=True
    )
    assert mapped.count() == mapped.select("VariationID", "NP_transcript").distinct().count()


def test_cli_etl_publishes_model_side_table(spark, tmp_path):
    from varloom.plans import cli

    d = _inputs(spark, tmp_path)
    assert cli.main(["etl", "--variant-summary", f"{d}/variant_summary", "--vcf", f"{d}/variants_vcf",
                     "--gene2accession", f"{d}/gene2accession", "--fasta", f"{d}/protein_faa",
                     "--out-dir", f"{d}/out", "--prepare-ml-dataset", "--model-width", "2056"]) == 0
    ml = spark.read.parquet(f"{d}/out/ml.parquet")
    assert {"POS_vector", "Patho_Vector", "ClinSigSimple", "split"} <= set(ml.columns) and ml.count() > 0
