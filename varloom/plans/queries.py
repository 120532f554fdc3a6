"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Inputs are the workload's relations built from the driver's whole tables
(``varloom.sources.fixtures``); every step named by a query runs through the
library's operators. Doubles are rounded to 6 digits only here, for comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.constants import ML_KEY_COLUMNS, MODEL_VECTOR_LENGTH, VCF_COLUMNS
from varloom.functions import vectors
from varloom.functions.hgvs import with_name_parts
from varloom.functions.amino import one_letter
from varloom.functions.sequence import position_index
from varloom.operators import balance, batches, epochs
from varloom.operators import context as ctx_ops
from varloom.operators import fit as fit_ops
from varloom.operators import mapping, metrics, missense, phenotypes, split, variants, variation
from varloom.plans import jobs, layout, publish, sinks
from varloom.session import shared_path, stage
from varloom.sources import blocks, fixtures, text
from varloom.sources.parquet import read_features

# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------


def _fx(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return fixtures.load(spark, sf, name)


def _features(spark, sf):
    return jobs.variant_features_frame(_fx(spark, sf, "fx_variant_summary"))


def _ids(spark, sf):
    return jobs.missense_ids_frame(_fx(spark, sf, "fx_vcf"))


def _tmap(spark, sf):
    return jobs.transcript_map_frame(_fx(spark, sf, "fx_gene2accession"))


def _sequences(spark, sf):
    return jobs.protein_sequences_frame(_fx(spark, sf, "fx_protein"))


def _missense_variants(spark, sf):
    return mapping.restrict_to_ids(_features(spark, sf), _ids(spark, sf))


def _full(spark, sf):
    return jobs.full_variation_frame(_features(spark, sf), _ids(spark, sf), _tmap(spark, sf))


def _ml_rows(spark, sf):
    return phenotypes.ml_rows(_full(spark, sf))


def _split_rows(spark, sf):
    return split.assign_split(_ml_rows(spark, sf))


def _staged_split_rows(spark, sf):
    """Split rows written once, for queries that read them in two branches."""
    return stage(_split_rows(spark, sf), "ml_rows")


def _scored(spark, sf):
    return metrics.score_rows(_fx(spark, sf, "fx_scores"))


PREVIEW_ROWS = 20
BUCKETS = 8


def _r6(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


# ---------------------------------------------------------------------------
# Readers: write the relation as real text, read it back with the reader
# ---------------------------------------------------------------------------


def scan_variant_summary(spark, sf):
    src = _fx(spark, sf, "fx_variant_summary")
    path = shared_path(spark, "variant_summary_tsv")
    text.write_tsv(src, path)
    return jobs.read_variant_summary(spark, path)


def _write_vcf(spark, df: DataFrame, path: str) -> None:
    _vcf_lines(spark, df).write.mode("overwrite").text(path)


def scan_vcf(spark, sf):
    path = shared_path(spark, "vcf")
    _write_vcf(spark, _fx(spark, sf, "fx_vcf"), path)
    return text.read_vcf(spark, path)


def scan_gene2accession(spark, sf):
    path = shared_path(spark, "gene2accession_tsv")
    text.write_tsv(_fx(spark, sf, "fx_gene2accession"), path)
    df = text.read_tsv(spark, path)
    return df.select(
        F.col("`#tax_id`").alias("tax_id"),
        F.col("GeneID").alias("gene_id"),
        F.col("status"),
        F.col("`RNA_nucleotide_accession.version`").alias("rna_accession"),
        F.col("`protein_accession.version`").alias("protein_accession"),
    )


def _vcf_lines(spark, df: DataFrame) -> DataFrame:
    header = spark.createDataFrame([("##fileformat=VCFv4.1",), ("#" + "\t".join(VCF_COLUMNS),)], "value string")
    return header.unionByName(df.select(F.concat_ws("\t", *[F.col(c) for c in VCF_COLUMNS]).alias("value")))


def scan_vcf_blocks(spark, sf):
    """The VCF as block-gzip files, read back by byte ranges."""
    path = shared_path(spark, "vcf_blocks")
    blocks.write_block_lines(_vcf_lines(spark, _fx(spark, sf, "fx_vcf")), path)
    return text.read_vcf_blocks(spark, path)


def scan_variant_summary_orders(spark, sf):
    """The variant summary in files of two column orders, read as one."""
    src = _fx(spark, sf, "fx_variant_summary")
    odd = F.col("VariationID").cast("long") % 2 == 1
    paths = [shared_path(spark, "variant_summary_odd"), shared_path(spark, "variant_summary_even")]
    text.write_tsv(src.filter(odd), paths[0])
    text.write_tsv(src.filter(~odd).select(*reversed(src.columns)), paths[1])
    return jobs.read_variant_summary(spark, paths)


def _damaged_inputs(spark, sf) -> dict[str, text.Checked]:
    """The three inputs with some lines cut short, made longer or without an id, read with their rejected lines."""
    summary, vcf, protein = (_fx(spark, sf, f"fx_{n}") for n in ("variant_summary", "vcf", "protein"))
    paths = {n: shared_path(spark, f"damaged_{n}") for n in ("variant_summary", "vcf", "protein")}

    full = F.concat_ws("\t", *[F.col(f"`{c}`") for c in summary.columns])
    short = F.concat_ws("\t", *[F.col(f"`{c}`") for c in summary.columns[:-3]])
    turn = F.col("VariationID").cast("long") % 17
    line = F.when(turn == 0, short).when(turn == 1, F.concat(full, F.lit("\textra"))).otherwise(full)
    header = "\t".join(summary.columns)
    # One column whose name is the header line: the CSV writer puts it in front of each file's lines.
    one_column = {"header": True, "sep": "\u0001", "quote": "", "escapeQuotes": False}
    summary.select(line.alias(header)).write.mode("overwrite").options(**one_column).csv(paths["variant_summary"])

    fields = [F.col(c) for c in VCF_COLUMNS]
    cut = F.when(F.col("POS").cast("long") % 19 == 0, F.concat_ws("\t", *fields[:5])).otherwise(F.concat_ws("\t", *fields))
    vcf.select(cut.alias("value")).write.mode("overwrite").text(paths["vcf"])

    no_id = F.when(F.length("sequence") % 5 == 0, F.lit("")).otherwise(F.col("id"))
    _write_fasta(protein.withColumn("id", no_id), paths["protein"])
    return {
        "variant_summary": text.checked_tsv(spark, paths["variant_summary"]),
        "vcf": text.checked_vcf(spark, paths["vcf"]),
        "protein": text.checked_fasta(spark, paths["protein"]),
    }


def rejected_rows(spark, sf):
    """Every rejected line of the damaged inputs with its reason (files are named anew each run and left out)."""
    found = _damaged_inputs(spark, sf)
    return _union([c.rejected.select(F.lit(n).alias("input"), "line", "reason") for n, c in found.items()])


def rejected_counts(spark, sf):
    """Per input: rows read (counted in the table the lines came from), kept and rejected."""
    found = _damaged_inputs(spark, sf)
    parts = [
        df.select(F.lit(n).alias("input"), F.lit(kept).alias("kept"), F.lit(1 - kept).alias("rejected"))
        for n, c in found.items()
        for df, kept in ((c.rows, 1), (c.rejected, 0))
    ]
    return _union(parts).groupBy("input").agg(
        F.count(F.lit(1)).alias("n_read"), F.sum("kept").alias("n_kept"), F.sum("rejected").alias("n_rejected")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    record = F.concat(
        F.lit(">"), F.col("id"), F.lit(" "), F.col("description"), F.lit("\n"),
        F.regexp_replace(F.col("sequence"), f"(.{{{width}}})(?!$)", "$1\n"),
    )
    df.select(record.alias("value")).write.mode("overwrite").text(path)


def scan_fasta(spark, sf):
    path = shared_path(spark, "fasta")
    _write_fasta(_fx(spark, sf, "fx_protein"), path)
    return text.read_fasta(spark, path)


def protein_sequences(spark, sf):
    path = shared_path(spark, "fasta")
    _write_fasta(_fx(spark, sf, "fx_protein"), path)
    return jobs.protein_sequences_frame(text.read_fasta(spark, path))


def protein_sequence_count(spark, sf):
    return _sequences(spark, sf).agg(F.count(F.lit(1)).alias("n_sequences"))


# ---------------------------------------------------------------------------
# Variant summary, VCF, mapping
# ---------------------------------------------------------------------------


def variant_filter(spark, sf):
    return variants.filter_variants(_fx(spark, sf, "fx_variant_summary"))


def variant_features(spark, sf):
    return _features(spark, sf)


def hgvs_parts(spark, sf):
    src = _fx(spark, sf, "fx_variant_summary").select("VariationID", "Name")
    return with_name_parts(src, "Name")


def missense_ids(spark, sf):
    return _ids(spark, sf)


def missense_id_counts(spark, sf):
    return missense.id_counts(_ids(spark, sf))


def duplicate_ids(spark, sf):
    return missense.duplicate_keys(_ids(spark, sf), ["VariationID"])


def transcript_map(spark, sf):
    return _tmap(spark, sf)


def missense_variants(spark, sf):
    return _missense_variants(spark, sf)


def mapped_variants(spark, sf):
    return mapping.map_to_proteins(_missense_variants(spark, sf), _tmap(spark, sf))


def unmapped_variants(spark, sf):
    return mapping.unmapped_variants(_missense_variants(spark, sf), _tmap(spark, sf))


def amino_acid_codes(spark, sf):
    feats = _features(spark, sf).select("REF", "ALT").distinct()
    return feats.select(
        "REF", "ALT",
        one_letter(F.col("REF")).alias("REF_amino_acid"),
        one_letter(F.col("ALT")).alias("ALT_amino_acid"),
    )


def full_variation(spark, sf):
    return _full(spark, sf)


def full_variation_sequences(spark, sf):
    return variation.attach_sequences(_full(spark, sf), _sequences(spark, sf))


def unsequenced_variants(spark, sf):
    return variation.unsequenced_variants(_full(spark, sf), _sequences(spark, sf))


# ---------------------------------------------------------------------------
# ML preparation
# ---------------------------------------------------------------------------


def phenotype_rows(spark, sf):
    return phenotypes.phenotype_rows(_full(spark, sf))


def phenotype_dedupe(spark, sf):
    return _ml_rows(spark, sf)


def split_assign(spark, sf):
    return _split_rows(spark, sf)


def split_two_way(spark, sf):
    train = _split_rows(spark, sf).filter(F.col("split") == "train")
    return split.assign_two_way(train)


def shuffled_rows(spark, sf):
    return split.reproducible_shuffle(_ml_rows(spark, sf))


def _context(spark, sf, scope):
    out = ctx_ops.context_positions(_staged_split_rows(spark, sf), scope=scope)
    return out.withColumns(
        {
            "n_context": F.size("context_positions").cast("long"),
            "context_positions": vectors.join_ints(F.col("context_positions")),
        }
    )


def context_within_split(spark, sf):
    return _context(spark, sf, "within_split")


def context_from_train(spark, sf):
    return _context(spark, sf, "from_train")


def _bits(v: F.Column) -> F.Column:
    """A dense 0/1 vector as a string of ``n`` digits (native cast and join)."""
    return F.array_join(v.cast("array<int>").cast("array<string>"), "")


def mutation_vector(spark, sf):
    rows = _ml_rows(spark, sf)
    dense = vectors.mutation_dense(position_index(F.col("position")))
    return rows.select(*ML_KEY_COLUMNS, dense.alias("v")).select(
        *ML_KEY_COLUMNS,
        F.size("v").cast("long").alias("mutation_len"),
        _bits(F.col("v")).alias("mutation_bits"),
    )


def context_vector(spark, sf):
    rows = ctx_ops.context_positions(_staged_split_rows(spark, sf))
    dense = vectors.context_dense(F.col("context_positions"))
    return rows.select(*ML_KEY_COLUMNS, "split", dense.alias("v")).select(
        *ML_KEY_COLUMNS, "split",
        F.size("v").cast("long").alias("context_len"),
        _bits(F.col("v")).alias("context_bits"),
    )


def ml_table(spark, sf):
    """JOB6 end to end in sparse form: one ``split``-partitioned parquet write, read back."""
    path = shared_path(spark, "ml_table")
    sinks.write_ml_table(jobs.ml_frame(_full(spark, sf)), path, dense=False)
    back = spark.read.parquet(path)
    return back.select(
        "name", "NP_transcript", "position", "phenotype_list", "is_pathogenic", "split",
        position_index(F.col("position")).alias("mutation_position"),
        vectors.join_ints(F.col("context_positions")).alias("context_hot"),
    )


def ml_table_dense(spark, sf):
    """JOB6 end to end as published: dense vectors, written and read back, all digits compared."""
    path = shared_path(spark, "ml_table_dense")
    sinks.write_ml_table(jobs.ml_frame(_full(spark, sf)), path, dense=True)
    return spark.read.parquet(path).select(
        "name", "NP_transcript", "position", "phenotype_list", "is_pathogenic", "split",
        F.size("mutation_vector").cast("long").alias("mutation_len"), _bits(F.col("mutation_vector")).alias("mutation_bits"),
        F.size("context_vector").cast("long").alias("context_len"), _bits(F.col("context_vector")).alias("context_bits"),
    )


def feature_projection(spark, sf):
    """Features and target of one part, read back from the written ML table
    (column pruning and ``split`` partition pruning at the scan)."""
    path = shared_path(spark, "ml_features")
    sinks.write_ml_table(jobs.ml_frame(_full(spark, sf)), path, dense=False)
    df = read_features(spark, path, ["position", "context_positions"], "is_pathogenic", splits=["test"])
    return df.select(
        "position",
        vectors.join_ints(F.col("context_positions")).alias("context_positions"),
        "is_pathogenic",
    )


def model_side_table(spark, sf):
    """The table the model scripts read: their names, vectors padded to their width, written and read back."""
    path = shared_path(spark, "model_side_table")
    sinks.write_ml_table(jobs.ml_frame(_full(spark, sf)), path, model_width=MODEL_VECTOR_LENGTH)
    return spark.read.parquet(path).select(
        "NP_transcript", "position", "phenotype_list", "split",
        F.size("POS_vector").cast("long").alias("POS_len"), _bits(F.col("POS_vector")).alias("POS_vector"),
        F.size("Patho_Vector").cast("long").alias("Patho_len"), _bits(F.col("Patho_Vector")).alias("Patho_Vector"),
        "ClinSigSimple",
    )


def two_channel_input(spark, sf):
    """Model input with the two vectors kept apart: channel 0 mutation, channel 1 context."""
    rows = ctx_ops.context_positions(_staged_split_rows(spark, sf))
    channels = vectors.two_channels(
        vectors.mutation_dense(position_index(F.col("position"))), vectors.context_dense(F.col("context_positions"))
    )
    return rows.select(*ML_KEY_COLUMNS, "split", channels.alias("x")).select(
        *ML_KEY_COLUMNS, "split",
        F.size("x").cast("long").alias("n_channels"),
        F.size(F.col("x")[0]).cast("long").alias("width"),
        _bits(F.col("x")[0]).alias("channel0_bits"),
        _bits(F.col("x")[1]).alias("channel1_bits"),
    )


def full_variation_preview(spark, sf):
    """The first rows of the full dataset under its total order (a preview: the limit is the feature)."""
    full = _full(spark, sf)
    return full.orderBy(*[F.col(c).asc_nulls_first() for c in full.columns]).limit(PREVIEW_ROWS)


# ---------------------------------------------------------------------------
# Scoring and selection
# ---------------------------------------------------------------------------


def score_rows(spark, sf):
    s = _scored(spark, sf)
    return s.select("key", "model", "split", "batch_id", "label", _r6("logit"), "predicted", "correct", _r6("loss"))


def _rounded_report(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, "n", "n_correct", _r6("accuracy"), _r6("mean_loss"))


def model_report(spark, sf):
    return _rounded_report(metrics.report(_scored(spark, sf), by=["model"]), ["model"])


def model_split_report(spark, sf):
    return _rounded_report(metrics.report(_scored(spark, sf), by=["model", "split"]), ["model", "split"])


def batch_mean_loss(spark, sf):
    out = metrics.batch_mean_loss(_scored(spark, sf))
    return out.select("model", "n_batches", _r6("batch_mean_loss"), _r6("row_mean_loss"))


def best_epoch(spark, sf):
    return metrics.best_epoch(_fx(spark, sf, "fx_runs"))


def best_trial(spark, sf):
    return metrics.best_trial(_fx(spark, sf, "fx_runs"), metric="loss", mode="min")


def best_trial_accuracy(spark, sf):
    return metrics.best_trial(_fx(spark, sf, "fx_runs"), metric="accuracy", mode="max")


def fit_logistic(spark, sf):
    """Fit on the training part of the ML table, report every part.

    Beside each part's exact count and base-rate loss: whether the fitted model's
    training loss is at most that of the base rate (a property, not its coefficients).
    """
    rows = stage(fit_ops.with_features(jobs.ml_frame(_full(spark, sf))), "fit_features")
    fitted = fit_ops.fit_and_score(rows.filter(F.col("split") == "train"), rows, by=["split"])
    p = F.avg(fit_ops.LABEL)
    base = rows.groupBy("split").agg((-(p * F.log(p) + (1 - p) * F.log(1 - p))).alias("base_loss"))
    fits = F.when(F.col("split") == "train", F.col("mean_loss") <= F.col("base_loss") + 1e-9)
    return fitted.join(base, "split").select("split", "n", _r6("base_loss"), fits.alias("train_loss_at_most_base"))


def search_best(spark, sf):
    """The random search: trials, rows they are validated on, and that one best has the lowest loss."""
    runs = jobs.fit_and_select_frame(jobs.ml_frame(_full(spark, sf)))
    best = F.min(F.when(F.col("is_best"), F.col("mean_loss")))
    return runs.agg(
        F.count(F.lit(1)).alias("n_trials"), F.max("n").alias("n_validation"),
        F.count(F.when(F.col("is_best"), 1)).alias("n_best"), (best == F.min("mean_loss")).alias("best_is_lowest"),
    )


def fixed_weights_scores(spark, sf):
    """Logits of a linear model with stated weights over the concatenated input (weight of slot j from 0:
    ``((37 j) mod 101 - 50) / 100``)."""
    rows = fit_ops.with_features(jobs.ml_frame(_full(spark, sf)))
    return rows.select(*ML_KEY_COLUMNS, "split", _stated_logit().alias("logit"), F.size(_inputs()).cast("long").alias("width"))


def _inputs() -> F.Column:
    return vector_to_array(F.col(fit_ops.FEATURES)).cast("array<long>")


def _stated_logit() -> F.Column:
    parts = F.transform(_inputs(), lambda v, j: v * (F.pmod(j * 37, F.lit(101)) - 50))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, v: a + v) / 100.0


# ---------------------------------------------------------------------------
# Global batches, balanced split, epochs, halving, counts, layout
# ---------------------------------------------------------------------------


def global_batches(spark, sf):
    """Batches of 256 rows in the seeded order, full but for each part's last."""
    return batches.assign_batches(_split_rows(spark, sf)).select(*ML_KEY_COLUMNS, "split", "batch_id")


def global_batch_mean_loss(spark, sf):
    """Mean of batch means of the stated linear model, over global batches of the ML table read back."""
    path = shared_path(spark, "ml_batches")
    sinks.write_ml_table(jobs.ml_frame(_full(spark, sf)), path, dense=False)
    rows = fit_ops.with_features(fit_ops.ml_rows_of(spark.read.parquet(path)))
    scored = metrics.score_rows(rows.select(*ML_KEY_COLUMNS, "split", _stated_logit().alias("logit"), fit_ops.LABEL))
    out = metrics.batch_mean_loss(batches.assign_batches(scored), by=["split"])
    return out.select("split", "n_batches", _r6("batch_mean_loss"), _r6("row_mean_loss"))


def split_by_protein(spark, sf):
    """Whole proteins to parts by size, largest first."""
    return balance.assign_balanced(_ml_rows(spark, sf)).select(*ML_KEY_COLUMNS, "split")


def epoch_metrics(spark, sf):
    """Real epochs: how many, that the picked one has the lowest loss, and that its reloaded model has that loss."""
    train, validation = jobs.fit_parts(jobs.ml_frame(_full(spark, sf)))
    run = epochs.fit_epochs(train, validation, fit_ops.perceptron(hidden=(4,)), epochs=4, steps=2)
    path = shared_path(spark, "best_epoch_model")
    fit_ops.save_model(run.model, path)
    again = fit_ops.validation_scores({0: fit_ops.load_model(spark, path)}, validation).agg(F.avg("loss").alias("again"))
    best = metrics.best_epoch(run.runs).join(F.broadcast(again))
    lowest = run.runs.agg(F.min("loss").alias("lowest"), F.count(F.lit(1)).alias("n_rows"))
    return best.join(F.broadcast(lowest)).select(
        "trial", "n_epochs", "n_rows", (F.col("best_loss") == F.col("lowest")).alias("best_is_lowest"),
        (F.abs(F.col("again") - F.col("best_loss")) < 1e-9).alias("reloaded_model_has_it"),
    )


def halving_rungs(spark, sf):
    """Successive halving: each rung's trials and epochs, and that a replay of the metrics table picks the same trials."""
    train, validation = jobs.fit_parts(jobs.ml_frame(_full(spark, sf)))
    result = epochs.successive_halving(train, validation, fit_ops.perceptron(hidden=(), solver="gd"))
    went = result.runs.select((F.col("rung") - 1).alias("rung"), "trial", F.lit(True).alias("went"))
    last = F.max("rung").over(Window.partitionBy())
    told = epochs.replay(result.runs).join(went, ["rung", "trial"], "left").withColumn("last", last)
    agrees = (F.col("rung") == F.col("last")) | (F.col("goes_on") == F.coalesce("went", F.lit(False)))
    per_rung = result.runs.groupBy("rung").agg(F.max("epoch").alias("n_epochs"))
    counted = told.groupBy("rung").agg(F.count(F.lit(1)).alias("n_trials"), F.every(agrees).alias("replay_agrees"))
    return counted.join(per_rung, "rung").select("rung", "n_trials", "n_epochs", "replay_agrees")


def pass_counts(spark, sf):
    """What each step of the full dataset's job passed and dropped, counted while it was written."""
    full, counts = jobs.counted_full_variation_frame(
        _fx(spark, sf, "fx_variant_summary"), _ids(spark, sf), _tmap(spark, sf), _sequences(spark, sf)
    )
    sinks.write_parquet(full, shared_path(spark, "counted_full"))
    return counts.table(spark)


def missense_features(spark, sf):
    """The missense variants' features with the ids applied before the dedupe."""
    return jobs.missense_features_frame(_fx(spark, sf, "fx_variant_summary"), _ids(spark, sf))


def context_bucketed(spark, sf):
    """The sequence join and the context over tables bucketed on the protein."""
    tables = {n: f"varloom_{n}_{uuid.uuid4().hex[:8]}" for n in ("full", "sequences")}
    full = layout.write_bucketed(_full(spark, sf), tables["full"], shared_path(spark, "full"), layout.PROTEIN, BUCKETS)
    seqs = layout.write_bucketed(_sequences(spark, sf), tables["sequences"], shared_path(spark, "seqs"), layout.SEQUENCE_ID, BUCKETS)
    path = shared_path(spark, "context_bucketed")
    with layout.bucket_session(spark):
        sinks.write_parquet(layout.context_rows(layout.sequenced(full, seqs)), path)
    out = spark.read.parquet(path)
    return out.withColumns(
        {
            "n_context": F.size("context_positions").cast("long"),
            "context_positions": vectors.join_ints(F.col("context_positions")),
        }
    )


def published_sequences(spark, sf):
    """Two runs' tables published one after the other, a third that fails before its manifest; read as the current version."""
    root, seqs = shared_path(spark, "published"), _sequences(spark, sf)
    for prefix in ("NP_0000", "NP_"):
        run, folder = publish.begin(root)
        sinks.write_parquet(seqs.filter(F.startswith("id", F.lit(prefix))), f"{folder}/sequences")
        publish.publish(spark, root, run, {"sequences": f"{folder}/sequences"})
    _, folder = publish.begin(root)
    sinks.write_parquet(seqs.limit(0), f"{folder}/sequences")
    return spark.read.parquet(publish.resolve(spark, f"{root}#sequences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_variant_summary": scan_variant_summary,
    "scan_vcf": scan_vcf,
    "scan_vcf_blocks": scan_vcf_blocks,
    "scan_variant_summary_orders": scan_variant_summary_orders,
    "rejected_rows": rejected_rows,
    "rejected_counts": rejected_counts,
    "scan_gene2accession": scan_gene2accession,
    "scan_fasta": scan_fasta,
    "variant_filter": variant_filter,
    "variant_features": variant_features,
    "hgvs_parts": hgvs_parts,
    "missense_ids": missense_ids,
    "missense_id_counts": missense_id_counts,
    "duplicate_ids": duplicate_ids,
    "transcript_map": transcript_map,
    "protein_sequences": protein_sequences,
    "protein_sequence_count": protein_sequence_count,
    "missense_variants": missense_variants,
    "mapped_variants": mapped_variants,
    "unmapped_variants": unmapped_variants,
    "amino_acid_codes": amino_acid_codes,
    "full_variation": full_variation,
    "full_variation_sequences": full_variation_sequences,
    "unsequenced_variants": unsequenced_variants,
    "phenotype_rows": phenotype_rows,
    "phenotype_dedupe": phenotype_dedupe,
    "split_assign": split_assign,
    "split_two_way": split_two_way,
    "shuffled_rows": shuffled_rows,
    "context_within_split": context_within_split,
    "context_from_train": context_from_train,
    "mutation_vector": mutation_vector,
    "context_vector": context_vector,
    "ml_table": ml_table,
    "ml_table_dense": ml_table_dense,
    "feature_projection": feature_projection,
    "two_channel_input": two_channel_input,
    "full_variation_preview": full_variation_preview,
    "model_side_table": model_side_table,
    "score_rows": score_rows,
    "model_report": model_report,
    "model_split_report": model_split_report,
    "batch_mean_loss": batch_mean_loss,
    "best_epoch": best_epoch,
    "best_trial": best_trial,
    "best_trial_accuracy": best_trial_accuracy,
    "fit_logistic": fit_logistic,
    "search_best": search_best,
    "fixed_weights_scores": fixed_weights_scores,
    "global_batches": global_batches,
    "global_batch_mean_loss": global_batch_mean_loss,
    "split_by_protein": split_by_protein,
    "epoch_metrics": epoch_metrics,
    "halving_rungs": halving_rungs,
    "pass_counts": pass_counts,
    "missense_features": missense_features,
    "context_bucketed": context_bucketed,
    "published_sequences": published_sequences,
}
