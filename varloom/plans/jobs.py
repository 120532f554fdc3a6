"""User-facing jobs.

``*_frame`` functions compose operators on DataFrames (lazy, one plan each);
``run_*`` functions read inputs from paths and write each published table. A
later job reads the table an earlier one wrote, which also cuts the lineage a
lost executor would otherwise have to recompute.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.constants import (
    ACCESSION_PROTEIN_COL,
    ACCESSION_RNA_COL,
    ACCESSION_STATUS_COL,
    MAX_SEQUENCE_LENGTH,
    PROTEIN_PREFIX,
    SEARCH_TRIALS,
    SPLIT_RATIOS,
    SPLIT_SEED,
    VARIANT_FILTER_COLUMNS,
    VARIANT_SUMMARY_COLUMNS,
)
from varloom.operators import context as ctx_ops
from varloom.operators.counts import PassCounts
from varloom.operators import epochs as epoch_ops
from varloom.operators import fit as fit_ops
from varloom.operators import mapping, metrics, missense, phenotypes, split, variants, variation
from varloom.plans import publish, sinks
from varloom.session import delete_path, shared_path, stage
from varloom.sources import parquet as pq_src
from varloom.sources import text

log = logging.getLogger("varloom")

# ---------------------------------------------------------------------------
# DataFrame compositions
# ---------------------------------------------------------------------------


def variant_features_frame(variant_summary: DataFrame, **condition) -> DataFrame:
    """JOB1: filter, seven columns, label as int, one row per variation, name parts."""
    return variants.variant_summary_features(variant_summary, **condition)


def missense_features_frame(variant_summary: DataFrame, ids: DataFrame, **condition) -> DataFrame:
    """JOB1 of the missense variants alone: :func:`variant_features_frame` restricted to ``ids``.

    The ids are applied before the dedupe: both go by ``VariationID``, so the rows are the
    same, and only surviving rows are sorted. A small id table is broadcast by its measured
    size, so the others never reach a shuffle. A larger one joins by shuffle, whose
    partitioning the dedupe reuses; Spark then puts a Bloom filter of the ids (8 MB at
    most, ``spark.sql.optimizer.runtime.bloomFilter.maxNumBits``) in front of that shuffle
    where its size thresholds call for one.
    """
    return variants.variant_features(mapping.restrict_to_ids(variants.filter_variants(variant_summary, **condition), ids))


def missense_ids_frame(vcf: DataFrame) -> DataFrame:
    """JOB2: ids of VCF records with a missense consequence."""
    return missense.missense_ids(vcf)


def transcript_map_frame(accessions: DataFrame) -> DataFrame:
    """JOB3: distinct transcript → protein pairs."""
    return mapping.transcript_map(accessions)


def protein_sequences_frame(records: DataFrame, prefix: str = PROTEIN_PREFIX) -> DataFrame:
    """JOB4: ``(id, sequence)`` of the kept FASTA records."""
    return variation.protein_sequences(records, prefix)


def mapped_variants_frame(
    features: DataFrame, ids: DataFrame, tmap: DataFrame, ignore_version: bool = False
) -> DataFrame:
    """Missense variants with their protein accessions."""
    return mapping.map_to_proteins(mapping.restrict_to_ids(features, ids), tmap, ignore_version)


def full_variation_frame(
    features: DataFrame,
    ids: DataFrame,
    tmap: DataFrame,
    sequences: DataFrame | None = None,
    ignore_version: bool = False,
) -> DataFrame:
    """JOB5: the full variation dataset, with sequences when given."""
    full = variation.full_variation(mapped_variants_frame(features, ids, tmap, ignore_version))
    return variation.attach_sequences(full, sequences) if sequences is not None else full


def counted_full_variation_frame(
    variant_summary: DataFrame, ids: DataFrame, tmap: DataFrame, sequences: DataFrame | None = None,
    ignore_version: bool = False, **condition,
) -> tuple[DataFrame, PassCounts]:
    """JOB1 and JOB5 in one plan that counts, while it runs, what each step passes and drops.

    The joins to the map and the sequences are outer ones whose unmatched rows are counted
    and then dropped, so what a row-by-row report would read again is known from this pass.
    """
    counts = PassCounts()
    read = counts.mark(variant_summary, "summary_rows")
    kept = counts.mark(mapping.restrict_to_ids(counts.mark(variants.filter_variants(read, **condition), "filtered_rows"), ids), "missense_rows")
    features = counts.mark(variants.variant_features(kept), "variants", no_transcript=F.col("transcription") == "")
    mapped = mapping.map_to_proteins(features, tmap, ignore_version, keep_unmapped=True)
    mapped = counts.mark(mapped, unmapped_variants=F.col("NP_transcript").isNull()).filter(F.col("NP_transcript").isNotNull())
    full = counts.mark(variation.full_variation(counts.mark(mapped, "mapped_rows")), "full_rows")
    if sequences is not None:
        full = variation.attach_sequences(full, sequences, keep_unsequenced=True)
        full = counts.mark(full, unsequenced_rows=F.col("sequence").isNull()).filter(F.col("sequence").isNotNull())
    return counts.mark(full, "written_rows"), counts


def ml_frame(
    full: DataFrame,
    scope: str = "within_split",
    split_key: str | Sequence[str] = "row",
    ratios: Sequence[float] = SPLIT_RATIOS,
    seed: int = SPLIT_SEED,
    n: int = MAX_SEQUENCE_LENGTH,
    staged: bool = True,
) -> DataFrame:
    """JOB6 (sparse form): rows, ``split`` and ``context_positions``."""
    parts = ml_parts(full, split_key, ratios, seed, n)
    # The context reads these rows twice (aggregate and join back): compute them once.
    parts = stage(parts, "ml_rows") if staged else parts
    return ctx_ops.context_positions(parts, scope=scope)


def ml_parts(
    full: DataFrame,
    split_key: str | Sequence[str] = "row",
    ratios: Sequence[float] = SPLIT_RATIOS,
    seed: int = SPLIT_SEED,
    n: int = MAX_SEQUENCE_LENGTH,
) -> DataFrame:
    """One row per (protein, position, phenotype) with its ``split``."""
    rows = phenotypes.ml_rows(full, n)
    return split.assign_split(rows, key=split_key, ratios=ratios, seed=seed)


def score_report_frame(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """JOB7: accuracy and loss per model (and any other grouping column)."""
    return metrics.report(metrics.score_rows(scores), by=by)


def fit_and_select_frame(
    ml_rows: DataFrame,
    estimator=None,
    trials: int = SEARCH_TRIALS,
    seed: int = SPLIT_SEED,
    n: int = MAX_SEQUENCE_LENGTH,
) -> DataFrame:
    """JOB8: the table of trials of :func:`fit_and_select`."""
    return fit_and_select(ml_rows, estimator, trials, seed, n).runs


def fit_and_select(
    ml_rows: DataFrame,
    estimator=None,
    trials: int = SEARCH_TRIALS,
    seed: int = SPLIT_SEED,
    n: int = MAX_SEQUENCE_LENGTH,
) -> fit_ops.SearchResult:
    """JOB8: second-level split of the training rows, random search, best trial and its model."""
    train, validation = fit_parts(ml_rows, seed, n)
    return fit_ops.search_models(train, validation, estimator=estimator, trials=trials, seed=seed)


def fit_parts(ml_rows: DataFrame, seed: int = SPLIT_SEED, n: int = MAX_SEQUENCE_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Feature rows to fit on and to validate on: the second-level split of the training rows, written once."""
    parts = split.assign_two_way(ml_rows.filter(F.col("split") == "train"), seed=seed)
    feats = stage(fit_ops.with_features(parts, n), "fit_features")
    return feats.filter(F.col("fit_split") == "train"), feats.filter(F.col("fit_split") == "val")


# ---------------------------------------------------------------------------
# Path-level jobs
# ---------------------------------------------------------------------------


SUMMARY_COLUMNS = (*VARIANT_SUMMARY_COLUMNS, *VARIANT_FILTER_COLUMNS)
ACCESSION_COLUMNS = (ACCESSION_STATUS_COL, ACCESSION_RNA_COL, ACCESSION_PROTEIN_COL)


def read_variant_summary(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return text.read_tsv(spark, path, columns=SUMMARY_COLUMNS)


def read_gene2accession(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return text.read_tsv(spark, path, columns=ACCESSION_COLUMNS)


def run_etl(
    spark: SparkSession,
    variant_summary: str,
    vcf: str,
    gene2accession: str,
    fasta: str,
    out_dir: str,
    join_sequences: bool = False,
    prepare_ml: bool = False,
    scope: str = "within_split",
    split_key: str = "row",
    ignore_version: bool = False,
    dense: bool = True,
    prefix: str = PROTEIN_PREFIX,
    model_width: int | None = None,
    n: int = MAX_SEQUENCE_LENGTH,
    sequences_path: str | None = None,
    condition: dict | None = None,
    rejected: bool = False,
    counts: bool = False,
    versioned: bool = False,
) -> dict[str, str]:
    """Run JOB1–JOB6 from the four input files; return the written table paths.

    ``n`` is the vector length, ``condition`` replaces values of the variant filter
    (see ``variants.variant_condition``). ``sequences_path`` names a sequence table of
    an earlier run, which is then read instead of parsing the FASTA.

    ``rejected`` reads the inputs with their malformed lines set apart, in a table
    ``rejected`` (input, file, line, reason). ``counts`` writes ``run_counts`` (step, n):
    what each step of JOB1 and JOB5 passed and dropped, counted in the writing pass.
    ``versioned`` writes all tables into a run folder under ``out_dir`` and publishes them
    together by a manifest at the end (``varloom.plans.publish``).
    """
    run_id, out = publish.begin(out_dir) if versioned else (None, out_dir.rstrip("/"))
    paths = {
        "missense_ids": f"{out}/missense_ids.parquet",
        "transcript_map": f"{out}/transcript_map.parquet",
        "protein_sequences": f"{out}/protein_sequences.parquet",
        "full_variation": f"{out}/full_variation.parquet",
    }
    # JOB2-JOB4 are independent: submit them as concurrent Spark jobs so the
    # smaller ones fill the slots the larger one leaves idle.
    apart: dict[str, DataFrame] = {}

    def source(name: str, read, check) -> DataFrame:
        """The input's rows; with ``rejected`` its malformed lines are noted."""
        if not rejected:
            return read()
        checked = check()
        apart[name] = checked.rejected
        return checked.rows

    independent = {
        "missense_ids": lambda: missense_ids_frame(
            source("vcf", lambda: text.read_vcf(spark, vcf), lambda: text.checked_vcf(spark, vcf))
        ),
        "transcript_map": lambda: transcript_map_frame(source(
            "gene2accession", lambda: read_gene2accession(spark, gene2accession),
            lambda: text.checked_tsv(spark, gene2accession, ACCESSION_COLUMNS),
        )),
        "protein_sequences": lambda: protein_sequences_frame(
            source("fasta", lambda: text.read_fasta(spark, fasta), lambda: text.checked_fasta(spark, fasta)), prefix
        ),
    }
    if sequences_path:
        independent.pop("protein_sequences")
        paths["protein_sequences"] = sequences_path
    with ThreadPoolExecutor(max_workers=len(independent)) as pool:
        futures = {
            name: pool.submit(lambda name=name, build=build: sinks.write_parquet(build(), paths[name]))
            for name, build in independent.items()
        }
        written = {name: f.result() for name, f in futures.items()}

    summary = source(
        "variant_summary", lambda: read_variant_summary(spark, variant_summary),
        lambda: text.checked_tsv(spark, variant_summary, SUMMARY_COLUMNS),
    )
    ids = pq_src.read_table(spark, paths["missense_ids"])
    tmap = pq_src.read_table(spark, paths["transcript_map"])
    sequences = pq_src.read_table(spark, paths["protein_sequences"]) if join_sequences else None
    if counts:
        full, passed = counted_full_variation_frame(summary, ids, tmap, sequences, ignore_version, **(condition or {}))
    else:
        features = missense_features_frame(summary, ids, **(condition or {}))
        full = variation.full_variation(mapping.map_to_proteins(features, tmap, ignore_version))
        full = variation.attach_sequences(full, sequences) if join_sequences else full
    written["full_variation"] = sinks.write_parquet(full, paths["full_variation"])
    if counts:
        paths["run_counts"] = f"{out}/run_counts.parquet"
        written["run_counts"] = sinks.write_parquet(passed.table(spark).coalesce(1), paths["run_counts"])
    if rejected:
        paths["rejected"] = f"{out}/rejected.parquet"
        each = [df.select(F.lit(name).alias("input"), *text.REJECTED) for name, df in apart.items()]
        written["rejected"] = sinks.write_parquet(reduce(DataFrame.unionByName, each), paths["rejected"])

    if prepare_ml:
        paths["ml"] = f"{out}/ml.parquet"
        written["ml"] = run_ml_dataset(
            spark, paths["full_variation"], paths["ml"], scope, split_key, dense, n=n, model_width=model_width
        )
    for name, rows in written.items():
        log.info("wrote %s: %d rows to %s", name, rows, paths[name])
    if versioned:
        log.info("published version %d of %s", publish.publish(spark, out_dir, run_id, paths), out_dir)
    return paths


def run_ml_dataset(
    spark: SparkSession,
    full_path: str,
    out_path: str,
    scope: str = "within_split",
    split_key: str = "row",
    dense: bool = True,
    n: int = MAX_SEQUENCE_LENGTH,
    model_width: int | None = None,
) -> int:
    """JOB6 from the written full dataset to one ``split``-partitioned table; returns its row count.

    The split rows are staged once; their count, read from parquet metadata,
    sizes one hash partitioning on the group key that the context collect, the
    join back and the dense write all reuse.
    """
    scratch = shared_path(spark, "ml_rows")
    sinks.write_parquet(ml_parts(spark.read.parquet(full_path), split_key, n=n), scratch)
    parts = spark.read.parquet(scratch)
    rows = parts.count()
    if not dense:
        sinks.write_ml_table(ctx_ops.context_positions(parts, scope=scope), out_path, n=n, dense=False)
        delete_path(spark, scratch)
        return rows
    # One partitioning, sized for the dense output, serves the context collect,
    # the join back and the dense sink.
    width = sinks.dense_partitions(rows, n)
    context = ctx_ops.context_positions(parts, scope=scope, partitions=width)
    sinks.write_ml_table(context, out_path, n=n, model_width=model_width, prepartitioned=True)
    delete_path(spark, scratch)
    return rows


def run_score_report(spark: SparkSession, scores_path: str, by: Sequence[str] = ("model",)) -> DataFrame:
    return score_report_frame(spark.read.parquet(scores_path), by)


def run_fit(
    spark: SparkSession,
    ml_path: str,
    out_path: str,
    model_path: str | None = None,
    estimator=None,
    trials: int = SEARCH_TRIALS,
    seed: int = SPLIT_SEED,
    n: int = MAX_SEQUENCE_LENGTH,
    epochs: int | None = None,
    halving: bool = False,
) -> int:
    """JOB8 from a written ML table (sparse, dense or model-side): write the trials, save the best model.

    Returns the best trial's number. With ``epochs`` one perceptron is fitted epoch by
    epoch instead: its metrics are written, the best epoch's model is saved and its number
    returned. With ``halving`` weak trials stop early.
    """
    rows = fit_ops.ml_rows_of(spark.read.parquet(ml_path))
    log.info("rows without a label, left out: %d", fit_ops.unlabelled(rows))
    if epochs or halving:
        train, validation = fit_parts(rows, seed, n)
        if halving:
            result = epoch_ops.successive_halving(train, validation, estimator, trials, seed=seed)
            best = result.survivor
        else:
            result = epoch_ops.fit_epochs(train, validation, estimator, epochs)
            best = result.best
    else:
        result = fit_and_select(rows, estimator=estimator, trials=trials, seed=seed, n=n)
        best = result.best
    sinks.write_parquet(result.runs, out_path)
    if model_path:
        fit_ops.save_model(result.model, model_path)
    return best


def score_stored_models(
    spark: SparkSession,
    ml_path: str,
    models: dict[str, str],
    splits: Sequence[str] | None = None,
    n: int = MAX_SEQUENCE_LENGTH,
) -> DataFrame:
    """JOB7 for stored models: one row per (ML row, model) with its logit and label, from one scan.

    ``models`` maps a name to the folder of a saved model; ``splits`` prunes the parts read.
    """
    table = spark.read.parquet(ml_path)
    if splits is not None:
        table = table.filter(F.col("split").isin(list(splits)))
    features = fit_ops.with_features(fit_ops.ml_rows_of(table), n)
    loaded = {name: fit_ops.load_model(spark, path) for name, path in models.items()}
    return fit_ops.score_models(loaded, features)
