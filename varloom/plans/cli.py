"""Command-line entry, for ``spark-submit``.

    spark-submit --py-files varloom.zip varloom/plans/cli.py etl \\
        --variant-summary vs.txt.gz --vcf variants.vcf.gz --gene2accession gene2accession.gz \\
        --fasta protein.faa.gz --out-dir hdfs:///runs/run1 --join-sequences --prepare-ml-dataset

    ... cli.py score --scores scores.parquet --by model split
    ... cli.py fit --ml-table run1/ml.parquet --out run1/search.parquet --model-out run1/best
    ... cli.py evaluate --ml-table run1/ml.parquet --model best=run1/best --out run1/report.parquet

Session settings (master, memory, shuffle width) come from ``spark-submit``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from varloom.constants import (
    MAX_SEQUENCE_LENGTH,
    MODEL_VECTOR_LENGTH,
    SEARCH_TRIALS,
    SPLIT_SEED,
    VARIANT_ASSEMBLY,
    VARIANT_CLINICAL_SIGNIFICANCES,
    VARIANT_REVIEW_STATUSES,
    VARIANT_TYPE,
)
from varloom.operators import context as ctx_ops
from varloom.operators import fit as fit_ops
from varloom.operators import split as split_ops
from varloom.plans import jobs, publish, sinks
from varloom.session import build_session, clean_scratch


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="varloom", description="Variant dataset ETL and classifier evaluation on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    etl = sub.add_parser("etl", help="variant summary + VCF + gene map + FASTA -> published tables")
    etl.add_argument("--variant-summary", required=True)
    etl.add_argument("--vcf", required=True)
    etl.add_argument("--gene2accession", required=True)
    source = etl.add_mutually_exclusive_group(required=True)
    source.add_argument("--fasta", help="protein FASTA")
    source.add_argument("--sequences-file", help="sequence table of an earlier run, instead of the FASTA")
    etl.add_argument("--out-dir", required=True)
    etl.add_argument("--join-sequences", action="store_true", help="attach protein and mutated sequences")
    etl.add_argument("--prepare-ml-dataset", action="store_true", help="also write the split ML table")
    etl.add_argument("--context-scope", choices=ctx_ops.SCOPES, default="within_split")
    etl.add_argument("--split-key", choices=sorted(split_ops.SPLIT_KEYS), default="row")
    etl.add_argument("--ignore-version", action="store_true", help="match transcripts without the .N version")
    etl.add_argument("--sparse", action="store_true", help="write positions instead of dense vectors")
    etl.add_argument("--protein-prefix", default="NP_")
    etl.add_argument("--vector-length", type=int, default=MAX_SEQUENCE_LENGTH)
    etl.add_argument("--variant-type", default=VARIANT_TYPE)
    etl.add_argument("--assembly", default=VARIANT_ASSEMBLY)
    etl.add_argument("--review-status", nargs="+", default=list(VARIANT_REVIEW_STATUSES))
    etl.add_argument("--significance", nargs="+", default=list(VARIANT_CLINICAL_SIGNIFICANCES))
    etl.add_argument("--model-width", type=int, default=None,
                     help=f"ML table with POS_vector/Patho_Vector/ClinSigSimple padded to this width ({MODEL_VECTOR_LENGTH} for the model scripts)")

    etl.add_argument("--rejected", action="store_true", help="also write the malformed input lines with their reasons")
    etl.add_argument("--counts", action="store_true", help="also write what each step passed and dropped")
    etl.add_argument("--versioned", action="store_true",
                     help="write a run folder and publish all tables at once; read them as OUT_DIR#table")

    ml = sub.add_parser("ml", help="full variation table -> split ML table")
    ml.add_argument("--full-variation", required=True)
    ml.add_argument("--out", required=True)
    ml.add_argument("--context-scope", choices=ctx_ops.SCOPES, default="within_split")
    ml.add_argument("--split-key", choices=sorted(split_ops.SPLIT_KEYS), default="row")
    ml.add_argument("--sparse", action="store_true")
    ml.add_argument("--vector-length", type=int, default=MAX_SEQUENCE_LENGTH)
    ml.add_argument("--model-width", type=int, default=None,
                    help=f"publish POS_vector/Patho_Vector/ClinSigSimple padded to this width (the model scripts use {MODEL_VECTOR_LENGTH})")

    score = sub.add_parser("score", help="scores table -> accuracy and loss per group")
    score.add_argument("--scores", required=True)
    score.add_argument("--by", nargs="+", default=["model"])
    score.add_argument("--out", help="write the report as parquet instead of printing every group")

    fit = sub.add_parser("fit", help="ML table -> random search over a classifier")
    fit.add_argument("--ml-table", required=True, help="ML table: dense, --sparse or --model-width")
    fit.add_argument("--out", required=True, help="table of trials")
    fit.add_argument("--model-out", help="folder for the best model")
    fit.add_argument("--vector-length", type=int, default=MAX_SEQUENCE_LENGTH)
    fit.add_argument("--trials", type=int, default=SEARCH_TRIALS)
    fit.add_argument("--seed", type=int, default=SPLIT_SEED)
    fit.add_argument("--model", choices=("logistic", "perceptron"), default="logistic",
                     help="logistic regression, or a feed-forward perceptron searched over layer shapes")

    how = fit.add_mutually_exclusive_group()
    how.add_argument("--epochs", type=int, help="one perceptron instead of a search: a metrics row an epoch, the best epoch's model")
    how.add_argument("--halving", action="store_true", help="successive halving of the perceptron's trials instead of full fits")

    evaluate = sub.add_parser("evaluate", help="stored models on an ML table -> accuracy and loss per model and split")
    evaluate.add_argument("--ml-table", required=True)
    evaluate.add_argument("--model", required=True, nargs="+", metavar="NAME=FOLDER")
    evaluate.add_argument("--splits", nargs="+", help="parts to score (all)")
    evaluate.add_argument("--vector-length", type=int, default=MAX_SEQUENCE_LENGTH)
    evaluate.add_argument("--scores-out", help="also write each row's logits")
    evaluate.add_argument("--out", help="write the report as parquet instead of printing every group")
    return p


def _report(report: DataFrame, out: str | None) -> None:
    """Write the report, or print every group of it as it streams in."""
    if out:
        sinks.write_parquet(report, out)
        return
    print("\t".join(report.columns))
    for row in report.toLocalIterator():
        print("\t".join(str(v) for v in row))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session(app_name=f"varloom-{args.command}")
    try:
        _run(spark, args)
    finally:
        clean_scratch(spark)
    return 0


def _run(spark, args) -> None:
    if args.command == "etl":
        paths = jobs.run_etl(
            spark, args.variant_summary, args.vcf, args.gene2accession, args.fasta, args.out_dir,
            join_sequences=args.join_sequences, prepare_ml=args.prepare_ml_dataset, scope=args.context_scope,
            split_key=args.split_key, ignore_version=args.ignore_version, dense=not args.sparse,
            prefix=args.protein_prefix, model_width=args.model_width, n=args.vector_length,
            sequences_path=args.sequences_file,
            condition={
                "variant_type": args.variant_type, "assembly": args.assembly,
                "review_statuses": args.review_status, "significances": args.significance,
            },
            rejected=args.rejected, counts=args.counts, versioned=args.versioned,
        )
        for name, path in paths.items():
            print(f"{name}\t{path}")
    elif args.command == "ml":
        jobs.run_ml_dataset(spark, publish.resolve(spark, args.full_variation), args.out, args.context_scope, args.split_key, not args.sparse,
                            n=args.vector_length, model_width=args.model_width)
    elif args.command == "score":
        _report(jobs.run_score_report(spark, args.scores, args.by).orderBy(*args.by), args.out)
    elif args.command == "fit":
        n = args.vector_length
        if (args.epochs or args.halving) and args.model != "perceptron":
            raise SystemExit("--epochs and --halving continue fits, which only --model perceptron can")
        solver = "gd" if args.halving else "l-bfgs"
        estimator = fit_ops.perceptron(n, seed=args.seed, solver=solver) if args.model == "perceptron" else fit_ops.logistic()
        table = publish.resolve(spark, args.ml_table)
        jobs.run_fit(spark, table, args.out, args.model_out, estimator, args.trials, args.seed, n, args.epochs, args.halving)
    elif args.command == "evaluate":
        models = dict(pair.split("=", 1) for pair in args.model)
        scores = jobs.score_stored_models(spark, publish.resolve(spark, args.ml_table), models, args.splits, args.vector_length)
        if args.scores_out:
            sinks.write_parquet(scores, args.scores_out)
            scores = spark.read.parquet(args.scores_out)
        _report(jobs.score_report_frame(scores, by=["model", "split"]).orderBy("model", "split"), args.out)


if __name__ == "__main__":
    sys.exit(main())
