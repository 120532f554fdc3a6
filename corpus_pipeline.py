"""A corpus pipeline of five training-data operators over ``documents``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
the documents it keeps, in the columns of ``documents``; the last returns the mix.
Each result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import decontam, lines, minhash, mixing, toxicity
from varloom.llm.common import Scratch, table, unused

#: Not expressible in SQL: a fitted classifier comes first. Tests hold each stage against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, fitted as in the toxicity query."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return toxicity.score_documents(docs, model, score).filter(F.col(score) < 0.5).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; those left empty go."""
    return lines.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), the smallest doc_id."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark text go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the mix."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
