"""Tables bucketed on the protein key.

The full dataset, its sequence join and the ML context all go by protein. Written in
buckets of the protein key, the full table and the sequence table join without an
exchange, and the ML rows (one aggregate, one collect and one join back, all on keys that
hold the protein) reuse the same buckets.

A bucketed scan has one task a bucket, so a protein with very many rows makes one long
task that adaptive execution does not split; the plain layout, which does, stays the
default. ``buckets`` follows the larger table: about 256 MB a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.constants import MAX_SEQUENCE_LENGTH, SPLIT_SEED
from varloom.operators import context as ctx_ops
from varloom.operators import phenotypes, split, variation
from varloom.plans.sinks import session_conf

PROTEIN, SEQUENCE_ID = "NP_transcript", "id"

#: Joins may use buckets on a part of their keys, and bucketed scans stay bucketed.
BUCKET_CONF = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` under ``path`` as a catalogue table in sorted buckets of ``key``; one file a bucket. Returns the table."""
    (
        df.repartition(buckets, key).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    )
    return df.sparkSession.table(table)


def sequenced(full: DataFrame, sequences: DataFrame) -> DataFrame:
    """JOB5's sequence join of two tables bucketed alike on the protein."""
    return variation.attach_sequences(full, sequences)


def context_rows(full: DataFrame, scope: str = "within_split", seed: int = SPLIT_SEED, n: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    """JOB6's sparse rows from a full table bucketed on the protein (split by protein row, as ``assign_split``)."""
    return ctx_ops.context_positions(split.assign_split(phenotypes.ml_rows(full, n), seed=seed), scope=scope)


def bucket_session(spark: SparkSession):
    """The settings under which plans over bucketed tables are made; hold it around the action."""
    return session_conf(spark, BUCKET_CONF)
