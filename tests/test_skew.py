"""A key holding a third of the rows: hot keys are combined map-side or split by
adaptive skew handling, never sent whole to one task."""

import pytest
from pyspark.sql import functions as F

from varloom.operators.mapping import map_to_proteins, restrict_to_ids
from varloom.operators.variation import attach_sequences

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _variants(spark, n=60000):
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.col("id").cast("string").alias("VariationID"),
        F.when(hot, F.lit("NM_HOT.1")).otherwise(F.concat(F.lit("NM_"), (F.col("id") % 3000).cast("string"), F.lit(".1"))).alias("transcription"),
        F.lit("x").alias("payload"),
    )


def _executed(df):
    df.collect()  # runs this Dataset's own adaptive plan to its final form
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return plan


def test_hot_transcript_join_is_split(skew_session):
    spark = skew_session
    variants = _variants(spark)
    tmap = spark.range(3001).select(
        F.when(F.col("id") == 3000, F.lit("NM_HOT.1")).otherwise(F.concat(F.lit("NM_"), F.col("id").cast("string"), F.lit(".1"))).alias("NM_transcript"),
        F.concat(F.lit("NP_"), F.col("id").cast("string")).alias("NP_transcript"),
    )
    out = map_to_proteins(variants, tmap)
    plan = _executed(out)
    assert "skew=true" in plan
    assert out.count() == 60000


def test_hot_protein_sequence_join_is_split(skew_session):
    spark = skew_session
    full = _variants(spark).select(
        F.when(F.col("transcription") == "NM_HOT.1", F.lit("NP_HOT")).otherwise(F.col("transcription")).alias("NP_transcript"),
        F.lit("3").alias("position"), F.lit("A").alias("REF_amino_acid"), F.lit("W").alias("ALT_amino_acid"),
    )
    seqs = spark.range(3001).select(
        F.when(F.col("id") == 3000, F.lit("NP_HOT")).otherwise(F.concat(F.lit("NM_"), F.col("id").cast("string"), F.lit(".1"))).alias("id"),
        F.lit("MKATTT").alias("sequence"),
    )
    plan = _executed(attach_sequences(full, seqs))
    assert "skew=true" in plan


def test_hot_id_is_combined_before_shuffle(skew_session):
    spark = skew_session
    variants = _variants(spark, 3000)
    ids = spark.range(90000).select(F.when(F.col("id") % 3 == 0, F.lit("0")).otherwise((F.col("id") % 3000).cast("string")).alias("VariationID"))
    plan = _executed(restrict_to_ids(variants, ids))
    final = plan.split("== Initial Plan ==")[0]
    below_exchange = final.split("Exchange hashpartitioning(VariationID", 1)[1]
    assert "HashAggregate(keys=[VariationID" in below_exchange  # combined before the shuffle
