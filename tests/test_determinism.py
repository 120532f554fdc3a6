"""Results do not depend on partitioning: what a recomputation after a lost
executor (or a different cluster width) produces is the same rows."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from varloom.functions.vectors import join_ints
from varloom.plans import jobs, queries as q


def _run(spark, shuffle_partitions, adaptive):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        full = q.full_variation_sequences(spark, SF_SMALL)
        ml = jobs.ml_frame(q._full(spark, SF_SMALL)).withColumn("context_positions", join_ints(F.col("context_positions")))
        return sorted(map(tuple, full.collect())), sorted(map(tuple, ml.collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_same_rows_under_different_partitioning(spark):
    a = _run(spark, 3, "true")
    b = _run(spark, 13, "false")
    assert a[0] == b[0] and len(a[0]) > 0
    assert a[1] == b[1] and len(a[1]) > 0
