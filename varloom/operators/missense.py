"""VCF operators: missense filter, id list, id counts, duplicate report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.constants import MISSENSE_TERM, VCF_CONSEQUENCE_KEY


def info_value(info: Column, key: str) -> Column:
    """Raw value of the first ``key=`` entry of a VCF INFO field; ``''`` when absent.

    Anchored on ``;`` so ``XMC=`` does not match ``MC=``; repeated keys never fail.
    """
    return F.regexp_extract(F.concat(F.lit(";"), info), f";{key}=([^;]*)", 1)


def has_consequence(info: Column, term: str = MISSENSE_TERM, key: str = VCF_CONSEQUENCE_KEY) -> Column:
    """Any comma-separated value of ``key`` contains ``term``.

    ``term`` holds no comma, so containment in any value equals containment in
    the joined value; a null INFO is false.
    """
    return F.coalesce(info_value(info, key).contains(term), F.lit(False))


def missense_ids(vcf: DataFrame, term: str = MISSENSE_TERM) -> DataFrame:
    """``VariationID`` of every record with a missense consequence (duplicates kept)."""
    return vcf.filter(has_consequence(F.col("INFO"), term)).select(F.col("ID").alias("VariationID"))


def id_counts(ids: DataFrame, col: str = "VariationID") -> DataFrame:
    return ids.agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.count_distinct(F.col(col)).alias("n_distinct_ids"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
