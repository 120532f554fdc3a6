"""Variant-summary operators: row filter, feature columns, one row per variation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.constants import (
    VARIANT_ASSEMBLY,
    VARIANT_CLINICAL_SIGNIFICANCES,
    VARIANT_REVIEW_STATUSES,
    VARIANT_SUMMARY_COLUMNS,
    VARIANT_TYPE,
)
from varloom.functions.hgvs import with_name_parts
from varloom.operators.dedupe import keep_first

# Tie-break for one row per VariationID: these first, then every other column.
VARIATION_ORDER = ("Name", "PhenotypeList", "PhenotypeIDS", "ReviewStatus", "ClinSigSimple", "GeneSymbol")


def variant_condition(
    variant_type: str = VARIANT_TYPE,
    assembly: str = VARIANT_ASSEMBLY,
    review_statuses: Sequence[str] = VARIANT_REVIEW_STATUSES,
    significances: Sequence[str] = VARIANT_CLINICAL_SIGNIFICANCES,
) -> Column:
    return (
        (F.col("Type") == variant_type)
        & (F.col("Assembly") == assembly)
        & F.col("ReviewStatus").isin(list(review_statuses))
        & F.col("ClinicalSignificance").isin(list(significances))
    )


def filter_variants(df: DataFrame, **condition) -> DataFrame:
    """SNVs on the chosen assembly with an accepted review status and significance."""
    return df.filter(variant_condition(**condition))


def variant_features(df: DataFrame) -> DataFrame:
    """Seven base columns, the label as int, one row per ``VariationID``, name parts.

    The name parts are functions of ``Name`` alone, so they are computed after
    the dedupe, on fewer rows, with the same result.
    """
    base = df.select(*VARIANT_SUMMARY_COLUMNS).withColumn(
        "ClinSigSimple", F.col("ClinSigSimple").try_cast("int")
    )
    one_per_id = keep_first(base, ["VariationID"], VARIATION_ORDER)
    return with_name_parts(one_per_id, "Name")


def variant_summary_features(df: DataFrame, **condition) -> DataFrame:
    """Filter then features (the whole variant-summary step)."""
    return variant_features(filter_variants(df, **condition))
