"""One row per (protein, position, phenotype) for machine learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.constants import (
    MAX_SEQUENCE_LENGTH,
    ML_BASE_COLUMNS,
    ML_KEY_COLUMNS,
    PHENOTYPE_PLACEHOLDERS,
    PHENOTYPE_SEPARATOR,
)
from varloom.functions.sequence import position_index
from varloom.operators.dedupe import keep_first

# Tie-break for one row per (protein, position, phenotype): these first, then the rest.
PHENOTYPE_ROW_ORDER = ("name", "is_pathogenic")


def phenotype_rows(full: DataFrame, n: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    """Five ML columns, one row per phenotype of the pipe-separated list.

    A null list yields no row, an empty list one empty phenotype. Rows keep a
    position in ``[1, n]`` (non-integer text is dropped, never an error) and a
    phenotype other than the placeholders (exact, case-sensitive match).
    """
    pos = position_index(F.col("position"))
    return (
        full.select(*ML_BASE_COLUMNS)
        .withColumn("phenotype_list", F.explode(F.split(F.col("phenotype_list"), "\\" + PHENOTYPE_SEPARATOR)))
        .filter(pos.between(1, n))
        .filter(F.col("phenotype_list").isNotNull() & ~F.col("phenotype_list").isin(list(PHENOTYPE_PLACEHOLDERS)))
    )


def dedupe_phenotype_rows(rows: DataFrame) -> DataFrame:
    """Keep one row per ``(NP_transcript, position, phenotype_list)``."""
    return keep_first(rows, ML_KEY_COLUMNS, PHENOTYPE_ROW_ORDER)


def ml_rows(full: DataFrame, n: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    return dedupe_phenotype_rows(phenotype_rows(full, n))
