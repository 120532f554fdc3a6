"""Parts of an HGVS variant name, as Column expressions (JVM-side regexes).

``NM_000059.4(BRCA2):c.1234A>G (p.Lys412Arg)`` gives transcript ``NM_000059.4``,
gene ``BRCA2``, protein change ``Lys412Arg``, reference residue ``Lys``, position
``412`` and alternate residue ``Arg``. A part that does not match is ``''``; a
null name gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.constants import (
    CHANGE_ALT_RE,
    CHANGE_POS_RE,
    CHANGE_REF_RE,
    NAME_GENE_RE,
    NAME_PROTEIN_CHANGE_RE,
    NAME_TRANSCRIPT_RE,
)


def transcript(name: Column) -> Column:
    return F.regexp_extract(name, NAME_TRANSCRIPT_RE, 1)


def gene(name: Column) -> Column:
    return F.regexp_extract(name, NAME_GENE_RE, 1)


def protein_change(name: Column) -> Column:
    return F.regexp_extract(name, NAME_PROTEIN_CHANGE_RE, 1)


def ref_residue(change: Column) -> Column:
    return F.regexp_extract(change, CHANGE_REF_RE, 1)


def change_position(change: Column) -> Column:
    return F.regexp_extract(change, CHANGE_POS_RE, 1)


def alt_residue(change: Column) -> Column:
    return F.regexp_extract(change, CHANGE_ALT_RE, 1)


def with_name_parts(df: DataFrame, name_col: str = "Name") -> DataFrame:
    """Add ``transcription, gene, SNV, REF, POS, ALT``.

    Two projection layers: the last three read ``SNV``, which is extracted once.
    """
    name = F.col(name_col)
    df = df.withColumns(
        {
            "transcription": transcript(name),
            "gene": gene(name),
            "SNV": protein_change(name),
        }
    )
    snv = F.col("SNV")
    return df.withColumns(
        {
            "REF": ref_residue(snv),
            "POS": change_position(snv),
            "ALT": alt_residue(snv),
        }
    )
