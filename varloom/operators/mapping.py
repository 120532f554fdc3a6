"""Transcript → protein mapping and the joins that restrict and map variants.

Joins are plain equi joins; adaptive execution picks broadcast only when the
measured size of a side is under the broadcast threshold, and splits skewed
partitions of the large side otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.constants import (
    ACCESSION_MISSING,
    ACCESSION_PROTEIN_COL,
    ACCESSION_RNA_COL,
    ACCESSION_STATUS_COL,
    ACCESSION_STATUSES,
)


def transcript_map(accessions: DataFrame, statuses=ACCESSION_STATUSES, missing: str = ACCESSION_MISSING) -> DataFrame:
    """Distinct ``(NM_transcript, NP_transcript)`` pairs of reviewed/validated rows."""
    return (
        accessions.filter(F.col(ACCESSION_STATUS_COL).isin(list(statuses)))
        .select(
            F.col(f"`{ACCESSION_RNA_COL}`").alias("NM_transcript"),
            F.col(f"`{ACCESSION_PROTEIN_COL}`").alias("NP_transcript"),
        )
        .filter((F.col("NM_transcript") != missing) & (F.col("NP_transcript") != missing))
        .distinct()
    )


def restrict_to_ids(variants: DataFrame, ids: DataFrame, key: str = "VariationID") -> DataFrame:
    """Variants whose id occurs in ``ids``. A semi join: ids repeated in the
    VCF do not multiply variant rows. The ids are made distinct first, which
    combines map-side, so an id repeated in a third of the file ships once per
    map task rather than to one reducer in full."""
    return variants.join(ids.select(key).distinct(), on=key, how="left_semi")


def _unversioned(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[0-9]+$", "")


def _map_condition(variants: DataFrame, tmap: DataFrame, ignore_version: bool) -> Column:
    left, right = variants["transcription"], tmap["NM_transcript"]
    if ignore_version:
        return _unversioned(left) == _unversioned(right)
    return left == right


def map_to_proteins(
    variants: DataFrame, tmap: DataFrame, ignore_version: bool = False, keep_unmapped: bool = False
) -> DataFrame:
    """Variants with their protein accession(s); a transcript with several proteins fans out.

    Names without a transcript carry ``''``, which maps to nothing: they are
    dropped before the join, or that one key would ship them all to one task.

    With ``ignore_version`` the map's pairs are first made distinct on the
    unversioned transcript, so a transcript listed under several versions maps
    each variant to each protein once; ``NM_transcript`` is then the variant's
    own transcript. With ``keep_unmapped`` the variants that have a transcript, but none in
    the map, stay, with null map columns.
    """
    how = "left" if keep_unmapped else "inner"
    variants = variants.filter(F.col("transcription") != "")
    tmap = tmap.filter(F.col("NM_transcript") != "")
    if not ignore_version:
        return variants.join(tmap, _map_condition(variants, tmap, False), how)
    pairs = tmap.select(_unversioned(F.col("NM_transcript")).alias("__nm"), "NP_transcript").distinct()
    joined = variants.join(pairs, _unversioned(variants["transcription"]) == pairs["__nm"], how)
    return joined.select(*variants.columns, F.col("transcription").alias("NM_transcript"), "NP_transcript")


def unmapped_variants(variants: DataFrame, tmap: DataFrame, ignore_version: bool = False) -> DataFrame:
    """Variants whose transcript has no protein in the map (what the mapping drops)."""
    tmap = tmap.filter(F.col("NM_transcript") != "")
    # '' maps to nothing: such rows skip the join, where one key would ship them all to one task.
    named, nameless = (variants.filter(c) for c in (F.col("transcription") != "", F.coalesce(F.col("transcription"), F.lit("")) == ""))
    return named.join(tmap, _map_condition(named, tmap, ignore_version), "left_anti").unionByName(nameless)
