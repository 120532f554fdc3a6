"""Reproducible splits and shuffles.

A split is a column computed from a hash of a business key, so one lineage
yields all parts, a re-run or a recomputed partition yields the same parts, and
rows sharing a key never straddle parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from varloom.constants import (
    ML_KEY_COLUMNS,
    SPLIT_NAMES,
    SPLIT_RATIOS,
    SPLIT_SEED,
    TWO_WAY_NAMES,
    TWO_WAY_RATIOS,
)
from varloom.functions.hashing import bucket_label, hash_bucket, shuffle_key

RATIO_TOLERANCE = 0.001

# Key choices: the row triple (one variant-phenotype row per key, as the original
# row-level split); the variant, which keeps all phenotype rows of a variant in
# one part; or the protein, which keeps every row of a protein in one part.
SPLIT_KEYS = {
    "row": ML_KEY_COLUMNS,
    "variant": ("NP_transcript", "position"),
    "protein": ("NP_transcript",),
}


def check_ratios(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) >= RATIO_TOLERANCE:
        raise ValueError(f"split ratios {tuple(ratios)} add up to {sum(ratios)}, not to 1")


def assign_split(
    df: DataFrame,
    key: Sequence[str] | str = "row",
    ratios: Sequence[float] = SPLIT_RATIOS,
    names: Sequence[str] = SPLIT_NAMES,
    seed: int = SPLIT_SEED,
    buckets: int = 1000,
    salt: str | None = None,
    col: str = "split",
) -> DataFrame:
    """Add ``col`` naming the part of each row; parts follow ``ratios``."""
    check_ratios(ratios)
    if len(ratios) != len(names):
        raise ValueError("one name per ratio")
    key_cols = SPLIT_KEYS[key] if isinstance(key, str) else tuple(key)
    bucket = hash_bucket(key_cols, seed, buckets, salt)
    return df.withColumn(col, bucket_label(bucket, ratios, names, buckets))


def assign_two_way(
    df: DataFrame,
    key: Sequence[str] | str = "row",
    ratios: Sequence[float] = TWO_WAY_RATIOS,
    names: Sequence[str] = TWO_WAY_NAMES,
    seed: int = SPLIT_SEED,
    col: str = "fit_split",
) -> DataFrame:
    """Second-level train/validation split of the training rows, independent of the first."""
    return assign_split(df, key, ratios, names, seed, salt="fit", col=col)


def reproducible_shuffle(
    df: DataFrame, key: Sequence[str] | str = "row", seed: int = SPLIT_SEED, col: str = "shuffle_key"
) -> DataFrame:
    """Rows ordered by a seeded hash of their key (a range-partitioned global sort)."""
    key_cols = SPLIT_KEYS[key] if isinstance(key, str) else tuple(key)
    return df.withColumn(col, shuffle_key(key_cols, seed)).orderBy(col, *key_cols)
