"""Reproducible hash buckets for splitting and shuffling.

A row's bucket depends only on its key values and the seed, never on
partitioning or on which executor computed it, so re-execution after a lost
executor and re-reads give the same assignment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(columns: Sequence[str], seed: int | str, salt: str | None = None) -> Column:
    parts = [F.lit(str(seed))]
    if salt:
        parts.append(F.lit(salt))
    parts.extend(F.col(c).cast("string") for c in columns)
    return F.concat_ws("|", *parts)


def hash_bucket(columns: Sequence[str], seed: int | str, buckets: int = 1000, salt: str | None = None) -> Column:
    """``pmod(int(first 8 hex digits of md5(key)), buckets)``."""
    digest = F.substring(F.md5(hash_key(columns, seed, salt)), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(buckets))


def thresholds(ratios: Sequence[float], buckets: int) -> list[int]:
    """Cumulative integer bucket bounds for the ratios (the last is ``buckets``)."""
    total = 0.0
    out = []
    for r in ratios:
        total += r
        out.append(int(round(total * buckets)))
    out[-1] = buckets
    return out


def bucket_label(bucket: Column, ratios: Sequence[float], names: Sequence[str], buckets: int = 1000) -> Column:
    bounds = thresholds(ratios, buckets)
    expr = None
    for bound, name in zip(bounds[:-1], names[:-1]):
        expr = F.when(bucket < bound, F.lit(name)) if expr is None else expr.when(bucket < bound, F.lit(name))
    last = F.lit(names[-1])
    return last if expr is None else expr.otherwise(last)


def shuffle_key(columns: Sequence[str], seed: int | str) -> Column:
    """Full md5 hex of ``seed|key``: ordering by it is a reproducible shuffle."""
    return F.md5(hash_key(columns, seed, "shuffle"))
