"""Reproducible one-row-per-key dedupe.

``dropDuplicates`` keeps an arbitrary row. Here the kept row is the smallest
under a total order (the ``order`` columns first, then every other column, nulls
first). It is written as a group aggregate ``min(struct(...))`` rather than a
``row_number`` window: the aggregate combines map-side, so a key that holds a
third of all rows is reduced to one row per map task before the shuffle instead
of being sorted whole in one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW = "__kept_row"


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    keys = list(keys)
    order = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(f"`{c}`").alias(c) for c in order + rest])
    kept = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(packed).alias(_ROW))
    return kept.select(
        *[F.col(f"`{c}`") if c in keys else F.col(_ROW).getField(c).alias(c) for c in df.columns]
    )
