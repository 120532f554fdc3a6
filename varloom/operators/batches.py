"""Global row numbers and full-size batches in a seeded order.

A loader that cuts each file or partition into batches leaves a short batch at each end.
Here the rows of a whole table (or of each part of it) are numbered in one order, so every
batch but the last of a part has the same size, whatever the files and partitions.

Numbering takes two passes and no global sort in one task: the rows are range-partitioned
and sorted within partitions, and written once with their partition and place; then the
partitions' counts give prefix sums, one number a partition, that are added to the places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.constants import SCORE_BATCH_SIZE, SPLIT_SEED
from varloom.functions.hashing import shuffle_key
from varloom.operators.split import SPLIT_KEYS
from varloom.session import importable, stage

#: ``monotonically_increasing_id`` holds the place within a partition in its lower bits.
_PLACE_BITS = 33


def number_rows(rows: DataFrame, order: Sequence[Column | str], col: str = "row_number") -> DataFrame:
    """``rows`` with their number from 0 in ``order`` (nulls first). Rows that tie get numbers in some order of their own."""
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(
        ranged.withColumns(
            {
                "__part": F.shiftright(at, _PLACE_BITS),
                "__place": at.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
            }
        ),
        "numbered",
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")
    )
    # One row a partition: the window and the broadcast are as small as the shuffle is wide.
    numbered = staged.join(F.broadcast(bases), "__part")
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__base") + F.col("__place")).alias(col))


def assign_batches(
    rows: DataFrame,
    size: int = SCORE_BATCH_SIZE,
    by: Sequence[str] = ("split",),
    key: Sequence[str] | str = "row",
    seed: int = SPLIT_SEED,
    col: str = "batch_id",
) -> DataFrame:
    """``rows`` with ``col``: batches of ``size`` rows in the seeded order, numbered from 0 within each part ``by``.

    ``key`` names the columns that tell rows apart. The parts (train, val, test) are few:
    their first numbers are broadcast.
    """
    key_cols = SPLIT_KEYS[key] if isinstance(key, str) else tuple(key)
    numbered = number_rows(rows, [*by, shuffle_key(key_cols, seed), *key_cols], "__row")
    if not by:
        return numbered.withColumn(col, F.floor(F.col("__row") / size)).drop("__row")
    first = numbered.groupBy(*by).agg(F.min("__row").alias("__first"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    joined = numbered.alias("r").join(F.broadcast(first.alias("p")), same)
    return joined.select("r.*", "__first").withColumn(col, F.floor((F.col("__row") - F.col("__first")) / size)).drop("__row", "__first")


def map_global_batches(
    batched: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: Sequence[str] = ("split",), col: str = "batch_id"
) -> DataFrame:
    """Apply ``fn`` to each whole batch of an :func:`assign_batches` table, on the executors; a batch is all it holds."""
    importable(batched.sparkSession)
    return batched.groupBy(*by, col).applyInPandas(fn, schema)
