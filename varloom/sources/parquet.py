"""Parquet reads with projection and predicate pushdown left to the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.constants import SCORE_BATCH_SIZE


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_features(
    spark: SparkSession,
    path: str,
    features: Sequence[str],
    target: str,
    splits: Sequence[str] | None = None,
) -> DataFrame:
    """Feature columns plus target, pruned at the scan.

    When the table is partitioned by ``split``, ``splits`` prunes partitions.
    """
    df = spark.read.parquet(path)
    if splits is not None:
        df = df.filter(F.col("split").isin(list(splits)))
    return df.select(*features, target)


def map_feature_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    batch_size: int = SCORE_BATCH_SIZE,
) -> DataFrame:
    """Apply ``fn`` to batches of ``batch_size`` rows of each partition, on the executors.

    Only the last batch of a partition may be shorter. A batch is all that ``fn`` holds.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for part in parts:
            while len(part):
                piece, part = part.iloc[: batch_size - rows], part.iloc[batch_size - rows :]
                held.append(piece)
                rows += len(piece)
                if rows == batch_size:
                    yield fn(pd.concat(held, ignore_index=True))
                    held, rows = [], 0
        if rows:
            yield fn(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)
