"""Classifier evaluation as Spark aggregations over a scores table.

A scores table has one row per (example, model): a ``logit`` and a 0/1
``label``, plus any grouping columns (``model``, ``split``, ``batch_id``).
Every report is one group aggregate with partial (map-side) aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.scoring import bce_with_logits, predicted_label


def score_rows(scores: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """Add ``predicted`` (sigmoid > 0.5), ``correct`` and the per-row BCE ``loss``."""
    pred = predicted_label(F.col(logit))
    return scores.withColumns(
        {
            "predicted": pred,
            "correct": (pred == F.col(label).cast("int")).cast("int"),
            "loss": bce_with_logits(F.col(logit), F.col(label)),
        }
    )


def report(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Count, correct count, accuracy in percent, and row-mean loss per group."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").cast("long").alias("n_correct"),
        (F.lit(100.0) * F.sum("correct") / F.count(F.lit(1))).alias("accuracy"),
        F.avg("loss").alias("mean_loss"),
    )


def batch_mean_loss(scored: DataFrame, by: Sequence[str] = ("model",), batch_col: str = "batch_id") -> DataFrame:
    """Mean of per-batch mean losses (a short last batch weighs as much as a full
    one), beside the row mean."""
    per_batch = scored.groupBy(*by, batch_col).agg(
        F.avg("loss").alias("__batch_loss"),
        F.count(F.lit(1)).alias("__n"),
        F.sum("loss").alias("__sum"),
    )
    return per_batch.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.avg("__batch_loss").alias("batch_mean_loss"),
        (F.sum("__sum") / F.sum("__n")).alias("row_mean_loss"),
    )


def last_results(runs: DataFrame, trial: str = "trial", epoch: str = "epoch") -> DataFrame:
    """Each trial's row at its last epoch (of rows that repeat that epoch, the largest by its metrics)."""
    metrics = [c for c in runs.columns if c not in (trial, epoch)]
    last = runs.groupBy(trial).agg(F.max(F.struct(epoch, *metrics)).alias("__last"))
    return last.select(trial, *[F.col("__last").getField(c).alias(c) for c in (epoch, *metrics)])


def best_trial(
    runs: DataFrame, metric: str = "loss", mode: str = "min", trial: str = "trial", epoch: str = "epoch"
) -> DataFrame:
    """The trial whose last result is best on ``metric`` (ties: lowest trial id).

    A top-1 pick: a partial top-k per partition, then one final row.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode must be 'min' or 'max'")
    last = last_results(runs, trial, epoch)
    order = F.col(metric).asc_nulls_last() if mode == "min" else F.col(metric).desc_nulls_last()
    return last.orderBy(order, F.col(trial).asc()).limit(1)


def best_epoch(runs: DataFrame, by: Sequence[str] = ("trial",), metric: str = "loss", epoch: str = "epoch") -> DataFrame:
    """Per run, the earliest epoch with the lowest ``metric`` (an improvement must be strict)."""
    valid = runs.filter(F.col(metric).isNotNull())
    return valid.groupBy(*by).agg(
        F.min_by(F.col(epoch), F.struct(F.col(metric), F.col(epoch))).alias("best_epoch"),
        F.min(metric).alias(f"best_{metric}"),
        F.count(F.lit(1)).alias("n_epochs"),
    )
