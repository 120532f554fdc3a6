"""Per-row scoring expressions for a binary classifier's logit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.constants import DECISION_THRESHOLD


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def predicted_label(logit: Column) -> Column:
    """``sigmoid(logit) > 0.5`` as 0/1, in doubles: a logit too small to move the
    sigmoid off 0.5 is 0, and so is NaN (Spark orders NaN above every number)."""
    above = sigmoid(logit) > F.lit(DECISION_THRESHOLD)
    return F.when(logit.isNull(), F.lit(None)).otherwise(above & ~F.isnan(logit)).cast("int")


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Binary cross-entropy with logits, in the overflow-safe form
    ``max(x, 0) - x*y + log(1 + exp(-|x|))``."""
    y = label.cast("double")
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))
