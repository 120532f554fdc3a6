"""Epoch-wise fits with warm starts, and successive halving over them.

Spark ML's feed-forward classifier takes initial weights, so a fit can be taken up where
another one ended: an epoch is a fit of ``steps`` iterations from the last epoch's
weights. After each epoch the model is scored on the validation rows in one pass, and a
row (trial, epoch, loss, accuracy) is noted; the best epoch's model is kept. With
``hidden=()`` the network is a softmax regression, which Spark's own logistic regression
cannot continue.

Successive halving gives every trial few epochs, keeps the better part, and gives those
more, so weak draws stop early. A rung's trials of gradient descent (solver ``gd``) are
fitted together on sparse rows (:mod:`varloom.operators.descent`), others each by Spark's
own fit, which holds dense copies of the rows. All of a rung's models are scored in one pass over the
validation rows; the metrics table alone tells who went on (:func:`replay`).

The driver holds the trials' weights between rungs, and of the training data nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from varloom.constants import SEARCH_TRIALS, SPLIT_SEED
from varloom.operators.descent import descend
from varloom.operators.fit import perceptron, random_param_maps, validation_scores
from varloom.operators.metrics import best_epoch, report

RUN_SCHEMA = "trial int, epoch int, loss double, accuracy double"


@dataclass
class EpochRun:
    """One (trial, epoch, loss, accuracy) row an epoch, the best epoch's number and model, and the last model."""

    runs: DataFrame
    best: int
    model: Model
    last: Model


def _continued(estimator: MultilayerPerceptronClassifier, steps: int, before: Model | None, params: dict | None = None):
    """The estimator for ``steps`` iterations more, from a model's weights on (None: from its seed)."""
    extra = {**(params or {}), estimator.maxIter: steps}
    if before is not None:
        extra[estimator.initialWeights] = before.weights
    return estimator.copy(extra)


def _losses(models: dict[int, Model], validation: DataFrame) -> dict[int, tuple[float | None, float | None]]:
    """(mean loss, accuracy) of each model, from one pass over the validation rows."""
    found = {r["trial"]: r for r in report(validation_scores(models, validation), by=["trial"]).collect()}
    return {t: (found[t]["mean_loss"], found[t]["accuracy"]) if t in found else (None, None) for t in models}


def fit_epochs(
    train: DataFrame,
    validation: DataFrame,
    estimator: MultilayerPerceptronClassifier | None = None,
    epochs: int = 10,
    steps: int = 1,
    trial: int = 0,
    start: Model | None = None,
) -> EpochRun:
    """``epochs`` warm-started fits of ``steps`` iterations each; the earliest epoch with the lowest loss is kept."""
    estimator = estimator or perceptron()
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    rows, kept, model = [], None, start
    try:
        for epoch in range(1, epochs + 1):
            model = _continued(estimator, steps, model).fit(train)
            loss, accuracy = _losses({trial: model}, validation)[trial]
            rows.append((trial, epoch, loss, accuracy))
            if kept is None or (loss is not None and (kept[1] is None or loss < kept[1])):
                kept = (epoch, loss, model)
    finally:
        train.unpersist()
    runs = train.sparkSession.createDataFrame(rows, RUN_SCHEMA)
    # The pick is the operator's own, over the table that is published; the model kept on the way is that epoch's.
    picked = best_epoch(runs).first()
    best = picked["best_epoch"] if picked else kept[0]
    if best != kept[0]:
        raise RuntimeError(f"epoch {kept[0]}'s model was kept, but the metrics name epoch {best}")
    return EpochRun(runs, best, kept[2], model)


@dataclass
class HalvingResult:
    """trial, rung, epoch, loss, accuracy and the drawn parameters, the surviving trial and its model."""

    runs: DataFrame
    survivor: int
    model: Model


HALVING_SCHEMA = "trial int, rung int, epoch int, loss double, accuracy double, step_size double, layers string"


def survivors(n: int, keep: int) -> int:
    """How many of ``n`` trials a rung passes on: one in ``keep``, at least one."""
    return max(1, math.ceil(n / keep))


def successive_halving(
    train: DataFrame,
    validation: DataFrame,
    estimator: MultilayerPerceptronClassifier | None = None,
    trials: int = SEARCH_TRIALS,
    keep: int = 4,
    first_epochs: int = 1,
    seed: int = SPLIT_SEED,
    parallelism: int = 4,
    param_maps: Sequence[dict] | None = None,
) -> HalvingResult:
    """Rung r trains its trials up to ``first_epochs * keep**r`` epochs and passes on one in ``keep`` by loss.

    Ties go to the lower trial; a trial without a loss comes last. The last rung has one trial.
    """
    if keep < 2:
        raise ValueError("keep must be 2 or more")
    estimator = estimator or perceptron(solver="gd")
    maps = list(param_maps) if param_maps is not None else random_param_maps(estimator, trials, seed)
    models: dict[int, Model | None] = {t: None for t in range(len(maps))}
    rows, rung, done = [], 0, 0
    nets = {t: estimator.copy(m) for t, m in enumerate(maps)}
    by_descent = all(net.getSolver() == "gd" for net in nets.values())
    if not by_descent:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while True:
            epoch = first_epochs * keep**rung

            def fit(trial: int, steps: int = epoch - done) -> Model:
                return _continued(estimator, steps, models[trial], maps[trial]).fit(train)

            if by_descent:
                models = descend(train, {t: nets[t] for t in models}, models, epoch - done)
            else:
                with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
                    models = dict(zip(models, pool.map(fit, models)))
            losses = _losses(models, validation)
            for t, (loss, accuracy) in losses.items():
                rows.append((t, rung, epoch, loss, accuracy, nets[t].getStepSize(), ",".join(map(str, nets[t].getLayers()))))
            if len(models) == 1:
                break
            ranked = sorted(models, key=lambda t: (losses[t][0] is None, losses[t][0], t))
            models = {t: models[t] for t in sorted(ranked[: survivors(len(models), keep)])}
            rung, done = rung + 1, epoch
    finally:
        if not by_descent:
            train.unpersist()
    survivor, model = next(iter(models.items()))
    return HalvingResult(train.sparkSession.createDataFrame(rows, HALVING_SCHEMA), survivor, model)


def replay(runs: DataFrame, keep: int = 4) -> DataFrame:
    """rung, trial and ``goes_on`` by the metrics table alone: who should have been in the next rung.

    ``runs`` has a few rows a trial; ranks are taken per rung.
    """
    rank = F.row_number().over(Window.partitionBy("rung").orderBy(F.col("loss").asc_nulls_last(), "trial"))
    n = F.count(F.lit(1)).over(Window.partitionBy("rung"))
    return runs.select(
        "rung", "trial", (rank <= F.greatest(F.lit(1), F.ceil(n / keep))).alias("goes_on"), n.alias("n_trials")
    )
