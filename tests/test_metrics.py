"""Scoring metrics against numpy brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from varloom.functions.scoring import predicted_label
from varloom.operators import metrics
from varloom.operators.metrics import batch_mean_loss, best_epoch, best_trial, report, score_rows


def _bce(x, y):
    p = 1.0 / (1.0 + math.exp(-x))
    return -(y * math.log(p) + (1 - y) * math.log(1 - p))


def test_report_and_losses(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", "m1" if i % 3 else "m2", int(i // 7), float(rng.normal(0, 2)), int(rng.integers(0, 2)))
            for i in range(200)]
    df = spark.createDataFrame(rows, "key string, model string, batch_id int, logit double, label int")
    scored = score_rows(df)
    got = {r["model"]: r for r in report(scored).collect()}
    for model in ("m1", "m2"):
        sub = [r for r in rows if r[1] == model]
        correct = sum(1 for r in sub if (1.0 / (1.0 + math.exp(-r[3])) > 0.5) == (r[4] == 1))
        loss = np.mean([_bce(r[3], r[4]) for r in sub])
        assert got[model]["n"] == len(sub)
        assert got[model]["n_correct"] == correct
        assert abs(got[model]["accuracy"] - 100.0 * correct / len(sub)) < 1e-9
        assert abs(got[model]["mean_loss"] - loss) < 1e-9
    bm = {r["model"]: r for r in batch_mean_loss(scored).collect()}
    sub = [r for r in rows if r[1] == "m1"]
    batches = sorted({r[2] for r in sub})
    want = np.mean([np.mean([_bce(r[3], r[4]) for r in sub if r[2] == b]) for b in batches])
    assert bm["m1"]["n_batches"] == len(batches)
    assert abs(bm["m1"]["batch_mean_loss"] - want) < 1e-9


def test_bce_is_stable_for_large_logits(spark):
    df = spark.createDataFrame([("a", 800.0, 1), ("b", -800.0, 1), ("c", 800.0, 0)], "key string, logit double, label int")
    got = {r["key"]: r["loss"] for r in score_rows(df).collect()}
    assert got["a"] == 0.0 and abs(got["b"] - 800.0) < 1e-9 and abs(got["c"] - 800.0) < 1e-9


def test_best_epoch_takes_earliest_on_ties(spark):
    runs = spark.createDataFrame(
        [(1, 0, 0.5, 50.0), (1, 1, 0.3, 60.0), (1, 2, 0.3, 70.0), (2, 0, 0.2, 10.0), (2, 1, None, 20.0)],
        "trial int, epoch int, loss double, accuracy double",
    )
    got = {r["trial"]: (r["best_epoch"], r["best_loss"]) for r in best_epoch(runs).collect()}
    assert got == {1: (1, 0.3), 2: (0, 0.2)}


def test_best_trial_uses_last_result(spark):
    runs = spark.createDataFrame(
        [(1, 0, 0.1, 90.0), (1, 1, 0.9, 10.0), (2, 0, 0.5, 50.0), (2, 1, 0.4, 60.0)],
        "trial int, epoch int, loss double, accuracy double",
    )
    assert best_trial(runs, "loss", "min").first()["trial"] == 2
    assert best_trial(runs, "accuracy", "max").first()["trial"] == 2


def test_predictions_at_the_edges(spark):
    rows = [(float("nan"), 0), (1e-17, 0), (0.0, 0), (1e-3, 1), (-1e-3, 0), (800.0, 1), (-800.0, 0), (float("inf"), 1)]
    df = spark.createDataFrame(rows, "logit double, want int")
    got = metrics.score_rows(df, label="want").select("predicted", "want").collect()
    assert all(r["predicted"] == r["want"] for r in got)
    null = spark.createDataFrame([(None,)], "logit double").select(predicted_label(F.col("logit")).alias("p"))
    assert null.first()["p"] is None


def test_last_results_of_a_repeated_epoch_are_the_largest(spark):
    rows = [(1, 2, 0.3, 5.0), (1, 2, 0.4, 1.0), (1, 1, 9.0, 9.0), (2, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "trial int, epoch int, loss double, accuracy double")
    for parts in (1, 4):
        got = {tuple(r) for r in metrics.last_results(df.repartition(parts)).collect()}
        assert got == {(1, 2, 0.4, 1.0), (2, 1, None, 1.0)}
