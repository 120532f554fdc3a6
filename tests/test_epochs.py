"""Warm-started epochs, the best epoch's model, and successive halving."""

import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from varloom.operators import descent, epochs, fit
from varloom.operators.metrics import best_epoch


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(Vectors.sparse(6, [i % 3, 3 + i % 2], [1.0, 1.0]), float((i % 3 == 0) ^ (i % 11 == 0))) for i in range(330)]
    df = spark.createDataFrame(rows, ["features", "label"]).repartition(2).cache()
    df.count()
    return df.limit(250).cache(), df.subtract(df.limit(0)).limit(80).cache()


def small(**options):
    return fit.perceptron(n=3, hidden=(), **options)


def test_an_epoch_continues_where_the_last_ended(parts):
    train, validation = parts
    run = epochs.fit_epochs(train, validation, small(solver="gd"), epochs=3, steps=2, trial=7)
    rows = run.runs.orderBy("epoch").collect()
    assert [(r["trial"], r["epoch"]) for r in rows] == [(7, 1), (7, 2), (7, 3)]
    # With a constant step, two epochs of gradient descent go on from the first one's weights.
    one = epochs.fit_epochs(train, validation, small(solver="gd"), epochs=1, steps=2).last
    two = epochs.fit_epochs(train, validation, small(solver="gd"), epochs=2, steps=2, start=one).last
    assert two.weights.toArray() == pytest.approx(run.last.weights.toArray(), abs=1e-12)
    assert rows[2]["loss"] < rows[0]["loss"]


def test_the_best_epochs_model_is_kept_and_reloads(spark, parts, tmp_path):
    train, validation = parts
    run = epochs.fit_epochs(train, validation, small(solver="gd").setStepSize(40.0), epochs=5)
    told = best_epoch(run.runs).first()
    assert run.best == told["best_epoch"] and told["n_epochs"] == 5
    fit.save_model(run.model, str(tmp_path / "m"))
    again = fit.load_model(spark, str(tmp_path / "m"))
    logits = lambda m: [r[0] for r in fit.logits(m, validation).select("logit").collect()]
    assert logits(again) == logits(run.model)
    loss = fit.validation_scores({0: again}, validation).agg(F.avg("loss")).first()[0]
    assert loss == pytest.approx(told["best_loss"], abs=1e-12)


def test_halving_stops_weak_trials_and_replays(parts):
    train, validation = parts
    estimator = small(solver="gd")
    maps = [{estimator.stepSize: s} for s in (1e-9, 0.5, 1e-7, 0.1, 1e-5, 0.03, 1e-3)]
    result = epochs.successive_halving(train, validation, estimator, keep=3, param_maps=maps)
    runs = result.runs.collect()
    by_rung = {}
    for r in runs:
        by_rung.setdefault(r["rung"], {})[r["trial"]] = r
    assert {k: len(v) for k, v in by_rung.items()} == {0: 7, 1: 3, 2: 1}
    assert {k: {r["epoch"] for r in v.values()} for k, v in by_rung.items()} == {0: {1}, 1: {3}, 2: {9}}
    for rung in (0, 1):  # a plain replay of the metrics
        ranked = sorted(by_rung[rung].values(), key=lambda r: (r["loss"], r["trial"]))
        assert {r["trial"] for r in ranked[: epochs.survivors(len(ranked), 3)]} == set(by_rung[rung + 1])
    assert set(by_rung[2]) == {result.survivor} == {1}
    told = {(r["rung"], r["trial"]): r["goes_on"] for r in epochs.replay(result.runs, 3).collect()}
    assert all(told[rung, t] == (t in by_rung.get(rung + 1, {result.survivor})) for rung, ts in by_rung.items() for t in ts)
    # The survivor's nine epochs are one and the same run.
    alone = epochs.fit_epochs(train, validation, estimator.copy(maps[1]), epochs=9).last
    assert alone.weights.size == result.model.weights.size


@pytest.mark.parametrize("hidden", [(), (4, 3)])
def test_descent_on_sparse_rows_equals_sparks_own(spark, hidden):
    """One partition of whole blocks: Spark's mean over blocks is the mean over rows there."""
    rows = [(Vectors.sparse(6, [i % 3, 3 + i % 2], [1.0, 2.0]) if i % 5 else Vectors.dense([i % 4, 0, 1, 0, 0, 2]), float(i % 3 == 0)) for i in range(256)]
    train = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    estimator = fit.perceptron(n=3, hidden=hidden, solver="gd", max_iter=5).setStepSize(0.3)
    own = estimator.fit(train)
    found = descent.descend(train.repartition(3), {0: estimator, 1: estimator.copy({estimator.stepSize: 0.1})}, {0: None, 1: None}, 5)
    assert found[0].weights.toArray() == pytest.approx(own.weights.toArray(), abs=1e-9)
    assert found[1].weights.toArray() != pytest.approx(own.weights.toArray(), abs=1e-3)
    more = descent.descend(train, {0: estimator}, {0: found[0]}, 2)[0]
    again = estimator.copy({estimator.maxIter: 2, estimator.initialWeights: own.weights}).fit(train)
    assert more.weights.toArray() == pytest.approx(again.weights.toArray(), abs=1e-9)


def test_halving_keeps_no_dense_rows(spark, parts, monkeypatch):
    """Spark's own fit sees no training row: it would keep each as a dense copy."""
    train, validation = parts
    fitted = []
    real = MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, df, *a: fitted.append(df.count()) or real(self, df, *a))
    estimator = small(solver="gd")
    epochs.successive_halving(train, validation, estimator, keep=2, param_maps=[{estimator.stepSize: s} for s in (0.5, 0.1)])
    assert fitted and set(fitted) == {1}


def test_a_step_size_is_drawn_for_perceptrons():
    est = fit.perceptron(solver="gd")
    maps = fit.random_param_maps(est, trials=40)
    steps = [m[est.stepSize] for m in maps]
    assert all(1e-5 <= s <= 1e-2 for s in steps) and len(set(steps)) == 40 and min(steps) < 1e-4 < 1e-3 < max(steps)
    assert maps == fit.random_param_maps(est, trials=40)
    plain = fit.perceptron(hidden=())
    assert all(m[plain.layers] == [4096, 2] for m in fit.random_param_maps(plain, trials=3))


def test_halving_needs_a_real_rung(parts):
    with pytest.raises(ValueError, match="2 or more"):
        epochs.successive_halving(*parts, keep=1)
