"""Fit and select binary pathogenicity classifiers with Spark ML.

Features are the two vectors side by side (width ``2n``): the mutation one-hot
and the context multi-hot. They are built JVM-side as a *sparse* vector by a
``CountVectorizerModel`` over a fixed positional vocabulary (``m1..mn``,
``c1..cn``), so no Python UDF and no dense 2n-wide rows are involved.

Hyper-parameter search draws seeded random parameter maps and fits them with
``fitMultiple`` on one cached training frame. All candidates are scored in one pass
over the validation rows (their logits side by side on each row) and reduced by one
group aggregate; the small result is what the best trial is picked from. The driver
holds the fitted models until then and keeps the best one, which can be saved, loaded
and scored like any other.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from varloom.constants import (
    MAX_SEQUENCE_LENGTH,
    MODEL_SIDE_NAMES,
    SEARCH_HIDDEN_LAYERS,
    SEARCH_ITERATIONS,
    SEARCH_STEP_SIZES,
    SEARCH_TRIALS,
    SPLIT_SEED,
)
from varloom.functions.sequence import position_index
from varloom.functions.vectors import feature_tokens, hot_positions, token_vocabulary
from varloom.operators.metrics import best_trial, report, score_rows

FEATURES = "features"
LABEL = "label"


def ml_rows_of(table: DataFrame) -> DataFrame:
    """Rows with ``position``, ``context_positions`` and ``is_pathogenic`` from any published ML table.

    Takes the sparse table, the dense one and the model-side one (its names and wider,
    zero-padded vectors); dense contexts go back to their positions.
    """
    published = {new: old for old, new in MODEL_SIDE_NAMES.items()}
    rows = table.withColumnsRenamed({k: v for k, v in published.items() if k in table.columns})
    if "context_positions" not in rows.columns:
        rows = rows.withColumn("context_positions", hot_positions(F.col("context_vector")))
    return rows.drop("mutation_vector", "context_vector")


def with_features(rows: DataFrame, n: int = MAX_SEQUENCE_LENGTH, context_col: str = "context_positions") -> DataFrame:
    """Add a sparse ``features`` vector of width ``2n`` and a double ``label``.

    Rows without a label cannot be fitted or scored and are left out (``unlabelled`` counts them).
    """
    rows = rows.filter(F.col("is_pathogenic").isNotNull())
    vectorizer = CountVectorizerModel.from_vocabulary(
        token_vocabulary(n), inputCol="__tokens", outputCol=FEATURES, binary=True
    )
    tokens = rows.withColumn(
        "__tokens", feature_tokens(position_index(F.col("position")), F.col(context_col))
    ).withColumn(LABEL, F.col("is_pathogenic").cast("double"))
    return vectorizer.transform(tokens).drop("__tokens")


def logistic(max_iter: int = 10, reg_param: float = 1e-5, seed: int = SPLIT_SEED) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=max_iter, regParam=reg_param, family="binomial"
    )


def perceptron(n: int = MAX_SEQUENCE_LENGTH, hidden: Sequence[int] = (512, 256, 128), max_iter: int = 10,
               seed: int = SPLIT_SEED, solver: str = "l-bfgs") -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol=FEATURES, labelCol=LABEL, layers=[2 * n, *hidden, 2], maxIter=max_iter, seed=seed, solver=solver
    )


def unlabelled(rows: DataFrame) -> int:
    """Rows that ``with_features`` leaves out."""
    return rows.filter(F.col("is_pathogenic").isNull()).count()


def logits(model: Model, df: DataFrame, col: str = "logit") -> DataFrame:
    """The model's log-odds of class 1 as ``col``; no other column is added."""
    out = model.copy({model.rawPredictionCol: "__raw", model.probabilityCol: "", model.predictionCol: ""}).transform(df)
    raw = vector_to_array(F.col("__raw"))
    # Softmax over two outputs: log-odds is the difference of the two scores.
    # Binomial logistic regression: rawPrediction = [-margin, margin].
    two = isinstance(model, MultilayerPerceptronClassificationModel)
    return out.withColumn(col, raw[1] - raw[0] if two else raw[1]).drop("__raw")


def score_models(models: dict[str, Model], df: DataFrame) -> DataFrame:
    """``df`` once per model with ``model`` and ``logit``, from one pass over ``df``."""
    wide = df
    for i, model in enumerate(models.values()):
        wide = logits(model, wide, f"__logit_{i}")
    each = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"__logit_{i}").alias("logit")) for i, name in enumerate(models)
    ])
    # The row's own columns are repeated, the features are not: they were only needed for the logits.
    kept = [c for c in df.columns if c != FEATURES]
    return wide.select(*kept, F.explode(each).alias("__m")).select(*kept, "__m.model", "__m.logit")


MODEL_KINDS = (LogisticRegressionModel, MultilayerPerceptronClassificationModel)


def save_model(model: Model, path: str) -> None:
    """Write a fitted model with its parameters."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """Read a model that ``save_model`` wrote; its metadata names its class."""
    metadata = spark.read.text(f"{path.rstrip('/')}/metadata").first()
    for kind in MODEL_KINDS:
        if metadata and f".{kind.__name__}\"" in metadata[0]:
            return kind.load(path)
    raise ValueError(f"{path} holds no classifier of this library")


def fit_and_score(
    train: DataFrame, evaluate: DataFrame, estimator: Estimator | None = None, by: Sequence[str] = ("split",)
) -> DataFrame:
    """Fit on ``train`` and report accuracy/loss of ``evaluate`` per ``by`` group."""
    estimator = estimator or logistic()
    model = estimator.fit(train)
    scored = score_rows(logits(model, evaluate), label=LABEL)
    return report(scored, by=by)


def random_param_maps(estimator: Estimator, trials: int = SEARCH_TRIALS, seed: int = SPLIT_SEED) -> list[dict]:
    """Seeded random draws: iterations; a log-uniform penalty (logistic), or a hidden-layer
    shape and a log-uniform step size (perceptron, its input width kept; without hidden
    layers none are drawn). Only the ``gd`` solver uses the step size."""
    rng, step_rng = random.Random(seed), random.Random(f"{seed}|step")
    maps = []
    for _ in range(trials):
        max_iter = rng.choice(SEARCH_ITERATIONS)
        if isinstance(estimator, MultilayerPerceptronClassifier):
            hidden = rng.choice(SEARCH_HIDDEN_LAYERS) if len(estimator.getLayers()) > 2 else ()
            step = math.exp(step_rng.uniform(*map(math.log, SEARCH_STEP_SIZES)))
            layers = [estimator.getLayers()[0], *hidden, 2]
            maps.append({estimator.maxIter: max_iter, estimator.layers: layers, estimator.stepSize: step})
        else:
            reg = math.exp(rng.uniform(math.log(1e-6), math.log(1e-3)))
            maps.append({estimator.maxIter: max_iter, estimator.regParam: reg})
    return maps


@dataclass
class SearchResult:
    """The table of trials (small, local rows), the best trial's number and its fitted model."""

    runs: DataFrame
    best: int
    model: Model


def search_models(
    train: DataFrame,
    validation: DataFrame,
    estimator: Estimator | None = None,
    trials: int = SEARCH_TRIALS,
    seed: int = SPLIT_SEED,
    parallelism: int = 4,
    metric: str = "mean_loss",
    mode: str = "min",
) -> SearchResult:
    """Random search; one row per trial with its parameters, validation
    accuracy and loss, and ``is_best`` on the chosen metric (ties: lowest trial),
    picked by the same best-trial operator that reads run-metrics tables."""
    estimator = estimator or logistic()
    maps = random_param_maps(estimator, trials, seed)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted: dict[int, Model] = {}
        models = estimator.fitMultiple(train, maps)
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for index, model in pool.map(lambda _: next(models), range(len(maps))):
                fitted[index] = model
    finally:
        train.unpersist()

    scored = validation_scores(fitted, validation)
    is_mlp = isinstance(estimator, MultilayerPerceptronClassifier)
    spark = train.sparkSession
    rows = []
    for r in report(scored, by=["trial"]).collect():  # one row a trial
        m = maps[r["trial"]]
        reg = 0.0 if is_mlp else float(m[estimator.regParam])
        layers = ",".join(str(x) for x in m[estimator.layers]) if is_mlp else ""
        step = float(m[estimator.stepSize]) if is_mlp else None
        rows.append((r["trial"], r["n"], r["n_correct"], r["accuracy"], r["mean_loss"], int(m[estimator.maxIter]), reg, layers, step))
    runs = spark.createDataFrame(
        rows, "trial int, n long, n_correct long, accuracy double, mean_loss double, max_iter int, reg_param double, "
        "layers string, step_size double"
    )
    # The run-metrics form (trial, epoch, loss, accuracy): each trial's last (only)
    # validation result is at its last iteration; the best-trial pick reads it.
    run_metrics = runs.select("trial", F.col("max_iter").alias("epoch"), F.col("mean_loss").alias("loss"), "accuracy")
    pick_metric = {"mean_loss": "loss", "accuracy": "accuracy"}[metric]
    best = best_trial(run_metrics, metric=pick_metric, mode=mode).first()["trial"]
    return SearchResult(runs.withColumn("is_best", F.col("trial") == best), best, fitted[best])


def validation_scores(fitted: dict[int, Model], validation: DataFrame) -> DataFrame:
    """trial, logit, label and loss of every candidate, from one pass over the validation rows."""
    named = {str(i): fitted[i] for i in sorted(fitted)}
    scored = score_models(named, validation.select(FEATURES, LABEL))
    return score_rows(scored.withColumn("trial", F.col("model").cast("int")).drop("model"), label=LABEL)


def search(train: DataFrame, validation: DataFrame, **options) -> DataFrame:
    """The table of trials of :func:`search_models`."""
    return search_models(train, validation, **options).runs
