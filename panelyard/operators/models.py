"""Models on Spark ML: preprocessing fitted on training rows, grids chosen by validation rank correlation, scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.plans.rank_ic import monthly_rank_ic


def preprocessor(features: list[str]) -> list:
    """Median fill and standardising; both learn from the rows that the pipeline is fitted on."""
    filled = [f"__f_{f}" for f in features]
    return [
        Imputer(strategy="median", inputCols=features, outputCols=filled, relativeError=0.0001),
        VectorAssembler(inputCols=filled, outputCol="__raw", handleInvalid="keep"),
        StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True),
    ]


def ridge(alpha: float, target: str) -> LinearRegression:
    return LinearRegression(labelCol=target, regParam=alpha, elasticNetParam=0.0, standardization=False, predictionCol="score")


def elastic_net(alpha: float, mix: float, target: str) -> LinearRegression:
    return LinearRegression(labelCol=target, regParam=alpha, elasticNetParam=mix, standardization=False, predictionCol="score")


def logistic(c: float, label: str, rows: int = 1) -> LogisticRegression:
    """regParam is 1 / (c rows): the loss is a mean over the rows."""
    return LogisticRegression(labelCol=label, regParam=1.0 / (c * rows), family="multinomial", probabilityCol="probability", predictionCol="predicted")


def boosted(depth: int, trees: int, target: str) -> GBTRegressor:
    return GBTRegressor(labelCol=target, maxDepth=depth, maxIter=trees, seed=1, predictionCol="score")


def logistic_grid(label: str, rows: int, rates: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> dict[str, LogisticRegression]:
    """Candidates for fit_grid(): each C without and with the balancing weights of class_weights()."""
    return {f"C={c:g} {name}": logistic(c, label, rows) if name == "none" else logistic(c, label, rows).setWeightCol("weight") for c in rates for name in ("none", "balanced")}


def forest(depth: int, trees: int, label: str) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, maxDepth=depth, numTrees=trees, seed=1, probabilityCol="probability", predictionCol="predicted")


def perceptron(inputs: int, label: str) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol=label, layers=[inputs, 64, 32, 3], seed=1, maxIter=60, probabilityCol="probability", predictionCol="predicted")


def class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """df with rows / (classes * rows of the class) as the weight, for estimators' weightCol."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect() if r[label] is not None}  # a row a class
    total = sum(counts.values())
    pairs = [F.lit(v) for k, n in counts.items() for v in (k, total / (len(counts) * n))]
    return df.withColumn(weight, F.try_element_at(F.create_map(*pairs), F.col(label)))


def sequence_stats(histories: DataFrame, values: list[str]) -> DataFrame:
    """feature, n, median, mean, sd over all steps of histories() that are no masked ones."""
    steps = histories.select(F.explode(F.arrays_zip("steps", "masked")).alias("z")).filter("not z.masked").select("z.steps.*")
    return steps.unpivot([], values, "feature", "v").groupBy("feature").agg(F.count("v").alias("n"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def save_model(model: PipelineModel, features: list[str], path: str) -> None:
    """The model and the names of its features, in order."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame(list(enumerate(features)), "place int, feature string").write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str, features: list[str]) -> PipelineModel:
    """The saved model; raises if it was fitted on other features or in another order."""
    fitted = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
    if fitted != list(features):
        raise ValueError(f"fitted on {fitted}, not on {features}")
    return PipelineModel.load(f"{path}/model")


def with_class_scores(scored: DataFrame, means: list[float] | None = None) -> DataFrame:
    """score = p_top - p_bottom of a three-class model, and the expected return if class means are given."""
    p = vector_to_array("probability")
    out = scored.withColumn("score", p[2] - p[0])
    return out.withColumn("expected_return", p[0] * means[0] + p[1] * means[1] + p[2] * means[2]) if means else out


def fit_grid(panel: DataFrame, features: list[str], target: str, candidates: dict[str, object], split: str = "split", after: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[str, PipelineModel, dict[str, float]]:
    """Fit every candidate on the training rows and keep the one of highest mean monthly rank IC on validation.

    A later candidate must be strictly better to replace an earlier one. Returns its name, model, and all means.
    """
    kept = panel.filter(F.col(target).isNotNull())
    train, validation = kept.filter(F.col(split) == "train"), kept.filter(F.col(split) == "validation")
    # all candidates see the same features, so what comes before them is fitted and applied once
    before = Pipeline(stages=preprocessor(features)).fit(train)
    train, validation = (before.transform(df).drop("__raw", *[f"__f_{f}" for f in features]).cache() for df in (train, validation))
    best, model, found = None, None, {}
    for name, estimator in candidates.items():
        own = estimator.fit(train)
        fitted = PipelineModel([*before.stages, own])
        scored = after(own.transform(validation)).withColumn("model", F.lit(name))
        ic = monthly_rank_ic(scored, "score", target).agg(F.avg("rank_ic")).first()[0]
        found[name] = ic
        if best is None or (ic is not None and ic > (found[best] if found[best] is not None else -2.0)):
            best, model = name, fitted
    train.unpersist()
    validation.unpersist()
    return best, model, found
