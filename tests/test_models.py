"""Model families fit on training rows, are chosen by validation rank correlation, and score whole panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import models


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for month in range(1, 25):
        split = "train" if month <= 12 else "validation" if month <= 18 else "test"
        for entity in range(20):
            a, b = rng.standard_normal(2)
            y = 0.7 * a + 0.3 * rng.standard_normal()
            rows.append((entity, month, split, None if entity == month else float(a), float(b), float(y), float(0 if y < -0.5 else 2 if y > 0.5 else 1)))
    return spark.createDataFrame(rows, "entity int, month_id int, split string, a double, b double, target double, label double").cache()


def test_ridge_grid_keeps_the_first_best(panel):
    name, model, found = models.fit_grid(panel, ["a", "b"], "target", {"r1": models.ridge(0.1, "target"), "again": models.ridge(0.1, "target"), "enet": models.elastic_net(5.0, 0.9, "target")})
    assert name == "r1" and found["r1"] == found["again"] and found["r1"] > 0.7
    scored = model.transform(panel.filter("split = 'test'"))
    assert scored.agg(F.corr("score", "target")).first()[0] > 0.7 and scored.filter("score is null").count() == 0


@pytest.mark.parametrize("kind", ["logistic", "forest", "perceptron"])
def test_classifiers_rank_the_target(panel, kind):
    estimator = {"logistic": lambda: models.logistic(1.0, "label"), "forest": lambda: models.forest(4, 20, "label"), "perceptron": lambda: models.perceptron(2, "label")}[kind]()
    _, model, found = models.fit_grid(panel, ["a", "b"], "target", {kind: estimator}, after=models.with_class_scores)
    assert found[kind] > 0.5
    row = models.with_class_scores(model.transform(panel.limit(1)), [-0.1, 0.0, 0.1]).first()
    assert row["expected_return"] == pytest.approx(0.1 * row["score"])


def test_boosted_trees_score(panel):
    _, _, found = models.fit_grid(panel, ["a", "b"], "target", {"gb": models.boosted(3, 10, "target")})
    assert found["gb"] > 0.5
