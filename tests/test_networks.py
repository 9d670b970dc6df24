"""Gradients of every network by differences, and training over partitions: early stop, resuming, freezing, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import networks, timeseries, training

SMALL = {
    "perceptron": networks.Perceptron(5, 3, 0.0, (7, 6, 4)),
    "regressor": networks.Perceptron(5, 1, 0.0, (7, 6, 4)),
    "tokens": networks.FeatureTokens(5, 8, 2, 2, 0.0),
    "branches": networks.TwoBranches(5, 2, 4, 8, 1, 2, 0.0, 8, 1, 2, False, 6),
    "branches with layers": networks.TwoBranches(5, 2, 4, 8, 1, 2, 0.0, 8, 1, 2, True, 6),
}


def batch_of(rng, n=6):
    masked = rng.random((n, 4)) < 0.4
    masked[0] = True  # a row without any history
    return {"tabular": rng.standard_normal((n, 5)), "sequence": np.where(masked[:, :, None], 0, rng.standard_normal((n, 4, 2))), "masked": masked}


@pytest.mark.parametrize("name", list(SMALL))
def test_gradients_equal_differences(name):
    network, rng = SMALL[name], np.random.default_rng(1)
    params = {k: v + 0.3 * rng.standard_normal(v.shape) for k, v in network.draw(rng).items()}
    batch, y, w = batch_of(rng), rng.integers(0, 3, 6).astype(float), rng.uniform(0.5, 2, 6)
    loss, gradients = networks.loss_and_gradients(network, params, batch, y, w)
    assert set(gradients) == set(params)
    for k, v in params.items():
        for place in rng.choice(v.size, min(v.size, 4), replace=False):
            at, ends = np.unravel_index(place, v.shape), []
            for step in (1e-5, -1e-5):
                moved = v.copy()
                moved[at] += step
                ends.append(networks.loss_and_gradients(network, params | {k: moved}, batch, y, w)[0])
            assert gradients[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=2e-6), (k, at)
    # what is masked has no say
    if "sequence" in batch and isinstance(network, networks.TwoBranches):
        other = batch | {"sequence": np.where(batch["masked"][:, :, None], 99.0, batch["sequence"])}
        assert networks.loss_and_gradients(network, params, other, y, w)[0] == pytest.approx(loss)


def test_dropout_keeps_the_mean_and_gradients_follow_it():
    network, rng = networks.Perceptron(5, 3, 0.5, (40, 30, 4)), np.random.default_rng(0)
    params, batch, y = network.draw(rng), batch_of(rng), np.zeros(6)
    losses = {networks.loss_and_gradients(network, params, batch, y, np.ones(6), np.random.default_rng(s))[0] for s in range(5)}
    assert len(losses) == 5
    one = [networks.loss_and_gradients(network, params, batch, y, np.ones(6), np.random.default_rng(3))[1]["layer0.w"] for _ in range(2)]
    assert np.array_equal(*one)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for month in range(1, 31):
        for entity in range(25):
            a, b = rng.standard_normal(2)
            y = 0.8 * np.tanh(2 * a) - 0.5 * b + 0.2 * rng.standard_normal()
            rows.append((entity, month, None if (entity + month) % 9 == 0 else float(a), float(b), float(y), 0 if y < -0.4 else 2 if y > 0.4 else 1))
    return spark.createDataFrame(rows, "entity int, month_id int, a double, b double, target double, label int").withColumn("score", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def parts(panel):
    return panel.filter("month_id <= 18"), panel.filter("month_id between 19 and 24"), panel.filter("month_id > 24")


def test_scaler(spark, parts):
    s = training.fit_scaler(parts[0], ["a", "b"])
    frame = parts[0].toPandas()
    filled = frame["a"].fillna(frame["a"].median())
    assert s.median[0] == pytest.approx(frame["a"].median()) and s.mean[0] == pytest.approx(filled.mean()) and s.deviation[0] == pytest.approx(filled.std(ddof=0))
    assert np.allclose(s(np.array([[np.nan, frame["b"].mean()]])), [[(s.median[0] - s.mean[0]) / s.deviation[0], 0]])
    with pytest.raises(ValueError, match="no value"):
        training.fit_scaler(parts[0].withColumn("a", F.lit(None).cast("double")), ["a"])


@pytest.mark.parametrize("outputs", [3, 1])
def test_perceptron_trains_stops_and_resumes(spark, parts, tmp_path, outputs):
    train, validation, test = parts
    inputs = training.Inputs(training.fit_scaler(train, ["a", "b"]))
    network = networks.Perceptron(2, outputs, 0.1, (24, 16, 8))
    settings = training.Settings(rate=0.01, batch=64, most_rounds=6, patience=3, tasks=3)
    label = "label" if outputs > 1 else "target"
    whole = training.train(network, train, validation, inputs, label, "target", settings)
    ics = [h["validation_ic"] for h in whole.history]
    assert max(ics) > 0.75 and [h["selected"] for h in whole.history].count(True) == 1
    assert len(ics) == 6 or len(ics) - 1 - ics.index(max(ics)) == 3
    folder = str(tmp_path / "run")
    training.train(network, train, validation, inputs, label, "target", training.Settings(**{**settings.__dict__, "most_rounds": 2}), folder=folder)
    resumed = training.train(network, train, validation, inputs, label, "target", settings, folder=folder)
    assert [h["train_loss"] for h in resumed.history] == [h["train_loss"] for h in whole.history]
    assert all(np.array_equal(resumed.params[k], whole.params[k]) for k in whole.params)
    training.save(whole, spark, str(tmp_path / "model"))
    again = training.load(spark, str(tmp_path / "model"), ["a", "b"])
    rows = [training.score(test, m, ["entity", "month_id", "target", "a"]).orderBy("entity", "month_id").collect() for m in (whole, again)]
    assert rows[0] == rows[1] and len(rows[0]) == test.count()
    if outputs > 1:
        r = rows[0][0]
        assert r["score"] == pytest.approx(r["probability"][2] - r["probability"][0]) and r["expected_return"] == pytest.approx(float(np.dot(r["probability"], whole.class_means)))
    with pytest.raises(ValueError, match="not on"):
        training.load(spark, str(tmp_path / "model"), ["b", "a"])


def test_tokens_and_branches_train(spark, panel, tmp_path):
    df = timeseries.history(panel, "entity", ["b"], 4)
    train, validation = df.filter("month_id <= 18"), df.filter("month_id between 19 and 24")
    tabular = training.fit_scaler(train, ["a", "b"])
    tokens = networks.FeatureTokens(2, 8, 1, 2, 0.0)
    settings = training.Settings(rate=0.01, batch=32, most_rounds=4, tasks=2)
    first = training.train(tokens, train, validation, training.Inputs(tabular), "label", "target", settings, class_weights=True)
    assert max(h["validation_ic"] for h in first.history) > 0.6
    network = networks.TwoBranches(2, 1, 4, 8, 1, 2, 0.0, 8, 1, 2, False, 8)
    start, loaded = networks.warm_start({k: v.astype(np.float32) for k, v in network.draw(np.random.default_rng(0)).items()}, first.params, ("tabular.",))
    assert loaded and all(k.startswith("tabular.") for k in loaded)
    inputs = training.Inputs(tabular, training.sequence_scaler(train, ["b"]), 4)
    frozen = training.Settings(rate=0.01, batch=32, most_rounds=2, tasks=2, frozen=("tabular.",), rates={"temporal.": 0.002})
    both = training.train(network, train, validation, inputs, "label", "target", frozen, start=start)
    assert all(np.array_equal(both.params[k], first.params[k]) for k in loaded)
    assert not np.array_equal(both.params["temporal.step.w"], start["temporal.step.w"])
    assert max(h["validation_ic"] for h in both.history) > 0.6
    training.save(both, spark, str(tmp_path / "two"))
    assert training.score(validation, training.load(spark, str(tmp_path / "two"), ["a", "b"]), ["entity"]).count() == validation.count()
    with pytest.raises(ValueError, match="nothing to load"):
        networks.warm_start(start, {}, ("tabular.",))
    with pytest.raises(ValueError, match="classes in training"):
        training.train(tokens, train.filter("label > 0"), validation, training.Inputs(tabular), "label", "target", settings)
