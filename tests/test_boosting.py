"""Boosted trees against a plain version, with missing values, weights, a grid, and saved models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import boosting


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 900
    a, b, c = rng.standard_normal((3, n))
    y = 0.8 * a + np.where(b > 0, 0.9, -0.9) + 0.3 * rng.standard_normal(n)
    label = np.digitize(y, [-0.7, 0.7])
    frame = pd.DataFrame({"month_id": np.arange(n) % 18, "a": a, "b": b, "c": c, "y": y, "label": label})
    frame.loc[rng.random(n) < 0.1, "a"] = np.nan
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)], "month_id long, a double, b double, c double, y double, label long")
    return frame, df


def brute_tree(bins, g, h, leaves, rate):
    """The values that one tree gives, by trying every split of every leaf of a level."""
    nodes, level, count = {0: np.ones(len(bins), bool)}, [0], 1
    value, following = {0: -rate * g.sum() / h.sum()}, 1
    while level:
        tried = []
        for node in level:
            own, best = nodes[node], None
            for f in range(bins.shape[1]):
                for at in range(boosting.BINS - 2):
                    for missing_left in (False, True):
                        miss = bins[:, f] == boosting.BINS - 1
                        left = own & np.where(miss, missing_left, bins[:, f] <= at)
                        right = own & ~left
                        if left.sum() < 20 or right.sum() < 20:
                            continue
                        gain = sum(g[m].sum() ** 2 / h[m].sum() for m in (left, right)) - g[own].sum() ** 2 / h[own].sum()
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, left, right)
            if best:
                tried.append((best[0], node, best[1], best[2]))
        level = []
        for _, node, left, right in sorted(tried, key=lambda t: -t[0]):
            if count < leaves:
                count += 1
                for m in (left, right):
                    nodes[following], value[following] = m, -rate * g[m].sum() / h[m].sum()
                    level.append(following)
                    following += 1
                del nodes[node]
        if count >= leaves:
            break
    out = np.zeros(len(bins))
    for node, m in nodes.items():
        out[m] = value[node]
    return out


def test_trees_equal_a_plain_version(rows):
    frame, df = rows
    features, rate, leaves = ["a", "b", "c"], 0.3, 6
    (model,) = boosting.fit(df.repartition(3), features, "label", [{"max_iter": 3, "learning_rate": rate, "max_leaf_nodes": leaves}], every=2)
    bins = np.column_stack([np.where(frame[f].isna(), boosting.BINS - 1, np.searchsorted(e, frame[f])) for f, e in zip(features, model.edges, strict=True)]).astype(np.uint8)
    y = frame["label"].to_numpy()
    margins = np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))
    for _ in range(3):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        margins = margins + np.column_stack([brute_tree(bins, p[:, k] - (y == k), p[:, k] * (1 - p[:, k]), leaves, rate) for k in range(3)])
    assert np.allclose(model.margins(bins), margins, atol=1e-9)


def test_grid_choice_weights_and_saved_models(spark, rows, tmp_path):
    frame, df = rows
    features = ["a", "b", "c"]
    train, validation = df.filter("month_id < 12"), df.filter("month_id >= 12")
    grid = [{"max_iter": 1, "learning_rate": 0.01, "max_leaf_nodes": 2}, {"max_iter": 12, "learning_rate": 0.3, "max_leaf_nodes": 8}, {"max_iter": 12, "learning_rate": 0.3, "max_leaf_nodes": 8}]
    models = boosting.fit(train, features, "label", grid, every=5)
    assert [len(m.trees) for m in models] == [1, 12, 12]
    best, found = boosting.choose(validation, models, "y")
    assert best == 1 and found[1] == found[2] > 0.75 and found[1] > found[0]  # the first of equals
    alone = boosting.fit(train.repartition(5), features, "label", grid[1:2], edges=models[1].edges, every=100)[0]
    bins = np.random.default_rng(0).integers(0, boosting.BINS, (50, 3)).astype(np.uint8)
    assert np.allclose(alone.margins(bins), models[1].margins(bins))  # neither partitions nor the grid change a model
    assert np.allclose(models[1].predict(bins).sum(axis=1), 1)
    boosting.save(models[1], spark, str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"), features)
    assert np.array_equal(again.margins(bins), models[1].margins(bins))
    with pytest.raises(ValueError, match="not on"):
        boosting.load(spark, str(tmp_path / "m"), ["b", "a", "c"])
    scored = boosting.score(validation.withColumn("score", F.lit("clash")), {"x": again}, ["month_id", "y", "a"]).toPandas()
    assert len(scored) == validation.count() and scored["score"].between(-1, 1).all()
    heavy = boosting.fit(train.withColumn("w", F.when(F.col("label") == 0, 50.0).otherwise(1.0)), features, "label", [{"max_iter": 3, "learning_rate": 0.3, "max_leaf_nodes": 4}], weight="w")[0]
    light = boosting.fit(train, features, "label", [{"max_iter": 3, "learning_rate": 0.3, "max_leaf_nodes": 4}])[0]
    assert heavy.predict(bins)[:, 0].mean() > light.predict(bins)[:, 0].mean()


def test_a_number_and_odd_rows(spark, rows):
    frame, df = rows
    (model,) = boosting.fit(df, ["a", "b"], "y", [{"max_iter": 15, "learning_rate": 0.3, "max_leaf_nodes": 8}], classes=None)
    scored = boosting.score(df, {"m": model}, ["y"]).toPandas()
    assert scored["probability"].isna().all() and np.corrcoef(scored["score"], scored["y"])[0, 1] > 0.9
    flat = df.select("label", "y", F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("none"))
    (model,) = boosting.fit(flat, ["one", "none"], "label", [{"max_iter": 2, "learning_rate": 0.1, "max_leaf_nodes": 4}])
    assert all(t.feature == [-1] for r in model.trees for t in r)
    few = df.limit(10).withColumn("label", F.when(F.col("label") < 9, F.lit(None).cast("long")))
    (model,) = boosting.fit(few, ["a"], "label", [{"max_iter": 1, "learning_rate": 0.1, "max_leaf_nodes": 4}])
    assert boosting.score(df.limit(0), {"m": model}, ["y"]).collect() == []


def test_the_grid_query_fits_all_rounds_of_the_grid(spark, sf_dir, monkeypatch):
    from panelyard import queries as panel

    grid, made, fit = [{"max_iter": r, "learning_rate": 0.1, "max_leaf_nodes": 4} for r in (3, 5)], [], boosting.fit
    full = [(p["max_iter"], p["learning_rate"], p["max_leaf_nodes"]) for p in boosting.GRID]
    assert full == [(100, 0.03, 31), (100, 0.1, 31), (300, 0.03, 31), (100, 0.03, 63)]
    monkeypatch.setattr(boosting, "GRID", grid)
    monkeypatch.setattr(boosting, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    rows = panel.QUERIES["boosted_grid"](spark, sf_dir).orderBy("candidate").collect()
    assert [r["max_iter"] for r in rows] == [len(m.trees) for m in made[0]] == [3, 5] and sum(r["selected"] for r in rows) == 1


def test_passes_give_the_same_trees_as_tasks_that_finish_them(rows, monkeypatch):
    frame, df = rows
    grid = [{"max_iter": 4, "learning_rate": 0.3, "max_leaf_nodes": 6}, {"max_iter": 2, "learning_rate": 0.1, "max_leaf_nodes": 12}, {"max_iter": 2, "learning_rate": 0.3, "max_leaf_nodes": 6}]
    bins = np.random.default_rng(0).integers(0, boosting.BINS, (200, 3)).astype(np.uint8)

    def fitted(**limits):
        for name, value in limits.items():
            monkeypatch.setattr(boosting, name, value)
        return boosting.fit(df.repartition(5), ["a", "b", "c"], "label", grid, every=2)

    finished = fitted()
    assert [len(m.trees) for m in finished] == [4, 2, 2] and finished[2].trees == finished[0].trees[:2]  # the same point, fewer rounds
    # by levels in the driver's place, by several tasks, in two steps of few parts each, and by levels until few rows are left
    for limits in ({"_FEW": 0}, {"_AT_ONCE": 20_000, "_ROWS": 100}, {"_HANDED": 2}, {"_FEW": 700, "_HANDED": 64}):
        for a, b in zip(fitted(**limits), finished, strict=True):
            assert np.allclose(a.margins(bins), b.margins(bins), atol=1e-9), limits
