"""Faults that a reviewer found on larger or odd tables, on small rows that show them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import scalars as x
from panelyard.operators import dedup, models, networks, tape, timeseries, training
from panelyard.plans import portfolio


def test_keys_wider_than_the_pad_are_cut_as_in_sql(spark, duck, tmp_path):
    from panelyard import queries as panel

    rows = [(12, "a", "Brand#1", "LARGE", 3, 900.0), (1000001, "b", "Brand#2", "SMALL STEEL", 12, 1600.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r["padded"] for r in panel.part_scalars(spark, str(tmp_path)).collect()}
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == {r[0]: r[1] for r in con.execute(panel.SQL["part_scalars"]).fetchall()} == {12: "000012", 1000001: "100000"}
    assert spark.range(1).select(x.zero_pad(F.lit("1234567"), 6)).first()[0] == "1234567"  # identifiers stay whole


def test_priority_dedup_settles_what_the_tie_leaves_equal(spark):
    df = spark.createDataFrame([(k, 2, v, s) for k in range(40) for v, s in (("R", "O"), ("A", "F"), ("R", "F"))], "k int, n int, flag string, status string")
    for rows in (df, df.orderBy(F.desc("flag"), F.desc("status")).coalesce(1), df.repartition(7)):
        assert {(r["flag"], r["status"]) for r in dedup.priority_dedup(rows, ["k"], ["status"], ["flag"], ["n"]).collect()} == {("A", "F")}


def _gappy_panel(spark):
    """Two models over seven months: entities come and go, a month has too few names, one has no score at all."""
    rows = spark.range(2 * 7 * 40).select((F.col("id") % 40).alias("entity"), (F.floor(F.col("id") / 40) % 7 + 100).cast("int").alias("month_id"), F.floor(F.col("id") / 280).cast("int").alias("m"), "id")
    rows = rows.select(F.concat(F.lit("m"), "m").alias("model"), F.lit("s").alias("split"), "month_id", "entity", F.round(F.sin(F.col("id") * 12.9) * 0.05, 3).alias("score"), F.when(F.col("id") % 11 > 0, F.cos(F.col("id") * 7.7) * 0.4).alias("ret"), "id")
    rows = rows.filter("pmod(hash(entity, month_id), 5) > 0 and (month_id <> 103 or entity < 6)")
    return rows.withColumn("score", F.when((F.col("month_id") != 105) & (F.col("id") % 13 > 0), F.col("score"))).drop("id")


def test_grid_returns_are_those_of_its_weights(spark):
    df, grid = _gappy_panel(spark), portfolio.strategy_grid(spark)
    months = df.select("model", "split", "month_id").distinct()
    columns = ["spec", "model", "split", "month_id", "turnover_method", "n_long", "n_short", "gross_return", "net_return", "turnover", "trading_cost", "gross_exposure", "net_exposure"]
    sort = lambda made: made.select(columns).orderBy(columns[:4]).collect()
    want, got = sort(portfolio.portfolio_returns(portfolio.weights(df, grid), months)), sort(portfolio.grid_returns(df, grid, months))
    assert len(got) == len(want) > 500 and {r["month_id"] for r in got} == set(range(100, 107))
    assert [tuple(r[:7]) for r in got] == [tuple(r[:7]) for r in want]
    assert [v for r in got for v in r[7:]] == pytest.approx([v for r in want for v in r[7:]], abs=1e-12)


def test_grid_returns_shuffle_no_row_of_a_specification_and_entity(spark):
    df = _gappy_panel(spark)
    plan = portfolio.grid_returns(df, portfolio.strategy_grid(spark), df.select("model", "split", "month_id").distinct())._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith(("Aggregate", "Window")) and "spec#" in line and "entity#" in line]


def test_a_sequence_scaler_makes_the_histories_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    panel = spark.range(60).selectExpr("id % 5 as entity", "cast(id div 5 as int) as month_id", "sin(id) as r").mapInArrow(counted, "entity long, month_id int, r double")
    scaler = training.sequence_scaler(timeseries.history(panel, "entity", ["r"], 3, fill=None), ["r"])
    assert read.value == 60 and scaler.deviation[0] > 0


def test_the_last_block_makes_the_first_place_as_all_places_would():
    rng = np.random.default_rng(3)
    x, names = rng.normal(size=(5, 7, 8)), networks._block(rng, "b", 8)
    hidden = np.arange(7) > np.arange(2, 7)[:, None]
    out = [networks.block({k: tape.Node(v) for k, v in names.items()}, "b", tape.constant(x), 2, hidden, 0.3, 0.2, np.random.default_rng(9), last).value for last in (False, True)]
    assert out[1].shape == (5, 1, 8) and out[1] == pytest.approx(out[0][:, :1])


def test_gradients_are_taken_to_what_is_trained_only():
    network = networks.TwoBranches(3, 2, 4, 8, 1, 2, 0.1, 8, 1, 2, False, 8)
    rng = np.random.default_rng(1)
    params, batch = network.draw(rng), {"tabular": rng.normal(size=(6, 3)), "sequence": rng.normal(size=(6, 4, 2)), "masked": np.zeros((6, 4), bool)}
    y, w = np.array([0, 1, 2, 0, 1, 2]), np.ones(6)
    full, some = (networks.loss_and_gradients(network, params, batch, y, w, np.random.default_rng(2), frozen)[1] for frozen in ((), ("tabular.",)))
    assert all(not v.any() for k, v in some.items() if k.startswith("tabular.")) and any(v.any() for k, v in full.items() if k.startswith("tabular."))
    assert all(some[k] == pytest.approx(v) for k, v in full.items() if not k.startswith("tabular."))


def test_a_grid_of_models_fits_what_comes_before_them_once(spark, monkeypatch):
    made = []
    plain = models.preprocessor
    monkeypatch.setattr(models, "preprocessor", lambda features: made.append(features) or plain(features))
    df = spark.range(240).selectExpr("id % 20 as entity", "cast(id div 20 as int) as month_id", "sin(id) as a", "cos(id) as b", "sin(id) + cos(3 * id) as target", "case when id < 120 then 'train' else 'validation' end as split")
    name, model, found = models.fit_grid(df, ["a", "b"], "target", {"x": models.elastic_net(0.01, 0.5, "target"), "y": models.ridge(1.0, "target")})
    assert len(made) == 1 and set(found) == {"x", "y"} and len(model.stages) == 4
    assert model.transform(df).filter("score is not null").count() == 240
