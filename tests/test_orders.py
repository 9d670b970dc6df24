"""Global ranks, exact quantiles and carried values against brute force, with hot keys and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import joins, orders, quantiles, timeseries, xsection


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(8)
    n = 4000
    frame = pd.DataFrame({"k": rng.choice(["all", "b", None], n, p=[0.9, 0.05, 0.05]), "a": rng.integers(0, 3000, n) * 1.0, "b": rng.standard_normal(n).round(2)})
    frame.loc[rng.random(n) < 0.5, "a"] = 7.0  # one value in half of the rows
    frame.loc[rng.random(n) < 0.1, "b"] = None
    schema = "k string, a double, b double"
    return frame, spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)], schema).repartition(7)


def test_global_rank_of_a_hot_key_and_value(spark, skewed):
    frame, df = skewed
    got = orders.with_global_rank(df, ["k"], "a", "rank").toPandas()
    want = frame.assign(rank=frame.groupby("k", dropna=False)["a"].rank())
    order = ["k", "a", "b", "rank"]
    tidy = lambda x: sorted(map(str, x[order].fillna("-").itertuples(index=False, name=None)))
    assert tidy(got) == tidy(want)
    counts = {(r["k"], r["a"]): (r["n"], r["before"]) for r in orders.ordered_counts(df, ["k"], "a").collect()}
    every = frame[frame["k"] == "all"]["a"]
    assert counts["all", 7.0] == (int((every == 7).sum()), int((every < 7).sum()))


def test_no_task_ranks_a_whole_key(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.lit("all").alias("k"), (F.col("id") * 7919 % 40_009).alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = orders.ordered_counts(df, ["k"], "v")
        assert ranks.filter("before = 0").count() == 1 and ranks.agg(F.max("before")).first()[0] == 39_999
        ranged = df.repartitionByRange("k", "v").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in ranged) < 40_000 * 2 / parts
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spearman_equals_pandas(spark, skewed):
    frame, df = skewed
    got = {r["k"]: (r["n"], r["spearman"]) for r in orders.spearman(df, ["k"], "a", "b").collect()}
    for k, part in frame.dropna(subset=["a", "b"]).groupby("k", dropna=False):
        k = None if pd.isna(k) else k
        assert got[k][0] == len(part) and got[k][1] == pytest.approx(part["a"].rank().corr(part["b"].rank()))
    flat = orders.spearman(df.withColumn("a", F.lit(1.0)), ["k"], "a", "b")
    assert {r["spearman"] for r in flat.collect()} == {None}
    assert orders.spearman(df.limit(0), ["k"], "a", "b").collect() == []


def test_quantiles_equal_numpy(spark, skewed):
    frame, df = skewed
    ps = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {(r["k"], r["column"], r["probability"]): (r["n"], r["value"]) for r in quantiles.exact_quantiles(df, ["k"], ["a", "b"], ps).collect()}
    for k, part in frame.groupby("k", dropna=False):
        for c in ("a", "b"):
            v = part[c].dropna()
            for p in ps:
                n, value = got[None if pd.isna(k) else k, c, p]
                assert n == len(v) and value == pytest.approx(np.quantile(v, p), abs=1e-12)
    wild = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), None, 1.0, 1.0 + 2**-52]
    rows = spark.createDataFrame([(v,) for v in wild], "v double")
    found = quantiles.select(rows, [], ["v"], [i / 9 for i in range(10)])
    assert found.n[0, 0] == 10 and found.lower[0, 0].tolist() == sorted(v for v in wild if v is not None and v == v)
    assert quantiles.exact_quantiles(df.limit(0), ["k"], ["a"], ps).collect() == []
    assert {r["value"] for r in quantiles.exact_quantiles(df.withColumn("a", F.lit(None)), ["k"], ["a"], [0.5]).collect()} == {None}
    with pytest.raises(ValueError, match="fewer columns"):
        quantiles.select(df, ["k"], ["a", "b"], ps, most_targets=10)


def test_bits_keep_the_order():
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate((rng.standard_normal(500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, np.inf, -np.inf])))
    bits = quantiles.ordered_bits(x)
    assert (bits[1:] >= bits[:-1]).all() and (quantiles.from_bits(bits) == x).all()


def test_winsorising_equals_its_definition(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"month_id": rng.integers(1, 4, 300), "v": rng.standard_normal(300), "w": rng.exponential(5, 300)})
    frame.loc[rng.random(300) < 0.2, "v"] = np.nan
    frame.loc[frame["month_id"] == 3, "w"] = np.nan
    df = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False)], "month_id int, v double, w double")
    got = xsection.winsorise_impute(df, ["v", "w"], "month_id", 0.05, 0.9, flags=["v"]).toPandas()
    want = []
    for _, part in frame.groupby("month_id"):
        part = part.assign(v_missing=part["v"].isna().astype(int))
        for c in ("v", "w"):
            part[c] = part[c].clip(part[c].quantile(0.05), part[c].quantile(0.9))
            part[c] = part[c].fillna(part[c].median())
        want.append(part)
    columns = ["month_id", "v", "w", "v_missing"]
    tidy = lambda x: x[columns].fillna(-99).sort_values(columns).to_numpy()
    assert np.allclose(tidy(got), tidy(pd.concat(want)))


def test_carried_over_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(t), None if rng.random() < 0.9 else float(rng.integers(100))) for k, n in (("hot", 3000), ("b", 40), (None, 5)) for t in rng.permutation(n)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(6)
    got = {(r["k"], r["t"]): r["last"] for r in orders.carried(df, "k", [F.col("t")], "v", "last").collect()}
    assert len(got) == len(rows)
    for key in ("hot", "b", None):
        last = None
        for k, t, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            last = v if v is not None else last
            assert got[k, t] == (last if key is not None else None)


@pytest.mark.parametrize("keys", [["one"], ["one", "two", None]])
def test_segmented_asof_equals_the_window_form(spark, keys):
    rng = np.random.default_rng(len(keys))
    day = lambda n: pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=int(n))
    left = spark.createDataFrame([(i, str(rng.choice(keys)) if None not in keys or rng.random() < 0.9 else None, day(rng.integers(0, 900))) for i in range(1500)], "id int, k string, at date")
    right = spark.createDataFrame([(str(keys[0]), day(d), int(t)) for d, t in zip(rng.integers(100, 800, 300), rng.permutation(300), strict=True)], "k string, since date, v int")
    for segmented_of in (
        lambda s: joins.asof_backward(left, right, "k", "at", "since", ["v"], ["v"], 5, segmented=s),
        lambda s: joins.asof_backward(left, right, "k", "at", "since", ["v"], ["v"], segmented=s),
        lambda s: joins.asof_nearest(left, right, "k", "at", "since", ["v"], ["v"], 3, segmented=s),
    ):
        rows = [sorted(map(tuple, segmented_of(s).collect()), key=str) for s in (False, True)]
        assert rows[0] == rows[1] and len(rows[0]) == 1500 and any(r[-1] for r in rows[0])


def test_running_medians(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 9, 200) * 1.0
    v[rng.random(200) < 0.2] = np.nan
    for n, least in ((5, 3), (36, 4), (None, 4), (1, 1)):
        want = pd.Series(v).rolling(n or 1000, min_periods=least).median() if n else pd.Series(v).expanding(least).median()
        assert np.allclose(timeseries.running_medians(v, n, least), want, equal_nan=True)
    df = spark.createDataFrame([(k, int(m), None if np.isnan(x) else float(x)) for k in ("a", None) for m, x in zip(rng.permutation(200), v, strict=True)], "k string, m int, v double")
    got = timeseries.with_medians(df, "v", ["k"], "m", {"near": (5, 2), "all": (None, 1)}).toPandas()
    for _, part in got.groupby("k", dropna=False):
        part = part.sort_values("m")
        assert np.allclose(part["near"], part["v"].rolling(5, min_periods=2).median(), equal_nan=True) and np.allclose(part["all"], part["v"].expanding(1).median(), equal_nan=True)
    assert timeseries.with_medians(df.limit(0), "v", ["k"], "m", {"x": (None, 1)}).count() == 0
    assert timeseries.running_medians(rng.standard_normal(100_000), None, 1).shape == (100_000,)
