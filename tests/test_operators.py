"""Rules that the driver's tables do not reach, on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from panelyard.functions import scalars as x
from panelyard.operators import dedup, joins, quality, stats, timeseries, xsection
from panelyard.plans import overlay, performance, portfolio, rank_ic


def test_interval_link_prefers_primary_then_kind_then_latest(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 10, DATE'2020-05-01'), (2, 10, DATE'2025-01-01'), (3, 11, DATE'2020-05-01') AS t(id, permno, date)")
    links = spark.sql(
        """SELECT * FROM VALUES (10, 'A', DATE'2020-01-01', DATE'2020-12-31', 'C', 'LC'), (10, 'B', DATE'2019-01-01', CAST(NULL AS DATE), 'P', 'LU'),
        (10, 'C', DATE'2019-06-01', DATE'2020-05-01', 'P', 'LU') AS t(permno, gvkey, linkdt, linkenddt, linkprim, linktype)"""
    )
    out = joins.interval_link(rows, links, "id", "permno", "date", "linkdt", "linkenddt", joins.link_order(), ["gvkey"])
    assert {r["id"]: r["gvkey"] for r in out.collect()} == {1: "C", 2: "B", 3: None}


def test_asof_backward_exact_day_tie_and_age(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 'a', DATE'2020-01-10'), (2, 'a', DATE'2022-01-10'), (3, 'a', DATE'2019-01-01'), (4, CAST(NULL AS STRING), DATE'2020-01-10') AS t(id, k, d)")
    right = spark.sql("SELECT * FROM VALUES ('a', DATE'2020-01-10', 1, 7), ('a', DATE'2020-01-10', 2, 8), ('a', DATE'2020-01-11', 3, 9) AS t(k, d2, o, v)")
    out = {r["id"]: (r["v"], r["age_days"], r["matched"]) for r in joins.asof_backward(left, right, "k", "d", "d2", ["v"], ["o"], 548).collect()}
    assert out == {1: (8, 0, True), 2: (None, None, False), 3: (None, None, False), 4: (None, None, False)}


def test_asof_nearest_tie_goes_back(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 'a', DATE'2020-01-10'), (2, 'a', DATE'2020-01-14'), (3, 'a', DATE'2021-06-01') AS t(id, k, d)")
    right = spark.sql("SELECT * FROM VALUES ('a', DATE'2020-01-05', 1), ('a', DATE'2020-01-15', 2) AS t(k, d2, v)")
    out = {r["id"]: r["v"] for r in joins.asof_nearest(left, right, "k", "d", "d2", ["v"], ["v"], 370).collect()}
    assert out == {1: 1, 2: 2, 3: None}


def test_priority_dedup_and_conflicts(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.1D, '0', 1), (1, 0.1D, 'X', 2), (1, 0.1D, 'X', 2), (2, 0.1D, NULL, 1), (2, 0.2D, 'Y', 2) AS t(k, ret, cusip, n)")
    assert {r["k"]: r["cusip"] for r in dedup.priority_dedup(df, ["k"], ["ret"], ["cusip"], ["n"]).collect()} == {1: "X", 2: "Y"}
    assert [tuple(r) for r in dedup.core_conflicts(df, ["k"], ["ret"]).collect()] == [(2, "ret")]


def test_gates(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'train', 5), (2, 'validation', 7), (3, 'test', 9), (3, 'test', 9) AS t(k, split, month)")
    with pytest.raises(ValueError):
        quality.require_unique(df, ["k"])
    with pytest.raises(ValueError):
        quality.require_columns(df, ["none"])
    with pytest.raises(ValueError):
        quality.require_no_leakage(["target_x"])
    assert quality.require_ordered_splits(df, "split", "month") is df
    with pytest.raises(ValueError):
        quality.require_ordered_splits(df.withColumn("month", F.lit(1)), "split", "month")


def test_scalars(spark):
    row = spark.range(1).select(
        x.zero_pad(F.lit(" 12 "), 6).alias("a"), x.zero_pad(F.lit("1234567"), 6).alias("b"), x.clean_identifier(F.lit("320193.0"), 10).alias("c"), x.clean_identifier(F.lit("nan")).alias("d"),
        x.is_placeholder(F.lit("0.0")).alias("e"), x.is_placeholder(F.lit("A0")).alias("f"), x.slug(F.lit("_XGB-model v1.2!")).alias("g"), x.safe_divide(F.lit(1.0), F.lit(1e-10)).alias("h"),
        x.log_positive(F.lit(0.0)).alias("i"), x.stars(F.lit(-2.0)).alias("j"), x.percent(F.lit(0.12345)).alias("k"), x.parse_bool(F.lit("TRUE")).alias("l"), x.to_number(F.lit("x")).alias("m"),
        F.round(x.softmax([F.lit(float("nan")), F.lit(1.0), F.lit(2.0)])[0], 6).alias("n"), x.argmax([F.lit(1.0), F.lit(3.0), F.lit(3.0)]).alias("o"), x.sheet_name(F.lit(" a / b ")).alias("p"),
    ).first()
    assert tuple(row) == ("000012", "1234567", "0000320193", None, True, False, "xgb_model_v1_2", None, None, "**", "12.35%", True, None, 0.333333, 1, "a_b")


def test_gap_lags_and_rolling(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, 1.0D), (1, 2, 2.0D), (1, 4, 4.0D) AS t(entity, month_id, v)")
    w = timeseries.by("entity")
    out = df.select("month_id", timeseries.shifted(F.col("v"), 1, w).alias("a"), timeseries.shifted(F.col("v"), 2, w).alias("b"), timeseries.rolling(F.col("v"), "sum", 2, w).alias("s")).orderBy("month_id")
    assert [tuple(r) for r in out.collect()] == [(1, None, None, None), (2, 1.0, None, 3.0), (4, None, None, 6.0)]


def test_history_masks_gaps(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, 1.0D), (1, 3, 3.0D) AS t(entity, month_id, v)")
    rows = timeseries.history(df, "entity", ["v"], 3).orderBy("month_id").collect()
    assert [s["v"] for s in rows[1]["steps"]] == [1.0, 0.0, 3.0] and rows[1]["masked"] == [False, True, False]
    assert rows[0]["masked"] == [True, True, False]


def test_bucket_is_not_ntile(spark):
    ranks = spark.range(1, 8).select(F.col("id").alias("r"), xsection.bucket(F.col("id"), F.lit(7), 5).alias("b")).orderBy("r")
    assert [r["b"] for r in ranks.collect()] == [1, 1, 2, 3, 4, 5, 5]
    assert spark.range(1).select(xsection.bucket(F.lit(1), F.lit(4), 5).alias("b")).first()["b"] is None


def test_redundant_columns(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.sin("id").alias("c"))
    assert xsection.redundant(df, ["a", "b", "c"]) == ["b"]


def test_rank_ic_policies(spark):
    rows = [("m", "s", 1, e, float(e), float(e)) for e in range(6)] + [("m", "s", 2, e, 1.0, float(e)) for e in range(6)] + [("m", "s", 3, e, float(e), float(e)) for e in range(4)]
    df = spark.createDataFrame(rows, "model string, split string, month_id int, entity int, score double, target double")
    assert [(r["month_id"], r["rank_ic"]) for r in rank_ic.monthly_rank_ic(df).collect()] == [(1, pytest.approx(1.0))]
    assert {r["month_id"]: r["rank_ic"] for r in rank_ic.monthly_rank_ic(df, keep_null_months=True).collect()} == {1: pytest.approx(1.0), 2: None, 3: None}


def test_turnover_through_an_empty_month_and_fallback(spark):
    held = spark.createDataFrame([("x", "m", "s", 1, 1, 1.0, 0.5), ("x", "m", "s", 1, 2, -1.0, 2.5), ("x", "m", "s", 3, 1, 1.0, 0.1)], "spec string, model string, split string, month_id int, entity int, w double, ret double")
    months = spark.createDataFrame([("m", "s", i) for i in (1, 2, 3)], "model string, split string, month_id int")
    rows = portfolio.portfolio_returns(held, months, 10.0).orderBy("month_id").collect()
    assert [r["gross_return"] for r in rows] == pytest.approx([-2.0, 0.0, 0.1])
    assert [r["turnover"] for r in rows] == pytest.approx([2.0, 2.0, 1.0])
    assert [r["turnover_method"] for r in rows] == ["initial_abs_weight", "non_drift_fallback", "drift_adjusted"]
    assert rows[0]["net_return"] == pytest.approx(-2.0 - 0.002)


def test_break_even_cumulative_zeroes_the_wealth(spark):
    months = [(1, 0.02, 0.5), (1, -0.01, 0.4), (1, 0.03, 0.6), (2, -0.1, 1.0)]
    df = spark.createDataFrame(months, "k int, gross_return double, turnover double")
    out = {r["k"]: r["break_even_cumulative_bps"] for r in performance.break_even_cumulative(df, ["k"]).collect()}
    c = out[1] / 10_000
    assert math.prod(1 + g - c * t for k, g, t in months if k == 1) == pytest.approx(1.0, abs=1e-9) and out[2] == 0.0


def _overlay_by_hand(rows, vol_target, cost=0.0025, threshold=0.02):
    """The state table row by row, for comparison."""
    import statistics

    base = [r["net_return"] or 0.0 for r in rows]
    out, wealth, peak, trough, age, rec, past, lam, gross = [], 1.0, 1.0, 1.0, 0, 0, [], None, 0.0
    vols = []
    for i, r in enumerate(rows):
        window = base[max(0, i - 4) : i]
        vols.append(statistics.stdev(window) * math.sqrt(12) if len(window) == 4 else None)
        b1 = base[i - 1] if i else None
        b2 = (1 + base[i - 1]) * (1 + base[i - 2]) - 1 if i > 1 else None
        known = [v for v in vols[-36:] if v is not None]
        everything = [v for v in vols if v is not None]
        usual = statistics.median(known) if len(known) >= 4 else statistics.median(everything) if len(everything) >= 4 else None
        usual = None if usual is None else min(max(usual, 0.03), 1.0)
        dd = wealth / peak - 1
        d1, d3 = dd - (past[-1] if past else 0.0), (dd - past[-3] if len(past) > 2 else None)
        recovering = dd < 0 and wealth > trough * 1.01 and d1 > 0
        if dd >= 0:
            state = "new_high"
        elif d1 <= -0.1 or (b1 is not None and b1 <= -0.1):
            state = "shock_drawdown"
        elif age >= 3 and ((d3 is not None and d3 <= -0.05) or (d1 <= 0 and b2 is not None and b2 < 0)):
            state = "grinding_drawdown"
        elif recovering:
            state = "stale_recovery" if rec >= 3 and dd < -0.05 and not (b2 is not None and b2 > threshold) else "recovery"
        else:
            state = "deep_drawdown_not_recovering" if dd <= -0.25 else "shallow_drawdown"
        value, multiple = overlay.EXPOSURE[state], overlay.MULTIPLE.get(state)
        if b2 is not None and b2 > threshold:
            value, multiple, state = 1.0, 1.5, f"{state}_{overlay.TWO_MONTHS}"
        elif b1 is not None and b1 > 0:
            value, multiple, state = max(value, 0.75), 1.25, f"{state}_{overlay.ONE_MONTH}"
        used = value
        if vol_target and usual and multiple and vols[i]:
            used = min(value, usual * multiple / vols[i], 1.0)
        turn = used * r["gross_exposure"] if lam is None else used * r["turnover"] + abs(used - lam) * gross
        net = used * r["gross_return"] - cost * turn
        wealth *= 1 + net
        if wealth >= peak:
            peak = trough = wealth
            age = rec = 0
        else:
            age += 1
            if wealth < trough:
                trough, rec = wealth, 0
            elif wealth > trough * 1.01:
                rec += 1
        past.append(dd)
        lam, gross = used, r["gross_exposure"]
        out.append((r["month_id"], state, used, net, turn, wealth / peak - 1))
    return out


@pytest.mark.parametrize("vol_target", [False, True])
def test_overlay_equals_the_table(spark, vol_target):
    import random

    draw = random.Random(4)
    rows = []
    for k in range(6):
        for i in range(70):
            g = draw.gauss(-0.004 if i < 40 else 0.01, 0.05) - (0.15 if draw.random() < 0.04 else 0)
            rows.append((k, i + 1, g, None if i == 9 else g - 0.001, draw.random(), 1.0 + draw.random()))
    df = spark.createDataFrame(rows, "k int, month_id int, gross_return double, net_return double, turnover double, gross_exposure double")
    got = {(r["k"], r["month_id"]): r for r in overlay.overlay(df, ["k"], vol_target).collect()}
    states = set()
    for k in range(6):
        own = [r.asDict() for r in df.filter(F.col("k") == k).orderBy("month_id").collect()]
        for month, state, used, net, turn, after in _overlay_by_hand(own, vol_target):
            r = got[k, month]
            assert r["state"] == state
            assert (r["lambda_t"], r["overlay_net_return"], r["overlay_turnover"], r["drawdown_after"]) == pytest.approx((used, net, turn, after), abs=1e-9)
            states.add(state)
    assert {s.split("_reentry")[0] for s in states} >= {"new_high", "shock_drawdown", "grinding_drawdown", "recovery", "shallow_drawdown"}


def test_moments_need_enough_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    row = df.agg(stats.skewness(F.col("v")).alias("s"), stats.kurtosis(F.col("v")).alias("k"), stats.t_stat(F.col("v")).alias("t")).first()
    assert row["s"] == pytest.approx(0.935219529582825) and row["k"] is None and row["t"] == pytest.approx(2.6457513110645907)


def test_streaming_windows_and_batches(spark, sf_dir, tmp_path):
    from panelyard.streaming import events

    stream = events.windowed(events.read_events(spark, sf_dir))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    whole = events.windowed(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("windows").select("start", "event_type", "n").collect())) == sorted(map(tuple, whole.select("start", "event_type", "n").collect()))
    events.append_batches(events.read_events(spark, sf_dir), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_readers_and_writers(spark, tmp_path):
    from panelyard.sources import readers, writers

    (tmp_path / "a.csv").write_text("GVKEY,datadate,v\n001,2020-01-31,1.5\n002,bad,x\n")
    rows = readers.typed_csv(spark, str(tmp_path / "a.csv"), ["gvkey"], ["datadate"], ["v"]).collect()
    assert [(r["GVKEY"], str(r["datadate"]), r["v"]) for r in rows] == [("001", "2020-01-31", 1.5), ("002", "None", None)]
    df = spark.sql("SELECT 1 AS A, double('NaN') AS b")
    writers.parquet(df, str(tmp_path / "p"))
    found, lost = readers.dataset(spark, str(tmp_path / "p"), ["a", "zz"])
    assert found.columns == ["a"] and lost == ["zz"]
    assert readers.missing_as_null(df).first()["b"] is None
    assert readers.prefixed(readers.lower_columns(df), "comp_", ["a"]).columns == ["a", "comp_b"]
    assert writers.markdown(spark.range(1)).splitlines()[-1] == "| 0 |"
    assert readers.best_candidate({"x/all_factors": ["date", "ret"], "y": ["date"]}, ["date", "ret"], {"all_factors": 10}) == "x/all_factors"
    assert readers.feature_list({"g": ["a", "b"], "h": ["b"]}, ["g", "h"], ["a", "b"]) == ["a", "b"]
    assert readers.prediction_names(["x_predictions.parquet", "debug_predictions.parquet"], ["y_predictions.parquet"]) == (["x_predictions.parquet"], ["missing: y_predictions.parquet"])
