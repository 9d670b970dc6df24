"""Feature selection and derivation on small hand-made rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import features, moments


def test_reasons_and_scores(spark):
    want = {
        "comp_cik": features.IDENTIFIER, "comp_cik_norm": features.IDENTIFIER, "comp_conm": features.IDENTIFIER, "comp_cusip": features.IDENTIFIER, "comp_tic": features.IDENTIFIER, "NCUSIP8": features.IDENTIFIER,
        "comp_datadate": features.DATE, "comp_available_date": features.DATE, "UpDate": features.DATE, "date_cik": features.IDENTIFIER,
        "compustat_age_days": features.HELPER, "compustat_match": features.HELPER, "COMPUSTAT_MATCH": None,
        **dict.fromkeys(["comp_costat", "comp_curcdq", "comp_exchg", "comp_fic", "comp_fqtr", "comp_fyearq", "comp_fyr"], features.CATEGORICAL),
        "comp_saley": None, "month_id": None, "mom_12_1": None,
    }
    assert {c: features.reason_of(c) for c in want} == want
    rows = spark.createDataFrame([(c,) for c in want], "column string")
    assert {r[0]: r[1] for r in rows.select("column", features.column_reason(F.col("column"))).collect()} == want
    df = spark.sql("SELECT 1 AS permno, 0.5D AS prediction_a, CAST(NULL AS DOUBLE) AS prediction_b, 0.1D AS prob_x_top, 'x' AS score_c, 1.0D AS score_d, 2.0D AS score_date")
    assert features.score_columns(df) == ["prediction_a", "score_d"]
    comp = spark.sql("SELECT 1 AS comp_fyr, 1.0D AS comp_saley, 'x' AS comp_niy, 2 AS comp_dvy, 3.0D AS ret")
    assert features.feature_columns(comp) == ["comp_saley", "comp_dvy"]


def test_selection_and_indicators(spark):
    df = spark.range(10).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 3.0 + 1).alias("twin"), F.lit(1.0).alias("flat"), F.when(F.col("id") < 3, F.col("id") * 1.0).alias("holes"), F.when(F.col("id") > 1, F.sin("id")).alias("b")
    )
    kept, why = features.select_features(df, ["a", "twin", "flat", "holes", "b"])
    assert kept == ["a", "b"] and why == {"twin": "redundant", "flat": "constant", "holes": "missing"}
    assert features.missing_indicators(df, ["a", "holes", "b"]) == ["holes", "b"]
    assert features.missing_indicators(df.limit(0), ["a"]) == ["a"]


def test_moments_are_pairwise_complete_and_exact_at_any_level(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 6)) * [1, 1e-3, 10, 1, 1, 1] + [0, 1e6, -50, 0, 3, 0]
    x[:, 3] = -2 * x[:, 0] + 7
    x[:, 5] = x[:, 1] + 1e-7 * rng.standard_normal(3000)
    x[rng.random((3000, 6)) < 0.2] = np.nan
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3)
    m = moments.moment_matrix(df, names)
    frame = pd.DataFrame(x)
    assert np.allclose(m.correlations(), frame.corr(), atol=1e-9) and m.rows == 3000
    assert np.allclose(np.diag(m.n), frame.count()) and np.allclose(m.low, frame.min()) and np.allclose(m.high, frame.max())
    assert np.allclose([m.variance(i) for i in range(6)], frame.var(ddof=0)) and np.allclose([m.mean(i) for i in range(6)], frame.mean())
    assert m.redundant(range(6)) == [3] and m.redundant(range(6), 0.99) == [3, 5] and m.redundant([3, 0]) == [0]
    none = moments.moment_matrix(df.limit(0), names)
    assert none.rows == 0 and none.redundant(range(6)) == [] and features.select_features(df.limit(0), names)[1] == dict.fromkeys(names, "missing")


def test_ratios_need_their_inputs(spark):
    df = spark.sql("SELECT 100.0D AS comp_saley, 60.0D AS comp_cogsy, -5.0D AS comp_niy, 2.0D AS comp_dvy UNION ALL SELECT 0.0D, 1.0D, 0.0D, 1.0D")
    rows = features.accounting_ratios(df).orderBy(F.desc("comp_saley")).collect()
    assert rows[0]["acct_gross_margin"] == pytest.approx(0.4) and rows[0]["acct_dividends_to_earnings"] == pytest.approx(-0.4) and rows[0]["acct_cogs_to_sales"] == pytest.approx(0.6)
    assert rows[1]["acct_gross_margin"] is None and rows[1]["acct_log_sales"] is None and rows[1]["acct_dividends_to_earnings"] is None
    status = {r["feature"]: r for r in features.feature_status(df).collect()}
    assert len(status) == 4 + 31 + 13 and sum(r["created"] for r in status.values()) == 6
    assert status["acct_rd_to_sales"]["skipped_reason"] == "missing required columns: comp_xrdy" and status["acct_cogs_to_sales"]["created"]
    assert status["requested_book_to_market"]["skipped_reason"] == "missing required columns: comp_ceqq,market_equity"
    full = spark.sql("SELECT 1.0D AS comp_niy, 1.0D AS comp_atq")
    assert features.accounting_ratios(full).columns == full.columns and features.feature_status(full).filter("feature = 'requested_net_income_to_assets'").first()["created"]
