"""Choosing and deriving features: column classes, score discovery, parse rates, selection, indicators, ratios, cost scenarios."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.scalars import log_positive, safe_divide
from panelyard.operators import moments

#: Why a column is no feature; the first reason that fits counts. Names stand for themselves, tokens for any name that holds them.
IDENTIFIER, DATE, HELPER, CATEGORICAL = "identifier_or_name", "date_or_availability_metadata", "linking_or_validation_helper", "categorical_or_fiscal_metadata"
REASON_NAMES = {
    IDENTIFIER: ("comp_cik", "comp_cik_norm", "comp_conm", "comp_cusip", "comp_tic"),
    DATE: ("comp_available_date", "comp_datadate"),
    HELPER: ("compustat_age_days", "compustat_match"),
    CATEGORICAL: ("comp_costat", "comp_curcdq", "comp_exchg", "comp_fic", "comp_fqtr", "comp_fyearq", "comp_fyr"),
}
REASON_TOKENS = {IDENTIFIER: ("cusip", "cik"), DATE: ("date",), HELPER: (), CATEGORICAL: ()}
#: Keys, targets and labels of the panels here, which no list of scores may hold.
PANEL_COLUMNS = ("permno", "permco", "gvkey", "ticker", "entity", "month_id", "split", "label", "quintile")


def column_reason(column: Column) -> Column:
    """Why the column of that name is no feature, or null; for names in rows, as schema_table() has them."""
    out, low = F.lit(None).cast("string"), F.lower(column)
    for reason in reversed(REASON_NAMES):
        fits = column.isin(*REASON_NAMES[reason])
        for token in REASON_TOKENS[reason]:
            fits |= F.contains(low, F.lit(token))
        out = F.when(fits, F.lit(reason)).otherwise(out)
    return out


def reason_of(column: str) -> str | None:
    """column_reason() of one name on the driver."""
    fits = (r for r in REASON_NAMES if column in REASON_NAMES[r] or any(t in column.lower() for t in REASON_TOKENS[r]))
    return next(fits, None)


def feature_columns(df: DataFrame, prefix: str = "comp_") -> list[str]:
    """Numeric columns with the prefix and without a reason against them, in order."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, kind in df.dtypes if c.lower().startswith(prefix) and (kind in numeric or kind.startswith("decimal")) and reason_of(c) is None]


def score_columns(df: DataFrame, prefixes: tuple[str, ...] = ("prediction_", "score_")) -> list[str]:
    """Numeric columns with a score's prefix, no probability, target or id, and at least one value."""
    named = [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint") and c.lower().startswith(prefixes) and not c.lower().startswith(("prob_", "target")) and c.lower() not in PANEL_COLUMNS and reason_of(c) is None]
    if not named:
        return []
    row = df.agg(*[F.count(c).alias(c) for c in named]).first()
    return [c for c in named if row[c] > 0]


def parse_rates(df: DataFrame, columns: list[str], least: float = 0.995) -> DataFrame:
    """column, n_text, parse_rate, candidate: the share of non-blank values that are numbers."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    counts = []
    for c in columns:
        filled = text(c).isNotNull() & (text(c) != "")
        counts += [F.count_if(filled).alias(f"__n_{c}"), F.count_if(filled & text(c).try_cast("double").isNotNull()).alias(f"__p_{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__n_{c}").alias("n_text"), F.when(F.col(f"__n_{c}") > 0, F.col(f"__p_{c}") / F.greatest(F.col(f"__n_{c}"), F.lit(1))).alias("parse_rate")) for c in columns])
    return df.agg(*counts).select(F.explode(rows).alias("r")).select("r.*", F.coalesce(F.col("r.parse_rate") >= least, F.lit(False)).alias("candidate"))


def select_features(df: DataFrame, columns: list[str], most_missing: float = 0.6, least_variance: float = 1e-12) -> tuple[list[str], dict[str, str]]:
    """Columns with enough values, more than one of them, some variance, and no earlier twin; and why the others fell.

    All of it comes from one moment matrix, so the data are read once whatever the number of columns.
    """
    m = moments.moment_matrix(df, columns)
    why = {}
    for i, c in enumerate(columns):
        if m.rows == 0 or 1 - m.n[i, i] / m.rows >= most_missing:
            why[c] = "missing"
        elif m.low[i] == m.high[i]:
            why[c] = "constant"
        elif m.variance(i) <= least_variance:
            why[c] = "variance"
    left = [i for i, c in enumerate(columns) if c not in why]
    why |= {columns[i]: "redundant" for i in m.redundant(left)}
    return [c for c in columns if c not in why], why


def missing_indicators(df: DataFrame, columns: list[str], least: float = 0.1, most: int = 10) -> list[str]:
    """Columns that get a missing indicator: at least ``least`` missing, the ``most`` highest rates, ties by name."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    rates = {c: 1 - row[c] / row["n"] if row["n"] else 1.0 for c in columns}
    return sorted((c for c in columns if rates[c] >= least), key=lambda c: (-rates[c], c))[:most]


#: Features from the accounting columns, by kind: name -> input, or (minuend, subtrahend).
LOGS = {"log_sales": "saley", "log_revenue": "revty", "log_common_shares": "cshpry"}
RAW = {"epspxy": "epspxy"}
MARGINS = {
    "gross": ("saley", "cogsy"), "operating": "oiadpy", "ebitda": "oibdpy", "net_income": "niy", "income_before_extra": "ibcy", "pretax": "piy",
    "operating_cf": "oancfy", "free_cash_flow": ("oancfy", "capxy"),
}
EXPENSES = {"cogs": "cogsy", "total_expense": "xopry", "sga": "xsgay", "rd": "xrdy", "capex": "capxy", "interest": "xinty", "tax": "txty"}
PAYOUTS = {"dividends": "dvy", "preferred_dividends": "dvpy"}
FINANCING = {
    "stock_issuance": "sstky", "stock_repurchases": "prstkcy", "long_debt_issuance": "dltisy", "debt_reduction": "dltry", "short_debt_change": "dlcchy",
}
FLOWS = {
    "cash_change": "chechy", "receivables_change": "recchy", "inventory_change": "invchy", "acquisition": "aqcy", "working_capital_change": "wcapcy",
    "investing_cf": "ivncfy", "financing_cf": "fincfy", "accruals": ("niy", "oancfy"),
}
#: Ratios that were asked for: they are only reported, with the inputs that they would need.
REQUESTED = {
    "operating_income_to_assets": "comp_oiadpy comp_atq", "net_income_to_assets": "comp_niy comp_atq", "gross_profit_to_assets": "comp_saley comp_cogsy comp_atq",
    "debt_to_assets": "comp_dlcq comp_dlttq comp_atq", "debt_to_equity": "comp_dlcq comp_dlttq comp_ceqq", "cash_to_assets": "comp_cheq comp_atq", "current_ratio": "comp_actq comp_lctq",
    "asset_growth": "comp_atq", "capex_to_assets": "comp_capxy comp_atq", "log_assets": "comp_atq", "book_to_market": "comp_ceqq market_equity", "dividends_to_assets": "comp_dvy comp_atq",
    "accruals_to_assets": "comp_niy comp_oancfy comp_atq",
}


class Derived(NamedTuple):
    """A derived feature: its name, kind, the columns that it needs, and its value (None if it is only reported)."""

    name: str
    kind: str
    inputs: list[str]
    value: Callable[[], Column] | None


def derived_features(prefix: str = "comp_") -> list[Derived]:
    """All accounting features, made or not: levels, margins, expenses, payouts, financing and flows over sales, and requested ratios."""
    named = lambda top: [prefix + c for c in ([top] if isinstance(top, str) else top)]
    sales = prefix + "saley"

    def ratio(top: list[str], bottom: str) -> Callable[[], Column]:
        return lambda: safe_divide(F.col(top[0]) - F.col(top[1]) if len(top) > 1 else F.col(top[0]), F.col(bottom))

    def over_sales(group: dict, ending: str) -> list[Derived]:
        return [Derived(f"acct_{n}_{ending}", "constructed_ratio", list(dict.fromkeys([*named(top), sales])), ratio(named(top), sales)) for n, top in group.items()]

    out = [Derived(f"acct_{n}", "transformed_level", named(c), lambda c=c: log_positive(F.col(prefix + c))) for n, c in LOGS.items()]
    out += [Derived(f"acct_{n}", "per_share_raw", named(c), lambda c=c: F.col(prefix + c)) for n, c in RAW.items()]
    out += over_sales(MARGINS, "margin")
    for group in (EXPENSES, PAYOUTS, FINANCING, FLOWS):
        out += over_sales(group, "to_sales")
    paid, earned = named(("dvy", "niy"))
    out.append(Derived("acct_dividends_to_earnings", "constructed_ratio", [paid, earned], ratio([paid], earned)))
    return out + [Derived(f"requested_{n}", "requested_ratio_unavailable", inputs.split(), None) for n, inputs in REQUESTED.items()]


def accounting_ratios(df: DataFrame, prefix: str = "comp_") -> DataFrame:
    """df with the acct_* features whose inputs it has, as doubles; infinite values are null."""
    have = {c.lower() for c in df.columns}
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    made = [d for d in derived_features(prefix) if d.value is not None and have.issuperset(d.inputs)]
    return df.withColumns({d.name: finite(d.value().cast("double")) for d in made})


def feature_status(df: DataFrame, prefix: str = "comp_") -> DataFrame:
    """feature, feature_type, required_columns, created, skipped_reason: a row for each feature that can be derived or was asked for."""
    have = {c.lower() for c in df.columns}
    rows = []
    for d in derived_features(prefix):
        lost = ",".join(c for c in d.inputs if c not in have)
        rows.append((d.name, d.kind, ",".join(d.inputs), not lost, f"missing required columns: {lost}" if lost else ""))
    return df.sparkSession.createDataFrame(rows, "feature string, feature_type string, required_columns string, created boolean, skipped_reason string")


def expand_costs(monthly: DataFrame, levels: tuple[float, ...] = (0.0, 5.0, 10.0, 25.0, 50.0, 100.0)) -> DataFrame:
    """Each row once per cost level, with cost_bps and net_return."""
    costs = F.explode(F.array(*[F.lit(float(c)) for c in levels])).alias("cost_bps")
    return monthly.select("*", costs).withColumn("net_return", F.col("gross_return") - F.col("cost_bps") / 10_000 * F.col("turnover"))
