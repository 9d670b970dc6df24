"""Queries of scans, sinks, gates, identifiers, dates and further statistics, with their DuckDB equivalents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import dates
from panelyard.functions import scalars as x
from panelyard.operators import boosting, features, joins, models, networks, orders, quality, quantiles, stats, timeseries, training, xsection
from panelyard.plans import performance, portfolio, rank_ic
from panelyard.queries import _BETS, _MEASURES, _PANEL, _RETURNS, _bets, _monthly, panel, query, rounded, scores, targets
from panelyard.sources import readers, writers
from panelyard.sources.readers import table


@query(
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR || '.0' WHEN 1 THEN ' ' || p_partkey::VARCHAR || ' ' WHEN 2 THEN 'nan' ELSE p_partkey::VARCHAR END AS raw FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 2 THEN lpad(p_partkey::VARCHAR, 10, '0') END AS id, p_partkey % 4 = 2 OR p_partkey = 0 AS blank FROM t"""
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    raw = F.when(key % 4 == 0, F.concat(key.cast("string"), F.lit(".0"))).when(key % 4 == 1, F.concat(F.lit(" "), key.cast("string"), F.lit(" "))).when(key % 4 == 2, "nan").otherwise(key.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", x.clean_identifier(raw, 10).alias("id"), x.is_placeholder(raw).alias("blank"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed, CAST(CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH END AS DATE) AS available,
  last_day(CAST(o_orderdate AS DATE) - INTERVAL 0 DAY) AS month_end FROM orders"""
)
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in three formats and one that is none, read back; and when they can be used."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, F.date_format(day, "MM/dd/yyyy")).otherwise("n/a")
    parsed = dates.to_date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed.alias("parsed"), dates.available_from(parsed).alias("available"), dates.month_end(day).alias("month_end"))


@query(
    """SELECT p_partkey, regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9_-]+', '_', 'g') AS sheet, p_size % 2 = 0 AS flag, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS number,
  round(CASE WHEN p_size < 40 THEN ln(1 + (p_size - 20) / 20.0) END, 6) AS lg, CASE WHEN p_size >= 26 THEN '***' WHEN p_size >= 20 THEN '**' WHEN p_size >= 17 THEN '*' ELSE '' END AS marks FROM part WHERE p_size > 0"""
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, r = F.col("p_size"), (F.col("p_size") - 20) / 20.0
    return table(spark, sf_dir, "part").filter("p_size > 0").select(
        "p_partkey", x.sheet_name(F.concat_ws(" / ", "p_name", "p_type")).alias("sheet"), x.parse_bool(F.when(size % 2 == 0, " Yes ").otherwise("off")).alias("flag"),
        x.to_number(F.when(size % 3 == 0, F.col("p_retailprice").cast("string")).otherwise("n.a.")).alias("number"), F.round(x.log1p_return(F.when(size < 40, r)), 6).alias("lg"), x.stars(size / 10.0).alias("marks"),
    )


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS code, CAST(round(c_acctbal, 2) AS DOUBLE) AS balance, CASE WHEN c_custkey % 5 <> 0 THEN DATE '2020-01-31' END AS day FROM customer")
def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read with typed columns; ids keep their zeros, what is no date is null."""
    path = writers.scratch(spark, "typed-scan")
    made = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("Code"), F.round("c_acctbal", 2).alias("Balance"), F.when(F.col("c_custkey") % 5 == 0, "none").otherwise("20200131").alias("Day"))
    writers.csv(made, path)
    df = readers.lower_columns(readers.typed_csv(spark, path, ["code"], ["day"], ["balance"]))
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "code", "balance", "day")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, 1 AS n_lacking FROM orders")
def dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by priority and read by requested columns in any case; one that is asked for is not there."""
    path = writers.scratch(spark, "dataset-scan")
    writers.parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, partition_by=["o_orderpriority"])
    df, lacking = readers.dataset(spark, path, ["O_ORDERKEY", "o_totalprice", "O_OrderPriority", "permno"])
    return df.withColumn("n_lacking", F.lit(len(lacking)))


@query("SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM nation")
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.scratch(spark, "directory-scan")
    writers.parquet(table(spark, sf_dir, "nation").coalesce(1), f"{path}/a/b")
    return readers.directory(spark, path).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source_file").alias("n_files"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS score FROM supplier WHERE s_suppkey % 7 <> 0")
def prediction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions under another naming; rows without a key go, what is no number is null."""
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey")).alias("PERMNO"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal").cast("string")).otherwise("x").alias("pred"))
    return readers.predictions(s, {"PERMNO": "id", "pred": "score"}, ["id"], ["score"])


@query("SELECT n_nationkey, n_name AS geo_n_name, CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey::DOUBLE END AS geo_v FROM nation")
def prefixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") % 2 == 0, F.col("n_regionkey").cast("double")).otherwise(F.lit(float("nan"))).alias("v"))
    return readers.missing_as_null(readers.prefixed(n, "geo_", ["n_nationkey"]))


#: part under the names of accounting columns.
_COMP = {"comp_saley": "p_retailprice", "comp_niy": "p_size", "comp_oancfy": "p_partkey", "comp_cusip": "p_name", "comp_fyr": "p_size", "comp_datadate": "p_brand", "comp_atq": "p_partkey"}


def _comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_double = lambda c: F.col(c).cast("double") if c in ("p_retailprice", "p_size", "p_partkey") else F.col(c)
    return table(spark, sf_dir, "part").select("p_partkey", *[as_double(c).alias(name) for name, c in _COMP.items()])


@query("SELECT p_partkey, round(ln(p_retailprice), 6) AS acct_log_sales, round(p_size / p_retailprice, 6) AS acct_net_income_margin, round((p_size - p_partkey) / p_retailprice, 6) AS acct_accruals_to_sales FROM part")
def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios whose inputs are there."""
    made = features.accounting_ratios(_comp(spark, sf_dir))
    return rounded(made.select("p_partkey", "acct_log_sales", "acct_net_income_margin", "acct_accruals_to_sales"))


_WANTED = [(d.name, d.kind, ",".join(d.inputs)) for d in features.derived_features()]


@query(
    f"""WITH have AS (SELECT list(column_name) AS c FROM (DESCRIBE SELECT {", ".join(f"{c} AS {name}" for name, c in _COMP.items())} FROM part)),
want AS (SELECT *, list_filter(string_split(required_columns, ','), lambda x: NOT list_contains(c, x)) AS lost FROM (VALUES {", ".join(map(str, _WANTED))}) AS v(feature, feature_type, required_columns), have)
SELECT feature, feature_type, required_columns, len(lost) = 0 AS created, CASE WHEN len(lost) > 0 THEN 'missing required columns: ' || array_to_string(lost, ',') ELSE '' END AS skipped_reason FROM want"""
)
def accounting_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which accounting features the columns allow, and what the others lack."""
    return features.feature_status(_comp(spark, sf_dir))


_CHOICE = {
    "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "twin": "l_quantity * 2 + 1", "l_discount": "l_discount", "l_tax": "l_tax", "fixed": "l_linenumber * 0.0",
    "mostly_empty": "CASE WHEN l_linenumber = 1 AND l_tax > 0.04 THEN l_tax END", "half_empty": "CASE WHEN l_linenumber <= 2 THEN l_discount END", "late_twin": "3 - l_tax", "tiny": "l_discount * 0.000001",
}
_CHOICE_COLUMNS = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CHOICE.items())


@query(
    f"""WITH f AS (SELECT {_CHOICE_COLUMNS} FROM lineitem),
s AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS o, 1 - count({c}) / count(*) AS missing, min({c}) = max({c}) AS flat, var_pop({c}) <= 1e-12 AS still FROM f" for i, c in enumerate(_CHOICE))}),
fell AS (SELECT *, CASE WHEN missing >= 0.6 THEN 'missing' WHEN flat THEN 'constant' WHEN still THEN 'variance' END AS reason FROM s),
pairs AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) >= 0.999999999 AS same FROM f" for i, a in enumerate(_CHOICE) for b in list(_CHOICE)[i + 1 :] if "fixed" not in (a, b))}),
twins AS (SELECT DISTINCT b FROM pairs JOIN fell x ON x.feature = a JOIN fell y ON y.feature = b WHERE same AND x.reason IS NULL AND y.reason IS NULL)
SELECT coalesce(reason, CASE WHEN b IS NOT NULL THEN 'redundant' ELSE 'kept' END) AS reason, feature FROM fell LEFT JOIN twins ON b = feature
UNION ALL SELECT 'indicator', feature FROM (SELECT feature FROM s WHERE missing >= 0.1 ORDER BY missing DESC, feature LIMIT 10)"""
)
def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of ten columns of the order lines are features, why the others are none, and which get an indicator."""
    df = table(spark, sf_dir, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CHOICE.items()])
    kept, why = features.select_features(df, df.columns)
    rows = [(reason, name) for name, reason in why.items()] + [("kept", k) for k in kept] + [("indicator", c) for c in features.missing_indicators(df, df.columns)]
    return spark.createDataFrame(rows, "reason string, feature string")


@query(
    f"""WITH names AS ({" UNION ALL ".join(f"SELECT '{t}' AS source, column_name AS name FROM (DESCRIBE {t})" for t in ("orders", "lineitem", "events", "pages"))}
UNION ALL SELECT 'comp', column_name FROM (DESCRIBE SELECT {", ".join(f"{c} AS {name}" for name, c in _COMP.items())} FROM part))
SELECT source, name, CASE WHEN name IN ('comp_cik', 'comp_cik_norm', 'comp_conm', 'comp_cusip', 'comp_tic') OR contains(lower(name), 'cusip') OR contains(lower(name), 'cik') THEN 'identifier_or_name'
  WHEN name IN ('comp_available_date', 'comp_datadate') OR contains(lower(name), 'date') THEN 'date_or_availability_metadata'
  WHEN name IN ('compustat_age_days', 'compustat_match') THEN 'linking_or_validation_helper'
  WHEN name IN ('comp_costat', 'comp_curcdq', 'comp_exchg', 'comp_fic', 'comp_fqtr', 'comp_fyearq', 'comp_fyr') THEN 'categorical_or_fiscal_metadata' END AS reason FROM names"""
)
def column_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of some tables, and why they are no features."""
    frames = {t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "events", "pages")} | {"comp": _comp(spark, sf_dir).drop("p_partkey")}
    names = spark.createDataFrame([(t, c) for t, df in frames.items() for c in df.columns], "source string, name string")  # metadata: a row a column
    return names.withColumn("reason", features.column_reason(F.col("name")))


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) SELECT c_custkey, n_orders FROM customer JOIN o ON o_custkey = c_custkey"""
)
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return quality.checked_join(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], "inner", one_to_one=True)


@query(
    """SELECT 'unique' AS gate, count(*) = count(DISTINCT o_orderkey) AS passed FROM orders UNION ALL SELECT 'repeated', count(*) = count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'no_nulls', count(*) = count(o_totalprice) FROM orders UNION ALL SELECT 'columns', true UNION ALL SELECT 'lacking', false UNION ALL SELECT 'leakage', false UNION ALL SELECT 'complete', true
UNION ALL SELECT 'splits', true UNION ALL SELECT 'same_count', true UNION ALL SELECT 'lost_rows', false UNION ALL SELECT 'one_date', false UNION ALL SELECT 'predictions', true UNION ALL SELECT 'no_predictions', false"""
)
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate on data that passes or that does not."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), dates.month_id(F.col("o_orderdate")).alias("month_id"))
    third = F.ntile(3).over(timeseries.Window.orderBy("month_id"))
    months = o.select("month_id").distinct().withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), third)).withColumn("score", F.lit(1.0)).withColumn("none", F.lit(None).cast("double"))
    run = {
        "unique": lambda: quality.require_unique(o, ["o_orderkey"]), "repeated": lambda: quality.require_unique(o, ["o_custkey"]), "no_nulls": lambda: quality.require_no_nulls(o, ["o_totalprice"]),
        "columns": lambda: quality.require_columns(o, ["O_CUSTKEY"]), "lacking": lambda: quality.require_columns(o, ["permno"]), "leakage": lambda: quality.require_no_leakage(["ret", "target_ret"]),
        "complete": lambda: quality.require_complete(o, "o_totalprice", ["o_orderkey"]), "splits": lambda: quality.require_ordered_splits(months, "split", "month_id"),
        "same_count": lambda: quality.require_same_count(o, o.join(months, "month_id")), "lost_rows": lambda: quality.require_same_count(o, o.filter("o_totalprice < 0")),
        "one_date": lambda: quality.require_one_date_a_month(o, "day", "month_id"), "predictions": lambda: quality.require_predictions(months, ["score", "none"], skipped=("none",)),
        "no_predictions": lambda: quality.require_predictions(months, ["score", "none"]),
    }
    rows = []
    for name, gate in run.items():
        try:
            gate()
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "gate string, passed boolean")


@query(
    """WITH l AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 2 AS INTEGER) END AS avail FROM orders)
SELECT count(*) AS n_rows, count(avail) AS n_with_value, count(*) FILTER (avail > day) AS n_early, round(count(*) FILTER (avail > day) / count(avail), 6) AS share_early FROM l"""
)
def lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(day.alias("day"), F.when(k % 3 > 0, F.date_add(day, (k % 5 - 2).cast("int"))).alias("avail"))
    return rounded(quality.lookahead_audit(df, "day", "avail"))


@query(
    f"""WITH {_PANEL}, e AS (SELECT split, ret AS a, target AS b FROM tg WHERE split IS NOT NULL AND target IS NOT NULL AND ret IS NOT NULL),
r AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY a) + (count(*) OVER (PARTITION BY split, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY split ORDER BY b) + (count(*) OVER (PARTITION BY split, b) - 1) / 2.0 AS y FROM e)
SELECT split, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1"""
)
def pooled_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(orders.spearman(targets(spark, sf_dir), ["split"], "ret", "target"))


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT 'all' AS part, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r"""
)
def spearman_of_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key holds all rows, and one column has eleven values."""
    lines = table(spark, sf_dir, "lineitem", ["l_discount", "l_extendedprice"]).withColumn("part", F.lit("all"))
    return rounded(orders.spearman(lines, ["part"], "l_discount", "l_extendedprice"))


@query(
    """WITH u AS (UNPIVOT (SELECT o_orderpriority, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders) ON o_totalprice, o_custkey INTO NAME "column" VALUE v),
q AS (SELECT o_orderpriority, "column", count(v) AS n, unnest([0.01, 0.25, 0.5, 0.99]) AS probability, unnest(quantile_cont(v, [0.01, 0.25, 0.5, 0.99])) AS value FROM u GROUP BY 1, 2)
SELECT o_orderpriority, "column", n, CAST(probability AS DOUBLE) AS probability, round(value, 6) AS value FROM q"""
)
def quantile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of two columns by priority, in one selection."""
    return rounded(quantiles.exact_quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_totalprice", "o_custkey"], [0.01, 0.25, 0.5, 0.99]))


_HOT = """l AS (SELECT l_shipdate AS since, l_orderkey * 8 + l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 5 = 0),
o AS (SELECT o_orderkey, o_orderdate AS day FROM orders), last AS (SELECT since, max(line) AS line FROM l GROUP BY 1), next AS (SELECT since, min(line) AS line FROM l GROUP BY 1)"""


def _hot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", F.col("o_orderdate").alias("day"), F.lit("all").alias("k"))
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"]).filter("l_returnflag = 'R' AND l_orderkey % 5 = 0")
    return left, lines.select(F.lit("all").alias("k"), F.col("l_shipdate").alias("since"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))


@query(f"WITH {_HOT} SELECT o_orderkey, line, CAST(date_diff('day', since, day) AS INTEGER) AS age_days FROM o ASOF LEFT JOIN last ON day >= since")
def asof_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the last returned line before it; all rows have one key, which is cut into ranges of dates."""
    return joins.asof_backward(*_hot(spark, sf_dir), "k", "day", "since", ["line"], ["line"], segmented=True).select("o_orderkey", "line", "age_days")


@query(
    f"""WITH {_HOT}, b AS (SELECT o_orderkey, line, date_diff('day', since, day) AS away FROM o ASOF LEFT JOIN last ON day >= since),
f AS (SELECT o_orderkey, line, date_diff('day', day, since) AS away FROM o ASOF LEFT JOIN next ON day <= since),
m AS (SELECT o_orderkey, CASE WHEN f.away IS NULL OR b.away <= f.away THEN b.line ELSE f.line END AS line, CASE WHEN f.away IS NULL OR b.away <= f.away THEN b.away ELSE f.away END AS away FROM b JOIN f USING (o_orderkey))
SELECT o_orderkey, CASE WHEN away <= 2 THEN line END AS line, CAST(CASE WHEN away <= 2 THEN away END AS INTEGER) AS distance_days FROM m"""
)
def asof_nearest_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the nearest returned line within two days, over one key cut into ranges."""
    return joins.asof_nearest(*_hot(spark, sf_dir), "k", "day", "since", ["line"], ["line"], 2, segmented=True).select("o_orderkey", "line", "distance_days")


_FOOTERS = ("region", "customer", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in _FOOTERS))
def footer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of some tables by their footers alone."""
    return readers.footer_counts(spark, {t: f"{sf_dir}/{t}.parquet" for t in _FOOTERS})


@query(
    """SELECT 'kept' AS step, count(*) AS rows_before, count(*) AS rows_after, 0.0::DOUBLE AS difference, true AS passed FROM orders
UNION ALL SELECT 'lost', count(*), count(*) FILTER (o_orderkey % 7 <> 0), 0.0, false FROM orders
UNION ALL SELECT 'changed', count(*), count(*), round(max(abs(round(o_totalprice, 0) - o_totalprice)), 6), false FROM orders"""
)
def watched_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writes of the orders, whose gates look at counts that were taken on the way."""
    rows = []
    price = F.col("o_totalprice")
    steps = {"kept": (price, F.lit(True)), "lost": (price, F.col("o_orderkey") % 7 != 0), "changed": (F.round(price, 0), F.lit(True))}
    for name, (value, condition) in steps.items():
        watched = quality.Watched()
        orders_ = watched.watch(table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), "before")
        made = watched.unchanged(orders_.filter(condition).withColumn("value", value), "after", "value", "o_totalprice")
        writers.parquet(made, writers.scratch(spark, f"watched-{name}"))
        try:
            watched.require_same_count("before", "after")
            watched.require_unchanged("after")
            passed = True
        except ValueError:
            passed = False
        after = watched.counts("after")
        rows.append((name, watched.counts("before")["rows"], after["rows"], float(after["difference"]), passed))
    return rounded(spark.createDataFrame(rows, "step string, rows_before long, rows_after long, difference double, passed boolean"))


# ---------------------------------------------------------------- models: trained on the train split, chosen on validation, scored on test


_USED = ["ret", "ret_lag1", "ret_lag2", "mom_6m", "vol_12m", "market_lag1"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return features, the target and its class within the month, as a table that fitting, validation and scoring read."""
    df = timeseries.return_features(targets(spark, sf_dir)).filter("target is not null")
    return writers.cut_lineage(xsection.quantile_label(df, "target", ["month_id"], ["entity"]).filter("label is not null"))


def _held_out(scored: DataFrame) -> DataFrame:
    """Rank IC by month of test scores."""
    ic = rank_ic.monthly_rank_ic(scored.withColumn("split", F.lit("test")))
    return ic.select("model", "month_id", "n_obs", "rank_ic")


@query()
def boosted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class boosting: the points of the whole grid, the mean rank IC on validation, and that of test for the chosen one."""
    df = _labelled(spark, sf_dir)
    fitted = boosting.fit(df.filter("split = 'train'"), _USED, "label", boosting.GRID)
    best, found = boosting.choose(df.filter("split = 'validation'"), fitted, "target")
    scored = boosting.score(df.filter("split = 'test'"), {str(best): fitted[best]}, ["entity", "month_id", "target"])
    test = _held_out(scored).groupBy(F.col("model").cast("int").alias("candidate")).agg(F.avg("rank_ic").alias("test_ic"), F.count("rank_ic").alias("n_months"))
    rows = [(i, p["max_iter"], p["learning_rate"], p["max_leaf_nodes"], ic, i == best) for i, (p, ic) in enumerate(zip(boosting.GRID, found, strict=True))]
    return spark.createDataFrame(rows, "candidate int, max_iter int, learning_rate double, max_leaf_nodes int, validation_ic double, selected boolean").join(test, "candidate", "left")


@query()
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores of a boosted classifier that was saved and loaded again with its list of features."""
    df = _labelled(spark, sf_dir)
    (model,) = boosting.fit(df.filter("split = 'train'"), _USED, "label", [{"max_iter": 6, "learning_rate": 0.1, "max_leaf_nodes": 8}])
    path = writers.scratch(spark, "boosted")
    boosting.save(model, spark, path)
    scored = boosting.score(df.filter("split = 'test'"), {"boosted": boosting.load(spark, path, _USED)}, ["entity", "month_id", "target"])
    return scored.select("entity", "month_id", "target", "model", *[F.col("probability")[i].alias(f"p{i}") for i in range(3)], "score")


def _trained(spark: SparkSession, sf_dir: str, network, label: str, settings: training.Settings, **more) -> tuple[DataFrame, training.Trained]:
    df = _labelled(spark, sf_dir)
    train, validation = df.filter("split = 'train'"), df.filter("split = 'validation'")
    return df, training.train(network, train, validation, training.Inputs(training.fit_scaler(train, _USED)), label, "target", settings, **more)


@query()
def perceptron_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of the perceptron with three classes: loss, rank IC on validation, which one was kept."""
    _, model = _trained(spark, sf_dir, networks.Perceptron(len(_USED)), "label", training.Settings(most_rounds=4, patience=2, batch=128), class_weights=True)
    return spark.createDataFrame([tuple(h[c] for c in ("round", "train_loss", "validation_ic", "validation_ic_return", "selected")) for h in model.history], "round int, train_loss double, validation_ic double, validation_ic_return double, selected boolean")


@query()
def perceptron_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores of the perceptron for the return itself, from the saved model."""
    df, model = _trained(spark, sf_dir, networks.Perceptron(len(_USED), 1), "target", training.Settings(most_rounds=3, batch=128))
    path = writers.scratch(spark, "perceptron")
    training.save(model, spark, path)
    return training.score(df.filter("split = 'test'"), training.load(spark, path, _USED), ["entity", "month_id", "target"]).select("entity", "month_id", "target", "score")


@query()
def feature_token_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out monthly rank IC of the feature-token transformer beside that of ridge."""
    df, model = _trained(spark, sf_dir, networks.FeatureTokens(len(_USED), 16, 1, 4), "label", training.Settings(most_rounds=3, batch=128))
    test = df.filter("split = 'test'")
    _, line, _ = models.fit_grid(df, _USED, "target", {"ridge": models.ridge(100.0, "target")})
    keep = ["entity", "month_id", "target"]
    both = training.score(test, model, keep).withColumn("model", F.lit("tokens")).select(*keep, "model", "score").unionByName(line.transform(test).withColumn("model", F.lit("ridge")).select(*keep, "model", "score"))
    return _held_out(both)


@query()
def two_branch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores of the two-branch model: its tabular branch comes from a feature-token model and stays as it is."""
    df = timeseries.history(_labelled(spark, sf_dir), "entity", ["ret", "market_ret"], 12, fill=None)
    train, validation = df.filter("split = 'train'"), df.filter("split = 'validation'")
    tabular = training.fit_scaler(train, _USED)
    tokens = training.train(networks.FeatureTokens(len(_USED), 16, 1, 4), train, validation, training.Inputs(tabular), "label", "target", training.Settings(most_rounds=1, batch=128))
    network = networks.TwoBranches(len(_USED), 2, 12, 16, 1, 4, 0.1, 16, 1, 4, False, 16)
    start, _ = networks.warm_start(network.draw(np.random.default_rng(42)), tokens.params, ("tabular.",))
    settings = training.Settings(most_rounds=2, batch=128, rates={"temporal.": 5e-4}, frozen=("tabular.",))
    model = training.train(network, train, validation, training.Inputs(tabular, training.sequence_scaler(train, ["ret", "market_ret"]), 12), "label", "target", settings, class_weights=True, start=start)
    return training.score(df.filter("split = 'test'"), model, ["entity", "month_id", "target"]).select("entity", "month_id", "target", *[F.col("probability")[i].alias(f"p{i}") for i in range(3)], "score", "expected_return")


@query()
def logistic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class logistic regression, each C without and with class weights: mean rank IC on validation."""
    df = models.class_weights(_labelled(spark, sf_dir).withColumn("label", F.col("label").cast("double")), "label")
    rows = df.filter("split = 'train'").count()
    best, _, found = models.fit_grid(df, _USED, "target", models.logistic_grid("label", rows, (0.01, 1.0)), after=models.with_class_scores)
    return spark.createDataFrame([(name, ic, name == best) for name, ic in found.items()], "candidate string, validation_ic double, selected boolean")


@query(
    f"""WITH {_PANEL}, h AS (SELECT a.entity, a.month_id, a.split, b.month_id - a.month_id + 6 AS step, b.ret FROM tg a JOIN panel b ON a.entity = b.entity AND b.month_id BETWEEN a.month_id - 5 AND a.month_id WHERE a.split IS NOT NULL),
t AS (SELECT ret FROM h WHERE split = 'train'), m AS (SELECT median(ret) AS m FROM t), s AS (SELECT any_value(m) AS m, avg(coalesce(ret, m)) AS mean, stddev_pop(coalesce(ret, m)) AS sd FROM t, m)
SELECT entity, month_id, CAST(6 - count(*) AS INTEGER) AS n_masked, round(sum(step * (coalesce(ret, m) - mean) / sd), 5) AS weighted FROM h, s GROUP BY ALL"""
)
def scaled_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of six months scaled by what the training rows show, summed with the steps as weights; masked steps are 0."""
    all_months = timeseries.history(panel(spark, sf_dir).select("entity", "month_id", "ret"), "entity", ["ret"], 6, fill=None)
    df = all_months.join(targets(spark, sf_dir).select("entity", "month_id", "split"), ["entity", "month_id"])
    made = training.scaled_steps(df, training.sequence_scaler(df.filter("split = 'train'"), ["ret"]))
    weighted = F.aggregate(F.transform("steps", lambda s, i: s["ret"] * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return made.select("entity", "month_id", F.size(F.filter("masked", lambda x: x)).alias("n_masked"), F.round(weighted, 5).alias("weighted"))


@query(
    f"""WITH {_PANEL} SELECT entity, count(*) AS n, round(covar_samp(ret, market_ret) / var_samp(market_ret), 6) AS beta,
  round(avg(ret) - covar_samp(ret, market_ret) / var_samp(market_ret) * avg(market_ret), 6) AS alpha, round(corr(ret, market_ret), 6) AS corr FROM panel WHERE ret IS NOT NULL AND market_ret IS NOT NULL GROUP BY 1"""
)
def market_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.beta_alpha(panel(spark, sf_dir), ["entity"], "ret", "market_ret"))


@query(
    f"""WITH {_RETURNS}, w AS (SELECT *, product(1 + net_return) OVER (PARTITION BY spec, model, split ORDER BY month_id) AS v FROM mr), d AS (SELECT *, v / max(v) OVER (PARTITION BY spec, model, split ORDER BY month_id) - 1 AS dd FROM w),
a AS (SELECT spec, model, split, count(*) AS n, product(1 + net_return) AS wealth, min(dd) AS worst, avg(dd) AS mean_dd, sqrt(avg(least(net_return, 0) * least(net_return, 0))) * sqrt(12) AS down,
  stddev_samp(net_return) AS sd, avg(net_return) AS m, skewness(net_return) AS skew, kurtosis(net_return) AS kurt, min(net_return) AS worst_month, max(net_return) AS best_month FROM d GROUP BY ALL)
SELECT spec, model, split, round(CASE WHEN wealth > 0 THEN power(wealth, 12.0 / n) - 1 END, 5) AS annual_return, round(CASE WHEN wealth > 0 AND sd > 0 THEN (power(wealth, 12.0 / n) - 1) / (sd * sqrt(12)) END, 5) AS sharpe_geometric,
  round(CASE WHEN wealth > 0 AND down > 0 THEN (power(wealth, 12.0 / n) - 1) / down END, 5) AS sortino, round(CASE WHEN wealth > 0 AND worst < 0 THEN (power(wealth, 12.0 / n) - 1) / abs(worst) END, 5) AS calmar,
  round(mean_dd, 5) AS mean_drawdown, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END, 5) AS t, round(worst_month, 5) AS worst_month, round(best_month, 5) AS best_month FROM a"""
)
def risk_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = performance.performance(_monthly(spark, sf_dir), ["spec", "model", "split"])
    return rounded(df.select("spec", "model", "split", "annual_return", "sharpe_geometric", "sortino", "calmar", "mean_drawdown", "skew", "kurt", "t", "worst_month", "best_month"), 5)


@query(
    f"""WITH {_PANEL}, h AS (SELECT coalesce(b.ret, 0) AS v, b.revenue AS w FROM panel a JOIN panel b ON a.entity = b.entity AND b.month_id BETWEEN a.month_id - 5 AND a.month_id)
SELECT 'ret' AS feature, count(v) AS n, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM h UNION ALL SELECT 'revenue', count(w), round(median(w), 6), round(avg(w), 6), round(stddev_pop(w), 6) FROM h"""
)
def sequence_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timeseries.history(panel(spark, sf_dir).select("entity", "month_id", "ret", "revenue"), "entity", ["ret", "revenue"], 6)
    return rounded(models.sequence_stats(df, ["ret", "revenue"]))


@query(
    """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 0 WHEN '1' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders"""
)
def custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a custom order of categories, then by mixed directions with nulls last."""
    place = F.coalesce(F.try_element_at(F.create_map(F.lit("3"), F.lit(0), F.lit("1"), F.lit(1)), F.substring("o_orderpriority", 1, 1)), F.lit(2))
    w = timeseries.Window.partitionBy("o_custkey").orderBy(place, F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("SELECT l_returnflag AS label, round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)), 6) AS weight FROM lineitem GROUP BY 1")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = models.class_weights(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label")), "label")
    return rounded(df.groupBy("label").agg(F.max("weight").alias("weight")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as a Markdown report and read back from it."""
    path = writers.scratch(spark, "report")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    writers.report(spark, writers.markdown(counts), path)
    cells = F.split(F.col("value"), r"\s*\|\s*")
    rows = spark.read.text(path).filter("value like '| %' and value not like '%l_returnflag%'")
    return rows.select(cells[1].alias("l_returnflag"), cells[2].alias("l_linestatus"), cells[3].cast("long").alias("n"))


@query(
    f"""WITH {_PANEL}, ok AS (SELECT * FROM sc WHERE score IS NOT NULL AND target IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY model, split, month_id ORDER BY score) + (count(*) OVER (PARTITION BY model, split, month_id, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY model, split, month_id ORDER BY target) + (count(*) OVER (PARTITION BY model, split, month_id, target) - 1) / 2.0 AS b FROM ok)
SELECT model, split, month_id, count(*) AS n_obs, CASE WHEN count(*) >= 9 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS rank_ic FROM rk GROUP BY ALL"""
)
def rank_ic_all_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with too few rows are kept, without a correlation."""
    return rounded(rank_ic.monthly_rank_ic(scores(spark, sf_dir), min_obs=9, keep_null_months=True))


@query(
    f"""WITH {_BETS}, ok AS (SELECT * FROM bets WHERE score IS NOT NULL AND ret IS NOT NULL),
pf AS (SELECT q, ls, CASE WHEN ls THEN 'long_short_' ELSE 'long_only_' END || printf('%g', q) AS portfolio FROM (VALUES (0.1::DOUBLE), (0.2)) a(q), (VALUES (true), (false)) b(ls)),
x AS (SELECT ok.*, portfolio, ls, row_number() OVER (w ORDER BY score, entity) AS u, row_number() OVER (w ORDER BY score DESC, entity) AS d, greatest(1, floor(count(*) OVER w * q)) AS k FROM ok, pf WINDOW w AS (PARTITION BY portfolio, model, split, month_id)),
l AS (SELECT *, CASE WHEN d <= k THEN 1 WHEN u <= k THEN -1 END AS leg FROM x), f AS (SELECT *, count(*) FILTER (leg = -1) OVER (PARTITION BY portfolio, model, split, month_id) AS s FROM l WHERE leg = 1 OR (ls AND leg = -1)),
wt AS (SELECT portfolio, model, split, month_id, entity, ret AS r, leg / count(*) OVER (PARTITION BY portfolio, model, split, month_id, leg) AS w FROM f WHERE s > 0 OR NOT ls),
wi AS (SELECT *, dense_rank() OVER (PARTITION BY portfolio, model, split ORDER BY month_id) AS idx FROM wt), gr AS (SELECT portfolio, model, split, idx, any_value(month_id) AS month_id, sum(w * r) AS g FROM wi GROUP BY portfolio, model, split, idx),
tr AS (SELECT portfolio, model, split, idx, entity, w, 0 AS b FROM wi UNION ALL SELECT portfolio, model, split, idx + 1, entity, 0, CASE WHEN 1 + g > 0 THEN w * (1 + r) / (1 + g) ELSE w END FROM wi JOIN gr USING (portfolio, model, split, idx)),
nt AS (SELECT portfolio, model, split, idx, entity, sum(w) AS w, sum(b) AS b FROM tr GROUP BY ALL), tu AS (SELECT portfolio, model, split, idx, sum(abs(w - b)) AS turnover FROM nt GROUP BY ALL),
mo AS (SELECT portfolio, model, split, month_id, cost_bps, g - cost_bps / 10000 * turnover AS r FROM gr JOIN tu USING (portfolio, model, split, idx), (VALUES (0.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (100.0)) c(cost_bps)),
v AS (SELECT *, product(1 + r) OVER (PARTITION BY portfolio, model, split, cost_bps ORDER BY month_id) AS v FROM mo), h AS (SELECT *, v / max(v) OVER (PARTITION BY portfolio, model, split, cost_bps ORDER BY month_id) - 1 AS dd FROM v)
SELECT portfolio, model, split, cost_bps, count(*) AS n_months, round(avg(r), 5) AS mean_return, round(CASE WHEN product(1 + r) > 0 THEN power(product(1 + r), 12.0 / count(*)) - 1 END, 5) AS annual_return, round(min(dd), 5) AS max_drawdown FROM h GROUP BY ALL"""
)
def baseline_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-only and long-short baselines of both fractions at every cost."""
    monthly = features.expand_costs(portfolio.baseline_portfolios(_bets(spark, sf_dir)))
    df = performance.performance(monthly, ["portfolio", "model", "split", "cost_bps"])
    return rounded(df.select("portfolio", "model", "split", "cost_bps", "n_months", "mean_return", "annual_return", "max_drawdown"), 5)


_YEAR = "CASE WHEN product(1 + {r}) > 0 THEN power(product(1 + {r}), 12.0 / count({r})) - 1 END"
_RATIO = "CASE WHEN stddev_samp({r}) > 0 THEN (" + _YEAR + ") / (stddev_samp({r}) * sqrt(12)) END"


@query(
    f"""WITH {_RETURNS}, x AS (SELECT m.*, net_return / nullif(gross_exposure, 0) AS u, k.market_ret AS b, product(1 + net_return) OVER (PARTITION BY spec, model, split ORDER BY m.month_id) AS v FROM mr m LEFT JOIN mk k ON k.month_id = m.month_id + 1),
d AS (SELECT *, v / max(v) OVER (PARTITION BY spec, model, split ORDER BY month_id) - 1 AS dd FROM x),
l AS (SELECT spec, model, split, count(*) AS n, avg(net_return) AS my, avg(b) AS mx, var_pop(b) AS vx, var_pop(net_return) AS vy, covar_pop(b, net_return) AS cxy FROM x WHERE b IS NOT NULL GROUP BY ALL),
ab AS (SELECT *, CASE WHEN n >= 3 AND vx > 0 THEN cxy / vx END AS beta FROM l),
al AS (SELECT *, my - beta * mx AS alpha, sqrt(greatest(n * (vy - beta * cxy) / nullif(n - 2, 0), 0) * (1.0 / n + mx * mx / (n * vx))) AS se FROM ab)
SELECT spec, model, split, count(*) AS months, round({_YEAR.format(r="net_return")}, 5) AS net_annualized_return, round(stddev_samp(net_return) * sqrt(12), 5) AS net_annualized_volatility, round({_RATIO.format(r="net_return")}, 4) AS net_sharpe,
  round({_YEAR.format(r="gross_return")}, 5) AS gross_annualized_return, round(stddev_samp(gross_return) * sqrt(12), 5) AS gross_annualized_volatility, round({_RATIO.format(r="gross_return")}, 4) AS gross_sharpe,
  round(min(dd), 5) AS max_drawdown, round(avg(dd), 5) AS average_drawdown, round(avg(turnover), 5) AS average_monthly_turnover, round(avg(gross_exposure), 5) AS average_gross_exposure, round(avg(net_exposure), 5) + 0.0 AS average_net_exposure,
  round({_YEAR.format(r="u")}, 5) AS exposure_normalized_annualized_return, round({_RATIO.format(r="u")}, 4) AS exposure_normalized_sharpe, round(avg(n_long), 5) AS average_n_long, round(avg(n_short), 5) AS average_n_short,
  min(n_long) AS min_n_long, min(n_short) AS min_n_short, round(any_value(alpha) * 12, 5) AS annualized_alpha, round(any_value(beta), 5) AS beta, round(CASE WHEN any_value(se) > 0 THEN any_value(alpha) / any_value(se) END, 4) AS alpha_tstat,
  coalesce(any_value(al.n), 0) AS alpha_beta_months FROM d LEFT JOIN al USING (spec, model, split) GROUP BY spec, model, split"""
)
def spec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the fifty specifications of each score and split, against the market."""
    market = panel(spark, sf_dir).select("month_id", F.col("market_ret").alias("benchmark_return")).distinct()
    df = performance.spec_summary(_monthly(spark, sf_dir), market, ["spec", "model", "split"])
    four = ("net_sharpe", "gross_sharpe", "exposure_normalized_sharpe", "alpha_tstat")
    return df.withColumns({c: F.round(c, 4 if c in four else 5) + 0.0 for c, kind in df.dtypes if kind == "double"})


@query(
    f"""WITH {_BETS}, ok AS (SELECT * FROM bets WHERE score IS NOT NULL AND ret IS NOT NULL),
x AS (SELECT *, row_number() OVER (w ORDER BY score, entity) AS u, row_number() OVER (w ORDER BY score DESC, entity) AS d, greatest(1, floor(count(*) OVER w * 0.2)) AS k FROM ok WINDOW w AS (PARTITION BY model, split, month_id)),
l AS (SELECT *, CASE WHEN d <= k THEN 1 WHEN u <= k THEN -1 END AS leg FROM x), f AS (SELECT *, count(*) FILTER (leg = -1) OVER (PARTITION BY model, split, month_id) AS s FROM l WHERE leg IS NOT NULL),
wt AS (SELECT model, split, month_id, entity, ret AS r, leg / count(*) OVER (PARTITION BY model, split, month_id, leg) AS w FROM f WHERE s > 0),
wi AS (SELECT *, dense_rank() OVER (PARTITION BY model, split ORDER BY month_id) AS idx FROM wt), gr AS (SELECT model, split, idx, any_value(month_id) AS month_id, sum(w * r) AS g FROM wi GROUP BY model, split, idx),
tr AS (SELECT model, split, idx, entity, w, 0 AS b FROM wi UNION ALL SELECT model, split, idx + 1, entity, 0, CASE WHEN 1 + g > 0 THEN w * (1 + r) / (1 + g) ELSE w END FROM wi JOIN gr USING (model, split, idx)),
nt AS (SELECT model, split, idx, entity, sum(w) AS w, sum(b) AS b FROM tr GROUP BY ALL), tu AS (SELECT model, split, idx, sum(abs(w - b)) AS turnover, count(*) FILTER (w > 0) AS n_long, count(*) FILTER (w < 0) AS n_short FROM nt GROUP BY ALL),
mo AS (SELECT model, split, month_id, cost_bps, turnover, n_long, n_short, g - cost_bps / 10000 * turnover AS r FROM gr JOIN tu USING (model, split, idx), (VALUES (0.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (100.0)) c(cost_bps)),
v AS (SELECT mo.*, k.market_ret AS b, product(1 + r) OVER (PARTITION BY model, split, cost_bps ORDER BY mo.month_id) AS v FROM mo LEFT JOIN mk k ON k.month_id = mo.month_id + 1), h AS (SELECT *, v / max(v) OVER (PARTITION BY model, split, cost_bps ORDER BY month_id) - 1 AS dd FROM v)
SELECT model, split, cost_bps, count(*) AS months, round(product(1 + r) - 1, 4) AS cumulative_return, round({_YEAR.format(r="r")}, 5) AS annualized_return, round(stddev_samp(r) * sqrt(12), 5) AS annualized_volatility,
  round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(12) END, 4) AS sharpe_ratio, round(avg(r) / nullif(sqrt(avg(least(r, 0) * least(r, 0))), 0) * sqrt(12), 4) AS sortino_ratio, round(min(dd), 5) AS max_drawdown,
  round(CASE WHEN min(dd) < 0 THEN ({_YEAR.format(r="r")}) / abs(min(dd)) END, 4) AS calmar_ratio, round(avg(r), 5) AS mean_monthly_return, round(avg(r) / (nullif(stddev_samp(r), 0) / sqrt(count(*))), 4) AS monthly_return_tstat,
  round(avg(CAST(r > 0 AS DOUBLE)), 5) AS hit_rate, round(skewness(r), 4) AS skewness, round(kurtosis(r), 4) AS excess_kurtosis, round(avg(turnover), 5) AS average_turnover, round(avg(n_long), 5) AS average_number_of_long_stocks,
  round(avg(n_short), 5) AS average_number_of_short_stocks, round(covar_samp(r, b) / var_samp(CASE WHEN r IS NOT NULL THEN b END), 5) AS beta_to_benchmark,
  round((avg(CASE WHEN b IS NOT NULL THEN r END) - covar_samp(r, b) / var_samp(b) * avg(b)) * 12, 5) AS annualized_alpha, round(corr(r, b), 5) AS correlation FROM h GROUP BY ALL"""
)
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the long-short baseline of each score and split at every cost, against the market."""
    monthly = features.expand_costs(portfolio.baseline_returns(_bets(spark, sf_dir), 0.2, True))
    market = panel(spark, sf_dir).select("month_id", F.col("market_ret").alias("benchmark_return")).distinct()
    df = performance.backtest_summary(monthly, market, ["model", "split", "cost_bps"])
    four = ("cumulative_return", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "monthly_return_tstat", "skewness", "excess_kurtosis")
    return df.withColumns({c: F.round(c, 4 if c in four else 5) + 0.0 for c, kind in df.dtypes if kind == "double" and c != "cost_bps"})


@query(
    f"""WITH {_RETURNS}, x1 AS (SELECT spec, model, split, month_id, net_return AS r FROM mr), {_MEASURES.format(w="w1", p="p1", of="x1")},
nm AS (SELECT *, model || '/' || spec AS id, CASE WHEN annual_vol > 0 THEN round(annual_return / annual_vol, 9) END AS sharpe, coalesce(t > 1.96 AND max_drawdown > -0.4, false) AS passes FROM p1 WHERE split = 'validation'),
pre AS (SELECT id, row_number() OVER (ORDER BY passes DESC, sharpe DESC NULLS LAST, round(annual_return, 9) DESC NULLS LAST, id) AS rk FROM nm),
e AS (SELECT model || '/' || spec AS id, net_return AS r, b.market_ret AS b FROM mr JOIN mk b ON b.month_id = mr.month_id + 1 WHERE split = 'test' AND b.market_ret IS NOT NULL)
SELECT id, count(*) AS n, round(covar_samp(r, b) / var_samp(b), 5) AS beta, round(avg(r) - covar_samp(r, b) / var_samp(b) * avg(b), 5) AS alpha, CASE WHEN stddev_pop(r) > 0 THEN round(corr(r, b), 5) END AS corr
FROM e WHERE id IN (SELECT id FROM pre WHERE rk <= 20) GROUP BY 1"""
)
def spec_alpha_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market alpha and beta on test of the specifications that did best on validation."""
    p, monthly = panel(spark, sf_dir), _monthly(spark, sf_dir).withColumn("id", F.concat_ws("/", "model", "spec"))
    validation = performance.performance(monthly.filter("split = 'validation'"), ["id"])
    passes = (F.col("t") > 1.96) & (F.col("max_drawdown") > -0.4)
    pre = performance.preselect(validation, [F.round("sharpe_geometric", 9).desc_nulls_last(), F.round("annual_return", 9).desc_nulls_last()], passes, "id")
    chosen = performance.choose_specs(monthly.filter("split = 'test'"), pre, top=20, id_col="id")
    market = p.select("month_id", F.col("market_ret").alias("benchmark_return")).distinct()
    return rounded(performance.benchmark_alpha_beta(chosen, market, ["id"]), 5)


@query("SELECT 'nation' AS run, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def results_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs written as CSV and read as one table."""
    path = writers.scratch(spark, "results")
    for run, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        writers.csv(table(spark, sf_dir, run).select(F.lit(run).alias("run"), F.col(key).alias("key"), F.col(f"{run[0]}_name").alias("name")), f"{path}/{run}")
    return readers.results(spark, [f"{path}/nation", f"{path}/region"], "run string, key int, name string")


@query("SELECT s_suppkey, s_acctbal AS score, 's_acctbal' AS used FROM supplier")
def fallback_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first score column of a list that the table has stands in for those before it."""
    s = table(spark, sf_dir, "supplier")
    used = readers.first_column(s, ["expected_return", "S_ACCTBAL", "s_suppkey"])
    return s.select("s_suppkey", F.col(used).alias("score"), F.lit(used).alias("used"))
