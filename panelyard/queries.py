"""The registered panel queries and their DuckDB equivalents.

The supplier-by-month panel of ``lineitem`` is the dense panel, the customer-by-month panel of ``orders`` the sparse
one. Doubles are rounded once, at the end, on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions import scalars as x
from panelyard.functions.dates import month_id
from panelyard.operators import dedup, features, joins, quality, stats, timeseries, xsection
from panelyard.operators.models import fit_grid, ridge
from panelyard.plans import overlay as overlays
from panelyard.plans import performance, portfolio, rank_ic
from panelyard.sources.readers import schema_table, stable_sample, table
from panelyard.sources.writers import cut_lineage
from panelyard.streaming.events import sessions, windowed

QUERIES: dict = {}
SQL: dict[str, str] = {}

SPLITS = {"train": (1995 * 12 + 1, 1998 * 12 + 12), "validation": (1999 * 12 + 1, 1999 * 12 + 12), "test": (2000 * 12 + 1, 2001 * 12 + 12)}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


# ---------------------------------------------------------------- panels


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice", "l_discount"])
    return lines.groupBy(F.col("l_suppkey").alias("entity"), month_id(F.col("l_shipdate")).alias("month_id")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n_lines")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev = revenue(spark, sf_dir)
    w = timeseries.by("entity")
    ret = F.col("revenue") / timeseries.shifted(F.col("revenue"), 1, w) - 1
    return rev.join(timeseries.market_series(rev, "revenue"), "month_id").withColumn("ret", ret)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel with next month's return as the target and the split of the target's month."""
    w = timeseries.by("entity")
    df = panel(spark, sf_dir).withColumn("target", timeseries.shifted(F.col("ret"), -1, w))
    return df.withColumn("split", rank_ic.split_label(F.col("month_id") + 1, SPLITS)).filter("split is not null")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores a row: last return reversed, and revenue."""
    df = targets(spark, sf_dir).select("entity", "month_id", "split", "target", (-F.col("ret")).alias("reversal"), F.col("revenue").alias("size"))
    return xsection.unpivot(df, ["entity", "month_id", "split", "target"], ["reversal", "size"])


_PANEL = """rev AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS month_id,
  sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n_lines FROM lineitem GROUP BY 1, 2),
mk AS (SELECT month_id, CASE WHEN lag(month_id) OVER o = month_id - 1 THEN sum(revenue) / lag(sum(revenue)) OVER o - 1 END AS market_ret
  FROM rev GROUP BY month_id WINDOW o AS (ORDER BY month_id)),
panel AS (SELECT rev.*, market_ret, CASE WHEN lag(month_id) OVER w = month_id - 1 THEN revenue / lag(revenue) OVER w - 1 END AS ret
  FROM rev JOIN mk USING (month_id) WINDOW w AS (PARTITION BY entity ORDER BY month_id)),
tg AS (SELECT *, CASE WHEN lead(month_id) OVER w = month_id + 1 THEN lead(ret) OVER w END AS target,
  CASE WHEN month_id + 1 BETWEEN 23941 AND 23988 THEN 'train' WHEN month_id + 1 BETWEEN 23989 AND 24000 THEN 'validation' WHEN month_id + 1 BETWEEN 24001 AND 24024 THEN 'test' END AS split
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY month_id)),
sc AS (SELECT entity, month_id, split, target, 'reversal' AS model, -ret AS score FROM tg WHERE split IS NOT NULL
  UNION ALL SELECT entity, month_id, split, target, 'size', revenue FROM tg WHERE split IS NOT NULL)"""

_IC = """ok AS (SELECT * FROM sc WHERE score IS NOT NULL AND target IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY model, split, month_id ORDER BY score) + (count(*) OVER (PARTITION BY model, split, month_id, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY model, split, month_id ORDER BY target) + (count(*) OVER (PARTITION BY model, split, month_id, target) - 1) / 2.0 AS b FROM ok),
ic AS (SELECT model, split, month_id, count(*) AS n_obs, corr(a, b) AS rank_ic FROM rk GROUP BY ALL HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0)"""

_SPREAD = """pr AS (SELECT *, row_number() OVER (PARTITION BY model, split, month_id ORDER BY score, entity) / count(*) OVER (PARTITION BY model, split, month_id) AS pct,
  count(*) OVER (PARTITION BY model, split, month_id) AS n FROM sc WHERE score IS NOT NULL AND target IS NOT NULL),
sp AS (SELECT model, split, month_id, avg(target) FILTER (pct > 0.8) AS top, avg(target) FILTER (pct <= 0.2) AS bottom,
  avg(target) FILTER (pct > 0.8) - avg(target) FILTER (pct <= 0.2) AS spread FROM pr WHERE n >= 5 GROUP BY ALL
  HAVING avg(target) FILTER (pct > 0.8) - avg(target) FILTER (pct <= 0.2) IS NOT NULL)"""


@query(f"WITH {_PANEL} SELECT entity, month_id, round(revenue, 4) AS revenue, n_lines, round(market_ret, 6) AS market_ret, round(ret, 6) AS ret FROM panel")
def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir)
    return df.select("entity", "month_id", F.round("revenue", 4).alias("revenue"), "n_lines", F.round("market_ret", 6).alias("market_ret"), F.round("ret", 6).alias("ret"))


@query(f"WITH {_PANEL}, {_IC} SELECT model, split, month_id, n_obs, round(rank_ic, 6) AS rank_ic FROM ic")
def monthly_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rank_ic.monthly_rank_ic(scores(spark, sf_dir)))


@query(f"WITH {_PANEL}, {_SPREAD} SELECT model, split, month_id, round(top, 6) AS top, round(bottom, 6) AS bottom, round(spread, 6) AS spread FROM sp")
def monthly_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rank_ic.monthly_spread(scores(spark, sf_dir)))


@query(
    f"""WITH {_PANEL}, {_IC}, {_SPREAD},
a AS (SELECT model, split, avg(rank_ic) AS mean_ic, avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(*))) AS ic_t, avg(CAST(rank_ic > 0 AS DOUBLE)) AS ic_hit_rate, count(*) AS n_months FROM ic GROUP BY ALL),
b AS (SELECT model, split, avg(spread) AS mean_spread, avg(spread) / (stddev_samp(spread) / sqrt(count(*))) AS spread_t FROM sp GROUP BY ALL)
SELECT model, split, round(mean_ic, 6) AS mean_ic, round(ic_t, 6) AS ic_t, round(ic_hit_rate, 6) AS ic_hit_rate, n_months, round(mean_spread, 6) AS mean_spread, round(spread_t, 6) AS spread_t FROM a LEFT JOIN b USING (model, split)"""
)
def rank_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scores(spark, sf_dir)
    return rounded(rank_ic.summary(rank_ic.monthly_rank_ic(df), rank_ic.monthly_spread(df)))


# ---------------------------------------------------------------- time series


@query(
    f"""WITH {_PANEL},
l AS (SELECT *, CASE WHEN lag(month_id) OVER w = month_id - 1 THEN lag(ret) OVER w END AS r1, CASE WHEN lag(month_id) OVER w = month_id - 1 THEN lag(market_ret) OVER w END AS m1,
  CASE WHEN lag(month_id, 2) OVER w = month_id - 2 THEN lag(ret, 2) OVER w END AS r2, CASE WHEN lag(month_id, 3) OVER w = month_id - 3 THEN lag(ret, 3) OVER w END AS r3,
  CASE WHEN lag(month_id, 6) OVER w = month_id - 6 THEN lag(ret, 6) OVER w END AS r6, ln(1 + ret) AS lg FROM panel WINDOW w AS (PARTITION BY entity ORDER BY month_id)),
f AS (SELECT entity, month_id, r1 AS ret_lag1, r2 AS ret_lag2, r3 AS ret_lag3, r6 AS ret_lag6, m1 AS market_lag1,
  CASE WHEN count(lg) OVER a = 6 AND lag(month_id, 6) OVER w = month_id - 6 THEN exp(sum(lg) OVER a) - 1 END AS mom_6m,
  CASE WHEN count(lg) OVER b = 11 AND lag(month_id, 12) OVER w = month_id - 12 THEN exp(sum(lg) OVER b) - 1 END AS mom_12_1,
  CASE WHEN count(r1) OVER c = 12 THEN stddev_samp(r1) OVER c END AS vol_12m, CASE WHEN count(r1) OVER d = 24 THEN stddev_samp(r1) OVER d END AS vol_24m,
  CASE WHEN count(CASE WHEN m1 IS NOT NULL THEN r1 END) OVER d = 24 THEN covar_pop(r1, m1) OVER d / var_pop(CASE WHEN r1 IS NOT NULL THEN m1 END) OVER d END AS beta_24m
  FROM l WINDOW w AS (PARTITION BY entity ORDER BY month_id), a AS (PARTITION BY entity ORDER BY month_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
  b AS (PARTITION BY entity ORDER BY month_id ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING), c AS (PARTITION BY entity ORDER BY month_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
  d AS (PARTITION BY entity ORDER BY month_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT entity, month_id, {", ".join(f"round({c}, 6) AS {c}" for c in ["ret_lag1", "ret_lag2", "ret_lag3", "ret_lag6", "mom_6m", "mom_12_1", "vol_12m", "vol_24m", "beta_24m", "market_lag1"])} FROM f"""
)
def return_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timeseries.return_features(panel(spark, sf_dir))
    return rounded(df.select("entity", "month_id", "ret_lag1", "ret_lag2", "ret_lag3", "ret_lag6", "mom_6m", "mom_12_1", "vol_12m", "vol_24m", "beta_24m", "market_lag1"))


@query(
    """WITH p AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month_id, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT entity, month_id, round(total, 4) AS total, round(CASE WHEN lag(month_id) OVER w = month_id - 1 THEN lag(total) OVER w END, 4) AS lag1,
  round(CASE WHEN lag(month_id, 2) OVER w = month_id - 2 THEN lag(total, 2) OVER w END, 4) AS lag2, round(CASE WHEN lead(month_id) OVER w = month_id + 1 THEN lead(total) OVER w END, 4) AS lead1
FROM p WINDOW w AS (PARTITION BY entity ORDER BY month_id)"""
)
def sparse_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = timeseries.by("entity")
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), month_id(F.col("o_orderdate")).alias("month_id")).agg(F.sum("o_totalprice").alias("total"))
    total = F.col("total")
    return rounded(p.select("entity", "month_id", "total", timeseries.shifted(total, 1, w).alias("lag1"), timeseries.shifted(total, 2, w).alias("lag2"), timeseries.shifted(total, -1, w).alias("lead1")), 4)


def _small_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns a tenth as large, so that wealth stays in a sensible range."""
    return panel(spark, sf_dir).select("entity", "month_id", (F.col("ret") / 10).alias("r"), (F.col("market_ret") / 10).alias("m"))


_SMALL = _PANEL + ", s AS (SELECT entity, month_id, ret / 10 AS r, market_ret / 10 AS m FROM panel)"


@query(
    f"""WITH {_SMALL}, w AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY entity ORDER BY month_id) AS v FROM s),
d AS (SELECT *, max(v) OVER (PARTITION BY entity ORDER BY month_id) AS h FROM w)
SELECT entity, month_id, round(v / h - 1, 6) AS drawdown_a, round(v / greatest(1, h) - 1, 6) AS drawdown_b FROM d"""
)
def drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timeseries.with_drawdown(_small_returns(spark, sf_dir), "r", ["entity"], "month_id", False, "drawdown_a")
    return rounded(timeseries.with_drawdown(df, "r", ["entity"], "month_id", True, "drawdown_b").select("entity", "month_id", "drawdown_a", "drawdown_b"))


@query(
    f"""WITH {_SMALL}, y AS (SELECT *, CAST((month_id - 1) // 12 AS INTEGER) AS year FROM s),
w AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY entity, year ORDER BY month_id) AS v FROM y),
d AS (SELECT *, v / greatest(1, max(v) OVER (PARTITION BY entity, year ORDER BY month_id)) - 1 AS dd FROM w)
SELECT entity, year, round(product(1 + coalesce(r, 0)) - 1, 6) AS annual_return, round(min(dd), 6) AS max_drawdown, count(*) AS n_months FROM d GROUP BY ALL"""
)
def calendar_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.calendar_years(_small_returns(spark, sf_dir), ["entity"], "r"))


@query(
    f"""WITH {_SMALL}, a AS (SELECT *, lag(coalesce(r, 0)) OVER (PARTITION BY entity ORDER BY month_id) AS b FROM s),
v AS (SELECT *, CASE WHEN count(b) OVER q = 4 THEN stddev_samp(b) OVER q * sqrt(12) END AS rv FROM a WINDOW q AS (PARTITION BY entity ORDER BY month_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
n AS (SELECT *, CASE WHEN count(rv) OVER q >= 4 THEN median(rv) OVER q END AS m36, CASE WHEN count(rv) OVER z >= 4 THEN median(rv) OVER z END AS mall FROM v
  WINDOW q AS (PARTITION BY entity ORDER BY month_id ROWS BETWEEN 35 PRECEDING AND CURRENT ROW), z AS (PARTITION BY entity ORDER BY month_id))
SELECT entity, month_id, round(rv, 6) AS realized_vol, round(CASE WHEN coalesce(m36, mall) < 0.03 THEN 0.03 WHEN coalesce(m36, mall) > 1 THEN 1 ELSE coalesce(m36, mall) END, 6) AS normal_vol FROM n"""
)
def volatility_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.volatility_state(_small_returns(spark, sf_dir), "r", ["entity"], "month_id").select("entity", "month_id", "realized_vol", "normal_vol"))


@query(
    f"""WITH {_PANEL}, h AS (SELECT a.entity, a.month_id, count(b.month_id) AS seen, sum(coalesce(b.ret, 0) * (b.month_id - a.month_id + 24)) AS weighted
  FROM panel a JOIN panel b ON a.entity = b.entity AND b.month_id BETWEEN a.month_id - 23 AND a.month_id GROUP BY ALL)
SELECT entity, month_id, CAST(24 AS INTEGER) AS n_steps, CAST(24 - seen AS INTEGER) AS n_masked, round(weighted, 6) AS weighted FROM h"""
)
def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timeseries.history(panel(spark, sf_dir).select("entity", "month_id", "ret"), "entity", ["ret"], 24)
    places = F.aggregate(F.transform("steps", lambda s, i: s["ret"] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(df.select("entity", "month_id", F.size("steps").alias("n_steps"), F.size(F.filter("masked", lambda m: m)).alias("n_masked"), places.alias("weighted")))


_FACTORS = """wide AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS month_id, avg(l_discount) FILTER (l_returnflag = 'A') AS "A",
  avg(l_discount) FILTER (l_returnflag = 'N') AS "N", avg(l_discount) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1)"""


@query(f'WITH {_FACTORS} SELECT month_id, round("A", 6) AS "A", round("N", 6) AS "N", round("R", 6) AS "R" FROM wide')
def factor_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_factors(spark, sf_dir))


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(month_id(F.col("l_shipdate")).alias("month_id"), "l_returnflag", "l_discount")
    return xsection.fixed_pivot(lines, ["month_id"], "l_returnflag", "l_discount", ["A", "N", "R"], F.avg)


@query(
    f"""WITH {_FACTORS} SELECT month_id, round(CASE WHEN lag(month_id) OVER w = month_id - 1 THEN lag("R") OVER w END, 6) AS "R_lag1",
  round(CASE WHEN count("R") OVER b = 12 AND lag(month_id, 12) OVER w = month_id - 12 THEN exp(sum(ln(1 + "R")) OVER b) - 1 END, 6) AS "R_mom12",
  round(CASE WHEN count("R") OVER b = 12 AND lag(month_id, 12) OVER w = month_id - 12 THEN stddev_samp("R") OVER b END, 6) AS "R_vol12"
FROM wide WINDOW w AS (ORDER BY month_id), b AS (ORDER BY month_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"""
)
def factor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.factor_features(_factors(spark, sf_dir), ["R"]).select("month_id", "R_lag1", "R_mom12", "R_vol12"))


@query(
    """WITH m AS (SELECT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month_id, arg_max(o_totalprice, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS price FROM orders GROUP BY 1, 2)
SELECT o_custkey, month_id, round(price, 4) AS price, round(CASE WHEN lag(month_id) OVER w = month_id - 1 THEN price / lag(price) OVER w - 1 END, 6) AS ret FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY month_id)"""
)
def month_end_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    latest = o.groupBy("o_custkey", F.col("o_orderdate")).agg(F.max_by("o_totalprice", "o_orderkey").alias("p"))
    df = timeseries.month_end_returns(latest, "o_custkey", "o_orderdate", "p")
    return df.select("o_custkey", "month_id", F.round("price", 4).alias("price"), F.round("ret", 6).alias("ret"))


# ---------------------------------------------------------------- cross-section


@query(
    f"""WITH {_PANEL}, r AS (SELECT entity, month_id, ret, CASE WHEN ret IS NOT NULL THEN row_number() OVER (PARTITION BY month_id ORDER BY ret NULLS LAST, entity) END AS rn, count(ret) OVER (PARTITION BY month_id) AS n FROM panel),
q AS (SELECT entity, month_id, CASE WHEN n >= 5 AND rn IS NOT NULL THEN CAST(greatest(1, ((rn - 1) * 5 + n - 2) // greatest(n - 1, 1)) AS INTEGER) END AS quintile FROM r)
SELECT *, CAST(CASE WHEN quintile = 1 THEN 0 WHEN quintile = 5 THEN 2 WHEN quintile IS NOT NULL THEN 1 END AS INTEGER) AS label FROM q"""
)
def quantile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xsection.quantile_label(panel(spark, sf_dir), "ret", ["month_id"], ["entity"]).select("entity", "month_id", "quintile", "label")


@query(
    f"""WITH {_PANEL} SELECT entity, month_id, round((ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0), 6) AS z, round((revenue - avg(revenue) OVER w) / nullif(stddev_pop(revenue) OVER w, 0), 6) AS z_pop FROM panel WINDOW w AS (PARTITION BY month_id)"""
)
def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel(spark, sf_dir).select("entity", "month_id", xsection.zscore("ret", ["month_id"]).alias("z"), xsection.zscore("revenue", ["month_id"], 0).alias("z_pop")))


@query(
    f"""WITH {_PANEL}, b AS (SELECT month_id, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi, quantile_cont(revenue, 0.01) AS lo2, quantile_cont(revenue, 0.99) AS hi2 FROM panel GROUP BY 1),
c AS (SELECT entity, month_id, CAST(ret IS NULL AS INTEGER) AS ret_missing, CASE WHEN ret < lo THEN lo WHEN ret > hi THEN hi ELSE ret END AS ret, CASE WHEN revenue < lo2 THEN lo2 WHEN revenue > hi2 THEN hi2 ELSE revenue END AS revenue FROM panel JOIN b USING (month_id)),
m AS (SELECT month_id, median(ret) AS m1, median(revenue) AS m2 FROM c GROUP BY 1)
SELECT entity, month_id, ret_missing, round(coalesce(ret, m1), 6) AS ret, round(coalesce(revenue, m2), 6) AS revenue FROM c JOIN m USING (month_id)"""
)
def winsorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = xsection.winsorise_impute(panel(spark, sf_dir), ["ret", "revenue"], "month_id", flags=["ret"])
    return df.select("entity", "month_id", "ret_missing", F.round("ret", 6).alias("ret"), F.round("revenue", 6).alias("revenue"))


@query(
    f"""WITH {_PANEL}, l AS (SELECT split, 'ret' AS feature, ret AS v FROM tg WHERE split IS NOT NULL UNION ALL SELECT split, 'target', target FROM tg WHERE split IS NOT NULL)
SELECT split, feature, count(*) AS n_rows, count(*) - count(v) AS n_missing, round((count(*) - count(v)) * 100.0 / count(*), 6) AS pct_missing FROM l GROUP BY ALL"""
)
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xsection.missingness(targets(spark, sf_dir), ["ret", "target"], ["split"]))


# ---------------------------------------------------------------- joins


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validity interval per customer and year of orders; every third is open, kinds and priorities vary."""
    o = table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"]).select(F.col("o_custkey").alias("permno"), F.year("o_orderdate").alias("y")).distinct()
    mix = F.col("permno") + F.col("y")
    return o.select(
        "permno",
        F.concat(F.lit("G"), x.zero_pad(F.col("permno"), 6), F.lit("-"), F.col("y").cast("string")).alias("gvkey"),
        F.make_date("y", F.lit(1), F.lit(1)).alias("linkdt"),
        F.when(mix % 3 != 0, F.make_date("y", F.lit(9), F.lit(30))).alias("linkenddt"),
        F.when(mix % 2 == 0, "P").otherwise("C").alias("linkprim"),
        F.element_at(F.array(F.lit("LC"), F.lit("LU"), F.lit("LS")), (mix % 3 + 1).cast("int")).alias("linktype"),
    )


_LINKS = """links AS (SELECT DISTINCT o_custkey AS permno, 'G' || lpad(o_custkey::VARCHAR, 6, '0') || '-' || year(o_orderdate)::VARCHAR AS gvkey, make_date(year(o_orderdate), 1, 1) AS linkdt,
  CASE WHEN (o_custkey + year(o_orderdate)) % 3 <> 0 THEN make_date(year(o_orderdate), 9, 30) ELSE DATE '2100-12-31' END AS linkenddt,
  CASE WHEN (o_custkey + year(o_orderdate)) % 2 = 0 THEN 0 ELSE 1 END AS prim, (o_custkey + year(o_orderdate)) % 3 AS kind FROM orders)"""


@query(
    f"""WITH {_LINKS}, c AS (SELECT o_orderkey, gvkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY prim, kind, linkdt DESC) AS n FROM orders JOIN links ON permno = o_custkey AND CAST(o_orderdate AS DATE) BETWEEN linkdt AND linkenddt)
SELECT o.o_orderkey, c.gvkey FROM orders o LEFT JOIN c ON c.o_orderkey = o.o_orderkey AND n = 1"""
)
def interval_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("permno"), F.to_date("o_orderdate").alias("date"))
    return joins.interval_link(rows, _links(spark, sf_dir), "o_orderkey", "permno", "date", "linkdt", "linkenddt", joins.link_order(), ["gvkey"]).select("o_orderkey", "gvkey")


def _urgent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    return o.drop("o_orderpriority"), o.filter("o_orderpriority like '1%'").select("k", F.col("date").alias("rdate"), F.col("o_orderkey").alias("rkey"))


_URGENT = """o AS (SELECT o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS p FROM orders),
u AS (SELECT k, date AS rdate, max(o_orderkey) AS rkey FROM o WHERE p LIKE '1%' GROUP BY 1, 2)"""


@query(
    f"""WITH {_URGENT}, j AS (SELECT o.o_orderkey, u.rkey, date_diff('day', u.rdate, o.date) AS age FROM o ASOF LEFT JOIN u ON o.k = u.k AND o.date >= u.rdate)
SELECT o_orderkey, CASE WHEN age <= 548 THEN rkey END AS rkey, CAST(CASE WHEN age <= 548 THEN age END AS INTEGER) AS age_days, coalesce(age <= 548, false) AS matched FROM j"""
)
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _urgent(spark, sf_dir)
    return joins.asof_backward(left, right, "k", "date", "rdate", ["rkey"], ["rkey"], 548).select("o_orderkey", "rkey", "age_days", "matched")


@query(
    f"""WITH {_URGENT}, f AS (SELECT k, rdate, min(rkey) AS rkey FROM (SELECT k, date AS rdate, o_orderkey AS rkey FROM o WHERE p LIKE '1%') GROUP BY 1, 2),
b AS (SELECT o.o_orderkey, u.rkey, date_diff('day', u.rdate, o.date) AS d FROM o ASOF LEFT JOIN u ON o.k = u.k AND o.date >= u.rdate),
g AS (SELECT o.o_orderkey, f.rkey, date_diff('day', o.date, f.rdate) AS d FROM o ASOF LEFT JOIN f ON o.k = f.k AND o.date <= f.rdate),
n AS (SELECT b.o_orderkey, CASE WHEN b.d IS NOT NULL AND (g.d IS NULL OR b.d <= g.d) THEN b.rkey ELSE g.rkey END AS rkey, CASE WHEN b.d IS NOT NULL AND (g.d IS NULL OR b.d <= g.d) THEN b.d ELSE g.d END AS d FROM b JOIN g USING (o_orderkey))
SELECT o_orderkey, CASE WHEN d <= 60 THEN rkey END AS rkey, CAST(CASE WHEN d <= 60 THEN d END AS INTEGER) AS distance_days, coalesce(d <= 60, false) AS matched FROM n"""
)
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _urgent(spark, sf_dir)
    return joins.asof_nearest(left, right, "k", "date", "rdate", ["rkey"], ["rkey"], 60).select("o_orderkey", "rkey", "distance_days", "matched")


@query("SELECT count(*) FILTER (o IS NOT NULL AND e IS NOT NULL) AS in_both, count(*) FILTER (o IS NOT NULL AND e IS NULL) AS only_orders, count(*) FILTER (o IS NULL) AS only_events FROM (SELECT DISTINCT o_custkey AS o FROM orders) FULL JOIN (SELECT DISTINCT user_id AS e FROM events) ON o = e")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).distinct()
    tagged = a.intersect(b).select(F.lit("in_both").alias("t")).unionAll(a.exceptAll(b).select(F.lit("only_orders"))).unionAll(b.join(a, "k", "left_anti").select(F.lit("only_events")))
    return tagged.agg(*[F.count_if(F.col("t") == t).alias(t) for t in ("in_both", "only_orders", "only_events")])


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = quality.checked_join(n, r.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], "inner")
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return quality.checked_join(c.withColumnRenamed("c_nationkey", "n_nationkey"), n, ["n_nationkey"], "inner").join(big, "c_custkey", "left_semi").select("c_custkey", "n_name", "r_name")


# ---------------------------------------------------------------- deduplication


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("nullif(l_returnflag, 'N')").alias("flag"), "l_linestatus")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_returnflag, 'N') AS flag, l_linestatus FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END, l_linenumber, l_partkey) = 1"""
)
def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.priority_dedup(_flagged(spark, sf_dir), ["l_orderkey"], ["l_linestatus"], ["flag"], ["l_linenumber", "l_partkey"])


@query(
    """WITH g AS (SELECT l_orderkey, count(DISTINCT nullif(l_returnflag, 'N')) + max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS a, count(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, concat_ws(',', CASE WHEN a > 1 THEN 'flag' END, CASE WHEN b > 1 THEN 'l_linestatus' END) AS conflicts FROM g WHERE a > 1 OR b > 1"""
)
def core_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.core_conflicts(_flagged(spark, sf_dir), ["l_orderkey"], ["flag", "l_linestatus"])


@query("WITH g AS (SELECT l_orderkey, count(*) AS group_size FROM lineitem GROUP BY 1) SELECT group_size, count(*) AS n_keys FROM g GROUP BY 1")
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query(
    """WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, count(DISTINCT c_acctbal) AS k FROM customer GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(0 AS BIGINT) AS n_exact_copies, count(*) FILTER (n > 1) AS n_repeated_keys, count(*) FILTER (k > 1) AS n_conflicting_keys, count(*) FILTER (k > 1) AS n_conflicting_columns, max(n) AS largest_group FROM g"""
)
def duplicate_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_inspection(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], ["c_acctbal"])


@query("SELECT c_nationkey, c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dedup.top_k(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3), 4)


# ---------------------------------------------------------------- statistics


@query(
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(median(l_extendedprice), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
  round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt, round(var_samp(l_quantity), 6) AS var_quantity FROM lineitem GROUP BY ALL"""
)
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice")
    q = [F.round(F.percentile(v, F.lit(p)), 4).alias(n) for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*q, F.round(stats.skewness(v), 6).alias("skew"), F.round(stats.kurtosis(v), 6).alias("kurt"), F.round(F.var_samp("l_quantity"), 6).alias("var_quantity"))


@query(
    f"""WITH {_SMALL}, k AS (SELECT entity, count(*) AS n, regr_slope(r, m) AS b, regr_intercept(r, m) AS a, regr_sxx(r, m) AS sxx, avg(m) AS mx, regr_syy(r, m) - regr_slope(r, m) * regr_sxy(r, m) AS sse FROM s WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY 1)
SELECT entity, n, round(a, 6) AS alpha, round(b, 6) AS beta, round(a / sqrt(sse / (n - 2) * (1.0 / n + mx * mx / sxx)), 5) AS alpha_t, round(a * 12, 6) AS alpha_annual FROM k"""
)
def alpha_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.ols(_small_returns(spark, sf_dir), ["entity"], "r", "m")
    return df.select("entity", "n", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("alpha_t", 5).alias("alpha_t"), F.round("alpha_annual", 6).alias("alpha_annual"))


@query(
    f"""WITH {_PANEL}, g AS (SELECT target AS y, ret AS x1, ln(revenue) AS x2, month_id FROM tg WHERE split IS NOT NULL AND target IS NOT NULL AND ret IS NOT NULL),
m AS (SELECT month_id, count(*) AS n, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, corr(x1, y) AS r1 FROM g GROUP BY 1)
SELECT month_id, n, round((c1 * v2 - c2 * c) / (v1 * v2 - c * c), 6) AS b1, round((c2 * v1 - c1 * c) / (v1 * v2 - c * c), 6) AS b2, round(r1 * r1, 6) AS r2_1 FROM m WHERE n >= 4"""
)
def monthly_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = targets(spark, sf_dir).withColumn("size", x.log_positive(F.col("revenue")))
    return rounded(stats.ols2(df, ["month_id"], "target", "ret", "size").select("month_id", "n", "b1", "b2", "r2_1").filter("n >= 4"))


_LABELS = "lab AS (SELECT doc_id, CAST(quality AS INTEGER) AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"WITH {_LABELS}, c AS (SELECT * FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) b(predicted)) SELECT CAST(actual AS INTEGER) AS actual, CAST(predicted AS INTEGER) AS predicted, count(y) AS n FROM c LEFT JOIN lab ON y = actual AND p = predicted GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(_labels(spark, sf_dir), [], "y", "p", [0, 1])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").cast("int").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"))


@query(
    f"""WITH {_LABELS}, g AS (SELECT count(*) AS n, count(*) FILTER (y = 0 AND p = 0) AS h0, count(*) FILTER (y = 1 AND p = 1) AS h1, count(*) FILTER (y = 0) AS a0, count(*) FILTER (y = 1) AS a1, count(*) FILTER (p = 0) AS p0, count(*) FILTER (p = 1) AS p1 FROM lab)
SELECT n, round((h0 + h1) / n, 6) AS accuracy, round((h0 / a0 + h1 / a1) / 2, 6) AS balanced_accuracy, round((2 * h0 / (a0 + p0) + 2 * h1 / (a1 + p1)) / 2, 6) AS macro_f1,
  round(h0 / p0, 6) AS precision_0, round(h0 / a0, 6) AS recall_0, round(h1 / p1, 6) AS precision_1, round(h1 / a1, 6) AS recall_1 FROM g"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.classification_metrics(_labels(spark, sf_dir), [], "y", "p", [0, 1]))


@query(
    f"""WITH {_PANEL}, e AS (SELECT split, target AS y, -ret AS p FROM tg WHERE split IS NOT NULL AND target IS NOT NULL AND ret IS NOT NULL)
SELECT split, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS mse, round(avg(abs(p - y)), 6) AS mae, round(avg(CAST(sign(y) = sign(p) AS DOUBLE)), 6) AS direction, round(corr(y, p), 6) AS pearson FROM e GROUP BY 1"""
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.regression_metrics(targets(spark, sf_dir).withColumn("p", -F.col("ret")), ["split"], "target", "p"))


@query("SELECT 'customer' AS t, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_segments FROM customer")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.lit("customer").alias("t"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("c_mktsegment").alias("n_segments"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS kind, count({c}) AS nonmissing, count(DISTINCT {c}) AS n_unique, array_to_string(list_sort(list(DISTINCT {c}::VARCHAR))[1:5], ', ') AS examples FROM nation"""
        for c, kind in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))
    )
)
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_table(table(spark, sf_dir, "nation"))


@query(
    """SELECT 'priced' AS gate, round(avg(CAST(o_totalprice > 0 AS DOUBLE)), 6) AS value, CAST(0.95 AS DOUBLE) AS threshold, avg(CAST(o_totalprice > 0 AS DOUBLE)) >= 0.95 AS passed FROM orders
UNION ALL SELECT 'urgent', round(avg(CAST(o_orderpriority LIKE '1%' AS DOUBLE)), 6), 0.8, avg(CAST(o_orderpriority LIKE '1%' AS DOUBLE)) >= 0.8 FROM orders"""
)
def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.gate_table(table(spark, sf_dir, "orders"), {"priced": ("o_totalprice > 0", 0.95), "urgent": ("o_orderpriority like '1%'", 0.8)}))


@query(
    """SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '0') AS padded, lower(trim(regexp_replace(regexp_replace(p_brand || ' ' || p_type, '[-. ]', '_', 'g'), '[^\\p{L}\\p{N}_]', '', 'g'), '_')) AS slug,
  split_part(p_type, ' ', -1) AS last_word, CASE WHEN contains(lower(p_type), 'steel') THEN 'hard' WHEN contains(lower(p_type), 'tin') THEN 'soft' ELSE 'other' END AS family,
  round(CASE WHEN abs(p_size - 10) > 1e-9 THEN p_retailprice / (p_size - 10) END, 6) AS ratio, round(CASE WHEN p_size > 10 THEN ln(p_size - 10) END, 6) AS lg,
  round(CASE WHEN p_retailprice < 950 THEN 950 WHEN p_retailprice > 1500 THEN 1500 ELSE p_retailprice END, 4) AS clipped FROM part"""
)
def part_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", x.fixed_width(F.col("p_partkey"), 6).alias("padded"), x.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"), x.last_segment(F.col("p_type"), " ").alias("last_word"),
        x.first_match(F.col("p_type"), [("steel", "hard"), ("tin", "soft")], "other").alias("family"), F.round(x.safe_divide(F.col("p_retailprice"), (F.col("p_size") - 10).cast("double")), 6).alias("ratio"),
        F.round(x.log_positive((F.col("p_size") - 10).cast("double")), 6).alias("lg"), F.round(x.clip(F.col("p_retailprice"), 950, 1500), 4).alias("clipped"),
    )


@query(
    """WITH s AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey / 5.0 AS b, (c_custkey % 7) / 2.0 AS c FROM customer),
e AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM s)
SELECT c_custkey, round(ea / (ea + eb + ec), 6) AS p0, round(ec / (ea + eb + ec), 6) AS p2, round((ec - ea) / (ea + eb + ec), 6) AS score, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS best FROM e"""
)
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = [F.col("c_acctbal") / 1000, F.col("c_nationkey") / 5.0, (F.col("c_custkey") % 7) / 2.0]
    p = x.softmax(s)
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", p[0].alias("p0"), p[2].alias("p2"), x.classifier_score(p[0], p[2]).alias("score"), x.argmax(s).alias("best")))


# ---------------------------------------------------------------- portfolios


def _bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the reversal and size models with a tenth of the next return as what is earned."""
    return scores(spark, sf_dir).select("model", "split", "month_id", "entity", F.when(F.col("model") == "size", F.col("score") / 1e6).otherwise(F.col("score")).alias("score"), (F.col("target") / 10).alias("ret"))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of the fifty specifications of each score and split, made once for all that a query does with them."""
    df = _bets(spark, sf_dir)
    return cut_lineage(portfolio.grid_returns(df, portfolio.strategy_grid(spark), df.select("model", "split", "month_id").distinct()))


_BETS = _PANEL + ", bets AS (SELECT model, split, month_id, entity, CASE WHEN model = 'size' THEN score / 1e6 ELSE score END AS score, target / 10 AS ret FROM sc)"

_GRID = """rules(rule, lt, st) AS (VALUES ('long_only', 1.0::DOUBLE, 0.0::DOUBLE), ('long_short', 1.0, 1.0), ('gross_normalized_long_short', 0.5, 0.5), ('long_short_130_30', 1.3, 0.3)),
gates AS (SELECT 'none' AS gate, q, 0.0::DOUBLE AS t FROM (VALUES (0.1::DOUBLE), (0.2)) a(q) UNION ALL SELECT 'sign', q, 0.0 FROM (VALUES (0.1::DOUBLE), (0.2)) a(q)
  UNION ALL SELECT 'absolute', q, t FROM (VALUES (0.1::DOUBLE), (0.2)) a(q), (VALUES (0.0::DOUBLE), (0.005), (0.01), (0.02)) b(t) UNION ALL SELECT 'zscore', 0.0, t FROM (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) b(t)),
grid AS (SELECT rule || '|' || gate || '|' || printf('%g', q) || '|' || printf('%g', t) AS spec, * FROM rules, gates WHERE st > 0 OR gate = 'none')"""

_WEIGHTS = (
    _BETS
    + ", "
    + _GRID
    + """, rn AS (SELECT *, row_number() OVER (w ORDER BY score, entity) / count(*) OVER w AS pct, count(*) OVER w AS n, (score - avg(score) OVER w) / stddev_samp(score) OVER w AS z FROM bets WHERE score IS NOT NULL WINDOW w AS (PARTITION BY model, split, month_id)),
lg AS (SELECT spec, model, split, month_id, entity, ret, lt, st, CASE WHEN (CASE WHEN gate = 'zscore' THEN z >= t ELSE pct >= 1 - q END) AND (CASE gate WHEN 'sign' THEN score > 0 WHEN 'absolute' THEN score > t ELSE true END) THEN 1
  WHEN (CASE WHEN gate = 'zscore' THEN z <= -t ELSE pct <= q END) AND (CASE gate WHEN 'sign' THEN score < 0 WHEN 'absolute' THEN -score > t ELSE true END) AND st > 0 THEN -1 END AS leg FROM rn, grid WHERE n >= 10),
wt AS (SELECT spec, model, split, month_id, entity, coalesce(ret, 0) AS r, CASE leg WHEN 1 THEN lt ELSE -st END / count(*) OVER (PARTITION BY spec, model, split, month_id, leg) AS w FROM lg WHERE leg IS NOT NULL)"""
)

_RETURNS = (
    _WEIGHTS
    + """, mo AS (SELECT model, split, month_id, row_number() OVER (PARTITION BY model, split ORDER BY month_id) AS idx FROM (SELECT DISTINCT model, split, month_id FROM bets)),
wi AS (SELECT wt.*, idx FROM wt JOIN mo USING (model, split, month_id)), gr AS (SELECT spec, model, split, idx, sum(w * r) AS g FROM wi GROUP BY ALL),
tr AS (SELECT spec, model, split, idx, entity, w, 0 AS b, w * r AS pnl FROM wi UNION ALL SELECT spec, model, split, idx + 1, entity, 0, CASE WHEN 1 + g > 0 THEN w * (1 + r) / (1 + g) ELSE w END, 0 FROM wi JOIN gr USING (spec, model, split, idx)),
nt AS (SELECT spec, model, split, idx, entity, sum(w) AS w, sum(b) AS b, sum(pnl) AS pnl FROM tr GROUP BY ALL),
ag AS (SELECT spec, model, split, idx, sum(pnl) AS gross_return, sum(abs(w - b)) AS turnover, sum(abs(w)) AS gross_exposure, sum(w) AS net_exposure, count(*) FILTER (w > 0) AS n_long, count(*) FILTER (w < 0) AS n_short FROM nt GROUP BY ALL),
mr AS (SELECT s.spec, s.model, s.split, month_id, coalesce(gross_return, 0) AS gross_return, coalesce(turnover, 0) AS turnover, coalesce(turnover, 0) * 0.0025 AS trading_cost, coalesce(gross_return, 0) - coalesce(turnover, 0) * 0.0025 AS net_return,
  coalesce(gross_exposure, 0) AS gross_exposure, coalesce(net_exposure, 0) AS net_exposure, coalesce(n_long, 0) AS n_long, coalesce(n_short, 0) AS n_short,
  CASE WHEN mo.idx = 1 THEN 'initial_abs_weight' WHEN 1 + coalesce(g, 0) > 0 THEN 'drift_adjusted' ELSE 'non_drift_fallback' END AS turnover_method
  FROM (SELECT DISTINCT spec, model, split FROM wt) s JOIN mo USING (model, split) LEFT JOIN ag USING (spec, model, split, idx) LEFT JOIN gr ON gr.spec = s.spec AND gr.model = s.model AND gr.split = s.split AND gr.idx = mo.idx - 1)"""
)


@query(f"WITH {_WEIGHTS} SELECT spec, model, split, month_id, count(*) AS n, round(sum(w), 6) + 0.0 AS net, round(sum(abs(w)), 6) AS gross FROM wt GROUP BY ALL")
def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = portfolio.weights(_bets(spark, sf_dir), portfolio.strategy_grid(spark))
    return held.groupBy("spec", "model", "split", "month_id").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("w"), 6) + 0.0).alias("net"), F.round(F.sum(F.abs("w")), 6).alias("gross"))


@query(
    f"""WITH {_RETURNS} SELECT spec, model, split, month_id, round(gross_return, 6) AS gross_return, round(turnover, 6) AS turnover, round(trading_cost, 6) AS trading_cost, round(net_return, 6) AS net_return,
  round(gross_exposure, 6) AS gross_exposure, n_long, n_short, turnover_method FROM mr"""
)
def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_monthly(spark, sf_dir).drop("net_exposure"))


@query(
    f"""WITH {_RETURNS}, w AS (SELECT *, product(1 + net_return) OVER (PARTITION BY spec, model, split ORDER BY month_id) AS v FROM mr), d AS (SELECT *, v / max(v) OVER (PARTITION BY spec, model, split ORDER BY month_id) - 1 AS dd FROM w)
SELECT spec, model, split, count(*) AS n_months, round(avg(net_return), 6) AS mean_return, round(product(1 + net_return) - 1, 5) AS total_return, round(stddev_samp(net_return) * sqrt(12), 6) AS annual_vol,
  round(avg(net_return) / stddev_samp(net_return) * sqrt(12), 5) AS sharpe_mean, round(min(dd), 6) AS max_drawdown, round(avg(CAST(net_return > 0 AS DOUBLE)), 6) AS hit_rate FROM d GROUP BY ALL"""
)
def portfolio_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = performance.performance(_monthly(spark, sf_dir), ["spec", "model", "split"])
    five = [F.round(c, 5).alias(c) for c in ("total_return", "sharpe_mean")]
    return df.select("spec", "model", "split", "n_months", *five, *[F.round(c, 6).alias(c) for c in ("mean_return", "annual_vol", "max_drawdown", "hit_rate")])


@query(
    f"""WITH {_RETURNS} SELECT spec, model, split, round(CASE WHEN avg(turnover) > 0 THEN CASE WHEN avg(gross_return) > 0 THEN 10000 * avg(gross_return) / avg(turnover) ELSE 0 END END, 4) AS break_even_bps FROM mr GROUP BY ALL"""
)
def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(performance.break_even_simple(_monthly(spark, sf_dir), ["spec", "model", "split"]), 4)


@query(
    f"""WITH RECURSIVE mr AS (WITH {_RETURNS} SELECT * FROM mr), l AS (SELECT spec, model, split, list(gross_return ORDER BY month_id) AS g, list(turnover ORDER BY month_id) AS t FROM mr GROUP BY ALL),
w(spec, model, split, g, t, lo, hi, k) AS (SELECT spec, model, split, g, t, 0.0::DOUBLE, 0.0005::DOUBLE, 0 FROM l WHERE list_product(list_transform(g, lambda x: 1 + x)) > 1
  UNION ALL SELECT spec, model, split, g, t, CASE WHEN k >= 100 AND up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN k < 100 AND up THEN hi * 2 WHEN k < 100 THEN hi WHEN up THEN hi ELSE (lo + hi) / 2 END,
    CASE WHEN k < 100 AND NOT up THEN 100 ELSE k + 1 END
  FROM (SELECT *, list_min(list_transform(range(1, len(g) + 1), lambda i: 1 + g[i] - c * t[i])) > 0 AND list_product(list_transform(range(1, len(g) + 1), lambda i: 1 + g[i] - c * t[i])) > 1 AS up
    FROM (SELECT *, CASE WHEN k < 100 THEN hi ELSE (lo + hi) / 2 END AS c FROM w)) WHERE k < 160 AND (k >= 100 OR hi <= 5))
SELECT l.spec, l.model, l.split, round(CASE WHEN list_product(list_transform(l.g, lambda x: 1 + x)) > 1 THEN (lo + hi) / 2 * 10000 ELSE 0 END, 4) AS break_even_cumulative_bps FROM l LEFT JOIN (SELECT * FROM w WHERE k = 160) e USING (spec, model, split)"""
)
def break_even_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(performance.break_even_cumulative(_monthly(spark, sf_dir), ["spec", "model", "split"]), 4)


@query(
    f"""WITH {_BETS}, ok AS (SELECT * FROM bets WHERE score IS NOT NULL AND ret IS NOT NULL),
b AS (SELECT *, CAST(greatest(1, ((row_number() OVER (w ORDER BY score, entity) - 1) * 5 + count(*) OVER w - 2) // greatest(count(*) OVER w - 1, 1)) AS INTEGER) AS q, count(*) OVER w AS n FROM ok WINDOW w AS (PARTITION BY model, split, month_id))
SELECT model, split, month_id, 'Q' || q AS portfolio, round(avg(ret), 6) AS ret, count(*) AS n FROM b WHERE n >= 5 GROUP BY ALL
UNION ALL SELECT model, split, month_id, 'Q5-Q1', round(avg(ret) FILTER (q = 5) - avg(ret) FILTER (q = 1), 6), count(*) FILTER (q IN (1, 5)) FROM b WHERE n >= 5 GROUP BY ALL"""
)
def quantile_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.quantile_portfolios(_bets(spark, sf_dir)))


@query(
    f"""WITH {_BETS}, ok AS (SELECT * FROM bets WHERE score IS NOT NULL AND ret IS NOT NULL),
x AS (SELECT *, row_number() OVER (w ORDER BY score, entity) AS u, row_number() OVER (w ORDER BY score DESC, entity) AS d, greatest(1, floor(count(*) OVER w * 0.2)) AS k FROM ok WINDOW w AS (PARTITION BY model, split, month_id)),
l AS (SELECT *, CASE WHEN d <= k THEN 1 WHEN u <= k THEN -1 END AS leg FROM x), f AS (SELECT *, count(*) FILTER (leg = -1) OVER (PARTITION BY model, split, month_id) AS s FROM l WHERE leg IS NOT NULL),
wt AS (SELECT model, split, month_id, entity, ret AS r, leg / count(*) OVER (PARTITION BY model, split, month_id, leg) AS w FROM f WHERE s > 0),
wi AS (SELECT *, dense_rank() OVER (PARTITION BY model, split ORDER BY month_id) AS idx FROM wt), gr AS (SELECT model, split, idx, any_value(month_id) AS month_id, sum(w * r) AS g FROM wi GROUP BY model, split, idx),
tr AS (SELECT model, split, idx, entity, w, 0 AS b FROM wi UNION ALL SELECT model, split, idx + 1, entity, 0, CASE WHEN 1 + g > 0 THEN w * (1 + r) / (1 + g) ELSE w END FROM wi JOIN gr USING (model, split, idx)),
nt AS (SELECT model, split, idx, entity, sum(w) AS w, sum(b) AS b FROM tr GROUP BY ALL), tu AS (SELECT model, split, idx, sum(abs(w - b)) AS turnover, count(*) FILTER (w > 0) AS n_long, count(*) FILTER (w < 0) AS n_short FROM nt GROUP BY ALL)
SELECT model, split, month_id, round(g, 6) AS gross_return, round(turnover, 6) AS turnover, n_long, n_short FROM gr JOIN tu USING (model, split, idx)"""
)
def baseline_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.baseline_returns(_bets(spark, sf_dir), 0.2, True))


_OVERLAY = (
    f"mr AS (WITH {_RETURNS} SELECT * FROM mr)"  # inside, since DuckDB takes every UNION ALL of WITH RECURSIVE for a recursion
    + """, om AS (SELECT spec, model, split, month_id, gross_return AS g, turnover AS t, gross_exposure AS e, row_number() OVER s AS idx, lag(net_return) OVER s AS b1, lag(net_return, 2) OVER s AS b0
  FROM mr WINDOW s AS (PARTITION BY spec, model, split ORDER BY month_id)),
ov AS (SELECT *, (1 + b0) * (1 + b1) - 1 AS b2, CASE WHEN count(b1) OVER q = 4 THEN stddev_samp(b1) OVER q * sqrt(12) END AS rv FROM om WINDOW q AS (PARTITION BY spec, model, split ORDER BY month_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
oc AS (SELECT *, CASE WHEN count(rv) OVER q >= 4 THEN median(rv) OVER q END AS m36, CASE WHEN count(rv) OVER z >= 4 THEN median(rv) OVER z END AS mall FROM ov
  WINDOW q AS (PARTITION BY spec, model, split ORDER BY month_id ROWS BETWEEN 35 PRECEDING AND CURRENT ROW), z AS (PARTITION BY spec, model, split ORDER BY month_id)),
oi AS (SELECT *, CASE WHEN coalesce(m36, mall) < 0.03 THEN 0.03 WHEN coalesce(m36, mall) > 1 THEN 1 ELSE coalesce(m36, mall) END AS nv FROM oc),
fold(spec, model, split, vt, idx, month_id, l_dd, l, state, dd, net, turn, wealth, peak, trough, age, recovered, d1, d2, d3, e) AS (
  SELECT DISTINCT spec, model, split, v.vt, 0::BIGINT, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0, 0, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE
  FROM oi, (VALUES (false), (true)) v(vt)
  UNION ALL SELECT spec, model, split, vt, idx, month_id, l_dd, l, state, dd, net, turn, w2, CASE WHEN w2 >= peak THEN w2 ELSE peak END, CASE WHEN w2 >= peak OR w2 < trough THEN w2 ELSE trough END, CASE WHEN w2 >= peak THEN 0 ELSE age + 1 END,
    CASE WHEN w2 >= peak OR w2 < trough THEN 0 WHEN w2 > trough * 1.01 THEN recovered + 1 ELSE recovered END, dd, d1, d2, e FROM (
  SELECT *, wealth * (1 + net) AS w2 FROM (SELECT *, l * g - turn * 0.0025 AS net FROM (
  SELECT *, CASE WHEN before IS NULL THEN l * e ELSE l * t + abs(l - before) * e_before END AS turn FROM (
  SELECT *, least(l_dd, CASE WHEN vt AND rv > 0 THEN coalesce(least(nv * multiple / rv, 1), 1) ELSE 1 END) AS l FROM (
  SELECT *, concat_ws('_', band, CASE WHEN two THEN 'reentry_2m_gt_2pct' WHEN one THEN 'reentry_1m_positive' END) AS state,
    CASE WHEN two THEN 1 WHEN one THEN greatest(exposure, 0.75) ELSE exposure END AS l_dd, CASE WHEN two THEN 1.5 WHEN one THEN 1.25 ELSE usual END AS multiple FROM (
  SELECT *, CASE band WHEN 'new_high' THEN 1.0 WHEN 'shock_drawdown' THEN 0.5 WHEN 'grinding_drawdown' THEN 0.5 WHEN 'stale_recovery' THEN 0.75 WHEN 'recovery' THEN 0.75 WHEN 'deep_drawdown_not_recovering' THEN 0.65 ELSE 0.85 END::DOUBLE AS exposure,
    CASE band WHEN 'shallow_drawdown' THEN 1.10 WHEN 'recovery' THEN 1.25 WHEN 'stale_recovery' THEN 1.05 WHEN 'deep_drawdown_not_recovering' THEN 0.90 WHEN 'shock_drawdown' THEN 0.75 WHEN 'grinding_drawdown' THEN 0.75 END::DOUBLE AS usual FROM (
  SELECT *, coalesce(b2 > 0.02, false) AS two, coalesce(b1 > 0, false) AS one, CASE WHEN NOT dd < 0 THEN 'new_high' WHEN speed <= -0.10 OR coalesce(b1 <= -0.10, false) THEN 'shock_drawdown'
    WHEN age >= 3 AND (coalesce(dd - d3 <= -0.05, false) OR (NOT speed > 0 AND coalesce(b2 < 0, false))) THEN 'grinding_drawdown'
    WHEN wealth > trough * 1.01 AND speed > 0 AND recovered >= 3 AND dd < -0.05 AND NOT coalesce(b2 > 0.02, false) THEN 'stale_recovery' WHEN wealth > trough * 1.01 AND speed > 0 THEN 'recovery'
    WHEN dd <= -0.25 THEN 'deep_drawdown_not_recovering' ELSE 'shallow_drawdown' END AS band FROM (
  SELECT f.spec, f.model, f.split, f.vt, o.idx, o.month_id, o.g, o.t, o.e, o.b1, o.b2, o.rv, o.nv, f.wealth, f.peak, f.trough, f.age, f.recovered, f.d1, f.d2, f.d3, f.l AS before, f.e AS e_before,
    f.wealth / f.peak - 1 AS dd, f.wealth / f.peak - 1 - coalesce(f.d1, 0) AS speed FROM fold f JOIN oi o ON o.spec = f.spec AND o.model = f.model AND o.split = f.split AND o.idx = f.idx + 1)))))))))"""
)


@query(
    f"""WITH RECURSIVE {_OVERLAY} SELECT spec, model, split, month_id, round(l_dd, 6) AS lambda_dd, round(l, 6) AS lambda_t, state, round(dd, 6) AS drawdown_before, round(net, 6) AS overlay_net_return, round(turn, 6) AS overlay_turnover,
  round(wealth / peak - 1, 6) AS drawdown_after, CASE WHEN vt THEN 'dd_speed_phase_vol_target' ELSE 'dd_speed_phase_control' END AS method FROM fold WHERE idx > 0"""
)
def drawdown_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlays.overlays(_monthly(spark, sf_dir), ["spec", "model", "split"]))


_MEASURES = """{w} AS (SELECT spec, model, split, month_id, r, product(1 + r) OVER (PARTITION BY spec, model, split ORDER BY month_id) AS v FROM {of}),
{p} AS (SELECT spec, model, split, count(*) AS n_months, CASE WHEN product(1 + r) > 0 THEN power(product(1 + r), 12.0 / count(*)) - 1 END AS annual_return, stddev_samp(r) * sqrt(12) AS annual_vol, min(v / h - 1) AS max_drawdown,
  CASE WHEN stddev_samp(r) > 0 THEN avg(r) / (stddev_samp(r) / sqrt(count(*))) END AS t FROM (SELECT *, max(v) OVER (PARTITION BY spec, model, split ORDER BY month_id) AS h FROM {w}) GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {_OVERLAY}, x1 AS (SELECT spec, model, split, month_id, net_return AS r FROM mr), x2 AS (SELECT spec, model, split, month_id, net AS r FROM fold WHERE idx > 0 AND NOT vt),
{_MEASURES.format(w="w1", p="p1", of="x1")}, {_MEASURES.format(w="w2", p="p2", of="x2")},
ch AS (SELECT model, split, p2.annual_return - p1.annual_return AS a, p2.annual_vol - p1.annual_vol AS b, p2.max_drawdown - p1.max_drawdown AS c FROM p1 JOIN p2 USING (spec, model, split))
SELECT model, split, count(*) AS n, {", ".join(f"round(avg({c}), 5) AS mean_{m}, round(median({c}), 5) AS median_{m}, round(avg(CAST({c} > 0 AS DOUBLE)), 5) AS share_up_{m}" for c, m in zip("abc", ("annual_return", "annual_vol", "max_drawdown")))}
FROM (SELECT model, split, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c FROM ch) GROUP BY ALL"""
)
def overlay_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, keys, measures = _monthly(spark, sf_dir), ["spec", "model", "split"], ["annual_return", "annual_vol", "max_drawdown"]
    changed = overlays.overlay(df, keys, False).withColumnRenamed("overlay_net_return", "net_return")
    deltas = overlays.overlay_changes(performance.performance(df, keys), performance.performance(changed, keys), keys, measures)
    deltas = deltas.withColumns({f"delta_{m}": F.round(f"delta_{m}", 9) for m in measures})  # noise of sums in another order is no change
    return rounded(overlays.average_changes(deltas, ["model", "split"], measures), 5)


@query(
    f"""WITH {_RETURNS}, x1 AS (SELECT spec, model, split, month_id, net_return AS r FROM mr), {_MEASURES.format(w="w1", p="p1", of="x1")},
nm AS (SELECT *, model || '/' || spec AS id, CASE WHEN annual_vol > 0 THEN round(annual_return / annual_vol, 9) END AS sharpe, coalesce(t > 1.96 AND max_drawdown > -0.4, false) AS passes FROM p1),
pre AS (SELECT *, row_number() OVER (ORDER BY passes DESC, sharpe DESC NULLS LAST, round(annual_return, 9) DESC NULLS LAST, id) AS rk FROM nm WHERE split = 'validation'),
rep AS (SELECT id FROM pre QUALIFY row_number() OVER (PARTITION BY model ORDER BY passes DESC, rk) = 1),
pick AS (SELECT id, CASE WHEN id IN (SELECT id FROM pre WHERE rk <= 20) THEN 'top' ELSE 'representative' END AS role FROM (SELECT id FROM pre WHERE rk <= 20 UNION SELECT id FROM rep))
SELECT pick.id, role, n_months, round(annual_return, 5) AS annual_return, round(max_drawdown, 5) AS max_drawdown FROM pick LEFT JOIN (SELECT * FROM nm WHERE split = 'test') e ON e.id = pick.id"""
)
def selected_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best specifications on validation that pass the filters, the best of each model, and their results on test."""
    perf = performance.performance(_monthly(spark, sf_dir), ["spec", "model", "split"])
    named = perf.withColumn("id", F.concat_ws("/", "model", "spec"))
    passes = (F.col("t") > 1.96) & (F.col("max_drawdown") > -0.4)
    pre = performance.preselect(named.filter("split = 'validation'"), [F.round("sharpe_geometric", 9).desc_nulls_last(), F.round("annual_return", 9).desc_nulls_last()], passes, "id")
    picks = [("top", pre.filter("validation_rank <= 20")), ("representative", performance.representative(pre, "model"))]
    return rounded(performance.compact_choice(picks, "id").join(named.filter("split = 'test'").select("id", "n_months", "annual_return", "max_drawdown"), "id", "left"), 5)


# ---------------------------------------------------------------- models, samples, streams


@query()
def ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timeseries.return_features(targets(spark, sf_dir))
    used = ["ret_lag1", "ret_lag2", "mom_6m", "vol_12m"]
    name, model, _ = fit_grid(df, used, "target", {f"ridge_{a:g}": ridge(a, "target") for a in (0.1, 1.0, 10.0, 100.0)})
    return model.transform(df.filter("split = 'test'")).select("entity", "month_id", F.lit(name).alias("model"), "score", "target")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7|' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def sampled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, seed=7)


@query("SELECT time_bucket(INTERVAL '30 days', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate on the whole table at once; a batch has no late rows."""
    df = windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return df.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# ---------------------------------------------------------------- further operators


@query(
    f"""WITH {_BETS}, ok AS (SELECT * FROM bets WHERE score IS NOT NULL AND ret IS NOT NULL),
x AS (SELECT *, row_number() OVER (w ORDER BY score, entity) AS u, row_number() OVER (w ORDER BY score DESC, entity) AS d, greatest(1, floor(count(*) OVER w * 0.1)) AS k FROM ok WINDOW w AS (PARTITION BY model, split, month_id)),
l AS (SELECT *, CASE WHEN d <= k THEN 1 WHEN u <= k THEN -1 END AS leg FROM x)
SELECT model, split, month_id, CAST(leg AS INTEGER) AS leg, count(*) AS n, round(avg(ret), 6) AS ret FROM l WHERE leg IS NOT NULL GROUP BY ALL"""
)
def extreme_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = portfolio.extreme_buckets(_bets(spark, sf_dir), 0.1)
    return rounded(legs.groupBy("model", "split", "month_id", "leg").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("ret")))


@query(
    f"""WITH {_RETURNS} SELECT spec, model, split, c.cost_bps, round(avg(gross_return - c.cost_bps / 10000 * turnover), 6) AS mean_net
FROM mr, (VALUES (0.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (100.0)) c(cost_bps) GROUP BY ALL"""
)
def cost_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.expand_costs(_monthly(spark, sf_dir)).groupBy("spec", "model", "split", "cost_bps").agg(F.avg("net_return").alias("mean_net")))


@query(
    f"""WITH {_PANEL}, c AS (SELECT CASE WHEN ret < -0.2 THEN 0 WHEN ret > 0.2 THEN 2 WHEN ret IS NOT NULL THEN 1 END AS label, target, split FROM tg)
SELECT CAST(label AS INTEGER) AS label, round(avg(target), 6) AS mean_target, count(target) AS n FROM c WHERE split = 'train' AND label IS NOT NULL GROUP BY 1"""
)
def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("ret") < -0.2, 0).when(F.col("ret") > 0.2, 2).when(F.col("ret").isNotNull(), 1)
    return rounded(stats.class_means(targets(spark, sf_dir).withColumn("label", label), "label", "target", F.col("split") == "train"))


@query(
    f"""WITH {_PANEL}, m AS (SELECT median(-ret) AS r FROM tg WHERE split = 'train'), k AS (SELECT median(revenue) AS v FROM tg WHERE split = 'train' AND n_lines > 5)
SELECT entity, month_id, round(coalesce(-ret, r), 6) AS score_reversal, round(coalesce(CASE WHEN n_lines > 5 THEN revenue END, v), 6) AS score_momentum FROM tg, m, k WHERE split IS NOT NULL"""
)
def naive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = portfolio.naive_scores(targets(spark, sf_dir), F.when(F.col("n_lines") > 5, F.col("revenue")), F.col("ret"), F.col("split") == "train")
    return rounded(df.select("entity", "month_id", "score_reversal", "score_momentum"))


@query(f"WITH {_PANEL} SELECT m.month_id, round(b.market_ret, 6) AS benchmark_return FROM (SELECT DISTINCT month_id FROM panel) m LEFT JOIN mk b ON b.month_id = m.month_id + 1")
def benchmark_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    market = p.select("month_id", F.col("market_ret").alias("benchmark_return")).distinct()
    return rounded(portfolio.benchmark_aligned(p.select("month_id").distinct(), market))


@query(
    f"""WITH {_SMALL}, q AS (SELECT *, (1 + lag(r) OVER w) * (1 + r) - 1 AS two, CASE WHEN count(r) OVER z >= 3 THEN avg(r) OVER z END AS smooth FROM s
  WINDOW w AS (PARTITION BY entity ORDER BY month_id), z AS (PARTITION BY entity ORDER BY month_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT entity, month_id, round(two, 6) AS trailing_2m, round(smooth, 6) AS smooth_12m FROM q"""
)
def trailing_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = timeseries.by("entity")
    return rounded(_small_returns(spark, sf_dir).select("entity", "month_id", timeseries.trailing_compound(F.col("r"), 2, w).alias("trailing_2m"), timeseries.rolling(F.col("r"), "mean", 12, w, 3).alias("smooth_12m")))


@query(
    f"""WITH {_PANEL}, {_IC}, a AS (SELECT model, split, avg(rank_ic) AS mean_ic, count(*) AS n_months FROM ic GROUP BY ALL)
SELECT split AS family, model, n_months, round(mean_ic, 6) AS mean_ic, CAST(row_number() OVER (PARTITION BY split ORDER BY mean_ic DESC NULLS LAST, model) AS INTEGER) AS place FROM a QUALIFY place <= 3"""
)
def family_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = rank_ic.monthly_rank_ic(scores(spark, sf_dir)).groupBy(F.col("split").alias("family"), "model").agg(F.avg("rank_ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_months"))
    return rounded(rank_ic.best_of_family(ic, ["mean_ic", "n_months"]))


@query("SELECT 'p_name' AS \"column\", count(*) AS n_text, 0.0::DOUBLE AS parse_rate, false AS candidate FROM part UNION ALL SELECT 'p_size', count(*), 1.0, true FROM part UNION ALL SELECT 'p_retailprice', count(*), 1.0, true FROM part")
def parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.parse_rates(table(spark, sf_dir, "part"), ["p_name", "p_size", "p_retailprice"])


@query(
    f"""WITH {_PANEL} SELECT CAST((month_id - 1) // 12 AS INTEGER) AS year, count(*) AS n_rows, count(ret) AS n_ret, round(count(ret) * 100.0 / count(*), 2) AS pct_ret, count(DISTINCT entity) AS n_entities,
  min(month_id) AS first_month, max(month_id) AS last_month FROM panel GROUP BY 1"""
)
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy(F.floor((F.col("month_id") - 1) / 12).cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("ret").alias("n_ret"), F.round(F.count("ret") * 100.0 / F.count(F.lit(1)), 2).alias("pct_ret"), F.count_distinct("entity").alias("n_entities"),
        F.min("month_id").alias("first_month"), F.max("month_id").alias("last_month"),
    )


@query(
    f"""WITH {_PANEL}, q AS (SELECT split, count(*) AS n_split FROM tg WHERE split IS NOT NULL GROUP BY 1)
SELECT split, CASE WHEN target IS NULL THEN 'none' WHEN target > 0 THEN 'up' ELSE 'down' END AS label, count(*) AS n, round(count(*) * 100.0 / any_value(n_split), 4) AS pct FROM tg JOIN q USING (split) GROUP BY ALL"""
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("target").isNull(), "none").when(F.col("target") > 0, "up").otherwise("down").alias("label")
    counts = targets(spark, sf_dir).groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("split")), 4))


@query(
    f"""WITH {_LINKS}, c AS (SELECT o_orderkey, o_orderdate, max(CASE WHEN gvkey IS NULL THEN 0 ELSE 1 END) AS hit FROM orders LEFT JOIN links ON permno = o_custkey AND CAST(o_orderdate AS DATE) BETWEEN linkdt AND linkenddt GROUP BY 1, 2)
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_rows, CAST(sum(hit) AS BIGINT) AS n_matched, round(sum(hit) * 100.0 / count(*), 2) AS pct_matched FROM c GROUP BY 1"""
)
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("permno"), F.to_date("o_orderdate").alias("date"))
    linked = joins.interval_link(rows, _links(spark, sf_dir), "o_orderkey", "permno", "date", "linkdt", "linkenddt", joins.link_order(), ["gvkey"])
    return linked.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("gvkey").alias("n_matched"), F.round(F.count("gvkey") * 100.0 / F.count(F.lit(1)), 2).alias("pct_matched"))


@query(
    f"""WITH {_PANEL}, {_FACTORS}, p AS (SELECT month_id, "R" FROM wide WHERE month_id % 5 <> 0)
SELECT entity, panel.month_id, round("R", 6) AS factor FROM panel LEFT JOIN p ON p.month_id = panel.month_id WHERE entity <= 3"""
)
def month_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A many-to-one month lookup; months that the factor table lacks are null."""
    f = _factors(spark, sf_dir).filter("month_id % 5 <> 0").select("month_id", F.col("R").alias("factor"))
    return rounded(quality.checked_join(panel(spark, sf_dir).filter("entity <= 3"), f, ["month_id"]).select("entity", "month_id", "factor"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL BY NAME SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def widened_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query(
    f"""WITH {_PANEL}, f AS (SELECT entity, min(month_id) FILTER (ret IS NOT NULL) AS first FROM panel WHERE entity <= 3 GROUP BY 1)
SELECT p.entity, p.month_id, p.month_id - first AS step, round(ret, 6) AS ret FROM panel p JOIN f USING (entity) WHERE p.month_id BETWEEN first - 8 AND first + 4"""
)
def manual_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows around the first return of three entities."""
    df = panel(spark, sf_dir).filter("entity <= 3").withColumn("first", F.min(F.when(F.col("ret").isNotNull(), F.col("month_id"))).over(Window.partitionBy("entity")))
    return rounded(df.filter("month_id between first - 8 and first + 4").select("entity", "month_id", (F.col("month_id") - F.col("first")).alias("step"), "ret"))


FLAGSHIP = rank_ic_summary

from panelyard import more_queries  # noqa: E402, F401  registers its queries beside these
from panelyard import source_queries  # noqa: E402, F401
