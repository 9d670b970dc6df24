"""Performance of monthly return series: risk summaries, break-even costs, selection of specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import stats
from panelyard.operators.timeseries import with_drawdown
from panelyard.plans.portfolio import benchmark_aligned


def performance(monthly: DataFrame, keys: list[str], ret: str = "net_return", month: str = "month_id", from_one: bool = False) -> DataFrame:
    """One row per keys: months, mean, total and annual return, volatility, Sharpe (both conventions), Sortino, drawdowns, Calmar, moments, hit rate."""
    r = F.col(ret)
    df = with_drawdown(monthly, ret, keys, month, from_one)
    worst = F.min("drawdown")
    return df.groupBy(*keys).agg(
        F.count(r).alias("n_months"), F.avg(r).alias("mean_return"), stats.compound(r).alias("total_return"), stats.annualised(r).alias("annual_return"), stats.volatility(r).alias("annual_vol"),
        stats.sharpe_geometric(r).alias("sharpe_geometric"), stats.sharpe_mean(r).alias("sharpe_mean"), stats.sortino(r).alias("sortino"), worst.alias("max_drawdown"), F.avg("drawdown").alias("mean_drawdown"),
        F.when(worst < 0, stats.annualised(r) / F.abs(F.when(worst < 0, worst))).alias("calmar"), stats.skewness(r).alias("skew"), stats.kurtosis(r).alias("kurt"), stats.t_stat(r).alias("t"),
        F.avg((r > 0).cast("double")).alias("hit_rate"), F.min(r).alias("worst_month"), F.max(r).alias("best_month"),
    )


def _sharpe_of_annual(r: Column) -> Column:
    v = stats.volatility(r)
    return F.when(v > 0, stats.annualised(r) / F.when(v > 0, v))


def spec_summary(monthly: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """Twenty-two measures of each specification's months.

    Net and gross returns, drawdowns of the net wealth, turnover and exposures, returns on a unit of gross exposure
    (months without any count as missing), numbers of names, and alpha and beta against the benchmark (month_id,
    benchmark_return) of the month after formation, over the months that have one.
    """
    net, gross = F.col("net_return"), F.col("gross_return")
    unit = F.when(F.col("gross_exposure") != 0, net / F.when(F.col("gross_exposure") != 0, F.col("gross_exposure")))
    own = with_drawdown(monthly, "net_return", keys, "month_id", from_one=False).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), stats.annualised(net).alias("net_annualized_return"), stats.volatility(net).alias("net_annualized_volatility"), _sharpe_of_annual(net).alias("net_sharpe"),
        stats.annualised(gross).alias("gross_annualized_return"), stats.volatility(gross).alias("gross_annualized_volatility"), _sharpe_of_annual(gross).alias("gross_sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("average_drawdown"), F.avg("turnover").alias("average_monthly_turnover"), F.avg("gross_exposure").alias("average_gross_exposure"),
        F.avg("net_exposure").alias("average_net_exposure"), stats.annualised(unit).alias("exposure_normalized_annualized_return"), _sharpe_of_annual(unit).alias("exposure_normalized_sharpe"),
        F.avg("n_long").alias("average_n_long"), F.avg("n_short").alias("average_n_short"), F.min("n_long").alias("min_n_long"), F.min("n_short").alias("min_n_short"),
    )
    line = stats.ols(benchmark_aligned(monthly, benchmark), keys, "net_return", "benchmark_return")
    line = line.select(*keys, F.col("alpha_annual").alias("annualized_alpha"), "beta", F.col("alpha_t").alias("alpha_tstat"), F.col("n").alias("alpha_beta_months"))
    return own.join(line, keys, "left").withColumn("alpha_beta_months", F.coalesce("alpha_beta_months", F.lit(0)))


def backtest_summary(monthly: DataFrame, benchmark: DataFrame, keys: list[str], ret: str = "net_return") -> DataFrame:
    """Nineteen measures of each backtest's months; Sharpe and Sortino ratios are of mean returns, the benchmark's month is the one after formation."""
    r = F.col(ret)
    worst, down = F.min("drawdown"), stats.downside_deviation(r)
    own = with_drawdown(monthly, ret, keys, "month_id", from_one=False).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), stats.compound(r).alias("cumulative_return"), stats.annualised(r).alias("annualized_return"), stats.volatility(r).alias("annualized_volatility"),
        stats.sharpe_mean(r).alias("sharpe_ratio"), F.when(down > 0, F.avg(r) / F.when(down > 0, down) * F.sqrt(F.lit(12.0))).alias("sortino_ratio"), worst.alias("max_drawdown"),
        F.when(worst < 0, stats.annualised(r) / F.abs(F.when(worst < 0, worst))).alias("calmar_ratio"), F.avg(r).alias("mean_monthly_return"), stats.t_stat(r).alias("monthly_return_tstat"),
        F.avg((r > 0).cast("double")).alias("hit_rate"), stats.skewness(r).alias("skewness"), stats.kurtosis(r).alias("excess_kurtosis"), F.avg("turnover").alias("average_turnover"),
        F.avg("n_long").alias("average_number_of_long_stocks"), F.avg("n_short").alias("average_number_of_short_stocks"),
    )
    line = stats.beta_alpha(benchmark_aligned(monthly, benchmark), keys, ret, "benchmark_return")
    return own.join(line.select(*keys, F.col("beta").alias("beta_to_benchmark"), (F.col("alpha") * 12).alias("annualized_alpha"), F.col("corr").alias("correlation")), keys, "left")


def break_even_simple(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Cost in basis points that takes the mean gross return: 0 if that is not positive, null without turnover."""
    g = monthly.groupBy(*keys).agg(F.avg("gross_return").alias("g"), F.avg("turnover").alias("t"))
    return g.select(*keys, F.when(F.col("t") > 0, F.when(F.col("g") > 0, 10_000 * F.col("g") / F.when(F.col("t") > 0, F.col("t"))).otherwise(0.0)).alias("break_even_bps"))


def break_even_cumulative(monthly: DataFrame, keys: list[str], steps: int = 60, highest: float = 5.0) -> DataFrame:
    """Cost in basis points at which the compounded net return is zero, by halving [0, bound] in every group at once.

    The bound doubles from 5 basis points until the wealth is below one, at most ``highest``; 0 if the gross wealth is
    not above one, null if no bound is enough. A group is its months, so it is folded as one list.
    """
    lists = monthly.groupBy(*keys).agg(F.collect_list(F.struct("gross_return", "turnover")).alias("m"))

    def grows(cost: Column) -> Column:
        wealth = lambda a, x: F.when((a > 0) & (1 + x["gross_return"] - cost * x["turnover"] > 0), a * (1 + x["gross_return"] - cost * x["turnover"])).otherwise(0.0)
        return F.aggregate("m", F.lit(1.0), wealth) > 1

    bounds = [0.0005 * 2**k for k in range(20) if 0.0005 * 2**k <= highest]
    high = F.array_min(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: ~grows(b)))
    start = F.struct(F.lit(0.0).alias("lo"), F.col("high").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(grows(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2 * 10_000)
    return lists.withColumn("high", high).select(*keys, F.when(~grows(F.lit(0.0)), 0.0).when(F.col("high").isNotNull(), found).alias("break_even_cumulative_bps"))


def preselect(summary: DataFrame, order: list[Column], passes: Column, id_col: str = "spec") -> DataFrame:
    """Specifications with pass and validation_rank: those that pass first, then by the order. Small: one row a specification."""
    ranked = summary.withColumn("passes", F.coalesce(passes, F.lit(False)))
    return ranked.withColumn("validation_rank", F.row_number().over(Window.orderBy(F.col("passes").desc(), *order, F.col(id_col))))


def representative(preselected: DataFrame, group: str) -> DataFrame:
    """Of each group the best specification that passes, else the best of all."""
    w = Window.partitionBy(group).orderBy(F.col("passes").desc(), "validation_rank")
    return preselected.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def compact_choice(picks: list[tuple[str, DataFrame]], id_col: str = "spec") -> DataFrame:
    """Ordered union of picks; a specification keeps its first role."""
    out = None
    for place, (role, df) in enumerate(picks):
        part = df.select(id_col, F.lit(role).alias("role"), F.lit(place).alias("__p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(id_col).agg(F.min_by("role", "__p").alias("role"))


def choose_specs(monthly: DataFrame, preselected: DataFrame | None = None, ids: tuple[str, ...] = (), top: int = 20, id_col: str = "spec") -> DataFrame:
    """Months of the specifications named by ids, else of the best ``top`` of preselected, else of all."""
    if ids:
        return monthly.filter(F.col(id_col).isin(*ids))
    if preselected is None:
        return monthly
    return monthly.join(preselected.filter(F.col("validation_rank") <= top).select(id_col), id_col, "left_semi")


def benchmark_alpha_beta(monthly: DataFrame, benchmark: DataFrame, keys: list[str], ret: str = "net_return") -> DataFrame:
    """n, beta, alpha and corr per keys against the benchmark (month_id, benchmark_return) of the month after formation."""
    return stats.beta_alpha(benchmark_aligned(monthly, benchmark), keys, ret, "benchmark_return")
