"""Monthly evaluation of scores: rank correlation with the target, top-bottom spread, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.stats import correlation, t_stat
from panelyard.operators.xsection import n_valid, rank_average, rank_first

KEYS = ["model", "split", "month_id"]


def monthly_rank_ic(scores: DataFrame, score: str = "score", target: str = "target", min_obs: int = 5, keep_null_months: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Spearman correlation per keys over rows with both values, as Pearson of average ranks.

    Months with fewer than min_obs rows or a constant side have no correlation; they are left out, or kept as null.
    """
    ok = scores.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    ranked = ok.withColumns({"__s": rank_average(score, keys), "__t": rank_average(target, keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), correlation("__s", "__t").alias("__c"), F.stddev_pop("__s").alias("__a"), F.stddev_pop("__t").alias("__b"))
    fine = (F.col("n_obs") >= min_obs) & (F.col("__a") > 0) & (F.col("__b") > 0)
    out = out.select(*keys, "n_obs", F.when(fine, F.col("__c")).alias("rank_ic"))
    return out if keep_null_months else out.filter("rank_ic is not null")


def monthly_spread(scores: DataFrame, score: str = "score", target: str = "target", tail: float = 0.2, min_obs: int = 5, keys: list[str] = KEYS, tie: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Mean target of rows with rank / n > 1 - tail less that of rank / n <= tail; months need both tails."""
    ok = scores.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    pct = F.col("__r") / F.col("__n")
    ranked = ok.withColumns({"__r": rank_first(score, keys, list(tie)), "__n": n_valid(score, keys)}).filter(F.col("__n") >= min_obs)
    top, bottom = F.avg(F.when(pct > 1 - tail, F.col(target))), F.avg(F.when(pct <= tail, F.col(target)))
    return ranked.groupBy(*keys).agg(top.alias("top"), bottom.alias("bottom"), (top - bottom).alias("spread")).filter("spread is not null")


def summary(ic: DataFrame, spread: DataFrame) -> DataFrame:
    """Per model and split: mean, t, hit rate and months of the rank IC, mean and t of the spread."""
    a = ic.groupBy("model", "split").agg(F.avg("rank_ic").alias("mean_ic"), t_stat(F.col("rank_ic")).alias("ic_t"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("ic_hit_rate"), F.count("rank_ic").alias("n_months"))
    b = spread.groupBy("model", "split").agg(F.avg("spread").alias("mean_spread"), t_stat(F.col("spread")).alias("spread_t"))
    return a.join(b, ["model", "split"], "left")


def best_of_family(report: DataFrame, metrics: list[str], family: str = "family", name: str = "model", order: str = "mean_ic", k: int = 3, digits: int = 6) -> DataFrame:
    """The k best models of each family after models with one signature (rounded metrics) are merged into the first by name."""
    rounded = report.withColumns({f"__{m}": F.round(m, digits) for m in metrics})
    first = Window.partitionBy(family, *[f"__{m}" for m in metrics]).orderBy(name)
    once = rounded.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", *[f"__{m}" for m in metrics])
    best = Window.partitionBy(family).orderBy(F.col(order).desc_nulls_last(), name)
    return once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def split_label(target_month: Column, bounds: dict[str, tuple[int, int]]) -> Column:
    """The split whose first and last month hold the target month; null outside all."""
    out = None
    for name, (first, last) in bounds.items():
        inside = (target_month >= first) & (target_month <= last)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out
