"""Operations across the entities of one month."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import clip
from panelyard.operators import quantiles
from panelyard.operators.moments import moment_matrix


def rank_first(value: str, keys: list[str], tie: list[str]) -> Column:
    """1..n of the non-null values, ties by the tie columns; null for nulls."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last(), *tie)
    return F.when(F.col(value).isNotNull(), F.row_number().over(w))


def n_valid(value: str, keys: list[str]) -> Column:
    return F.count(value).over(Window.partitionBy(*keys))


def rank_average(value: str, keys: list[str]) -> Column:
    """Average rank of ties among the non-null values; null for nulls."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    same = Window.partitionBy(*keys, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def bucket(rank: Column, n: Column, k: int) -> Column:
    """Equal-frequency bucket 1..k of a rank 1..n, cut at the linear quantiles of the ranks; null if n < k or without a rank."""
    edge = F.floor(((rank - 1) * k + n - 2) / F.greatest(n - 1, F.lit(1)))
    return F.when((n >= k) & rank.isNotNull(), F.greatest(F.lit(1), edge)).cast("int")


def quantile_label(df: DataFrame, value: str, keys: list[str], tie: list[str], k: int = 5) -> DataFrame:
    """quintile (1..k) and label: 0 for the lowest bucket, 2 for the highest, 1 between."""
    df = df.withColumns({"__r": rank_first(value, keys, tie), "__n": n_valid(value, keys)})
    df = df.withColumn("quintile", bucket(F.col("__r"), F.col("__n"), k)).drop("__r", "__n")
    return df.withColumn("label", F.when(F.col("quintile") == 1, 0).when(F.col("quintile") == k, 2).when(F.col("quintile").isNotNull(), 1))


def zscore(value: str, keys: list[str], ddof: int = 1) -> Column:
    w = Window.partitionBy(*keys)
    sd = (F.stddev_samp if ddof else F.stddev_pop)(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd))


def _by_month(df: DataFrame, of_month: DataFrame, key: str) -> DataFrame:
    """df with the columns of of_month (one row a key); a null key is a key like others."""
    renamed = of_month.withColumnRenamed(key, "__key")
    return df.join(renamed, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def winsorise_impute(df: DataFrame, values: list[str], key: str, low: float = 0.01, high: float = 0.99, flags: list[str] = ()) -> DataFrame:
    """Clip to exact per-month quantiles, then fill nulls with the median of the clipped values.

    The quantiles of all columns and months are found together without sorting or gathering a month's values. Months
    without any value stay null. flags: columns that get a ``<name>_missing`` indicator of the nulls before.
    """
    s = quantiles.select(df, [key], values, [low, 0.5, high])
    q = s.quantiles([low, 0.5, high])
    floor, cap = q[:, :, 0], q[:, :, 2]
    # clipping keeps the order, so the middle values of what is clipped are the clipped middle values
    middle = (np.clip(s.lower[:, :, 1], floor, cap) + np.clip(s.upper[:, :, 1], floor, cap)) / 2
    number = lambda v: None if np.isnan(v) else float(v)
    rows = [(k, *[number(x[g, i]) for i in range(len(values)) for x in (floor, cap, middle)]) for g, (k,) in enumerate(s.groups)]
    kinds = df.select(key).schema
    for v in values:
        for name in ("lo", "hi", "mid"):
            kinds = kinds.add(f"__{name}_{v}", "double")
    df = df.withColumns({f"{v}_missing": F.col(v).isNull().cast("int") for v in flags})
    joined = _by_month(df, F.broadcast(df.sparkSession.createDataFrame(rows, kinds)), key)  # a row a month
    made = {v: F.coalesce(clip(F.col(v), F.col(f"__lo_{v}"), F.col(f"__hi_{v}")), F.col(f"__mid_{v}")) for v in values}
    return joined.withColumns(made).drop(*[f"__{name}_{v}" for v in values for name in ("lo", "hi", "mid")])


def missingness(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """feature, n_rows, n_missing, pct_missing (per keys); one pass, then unpivoted."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f).isNull()).alias(f"__{f}") for f in features])
    long = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"__{f}").alias("n_missing")) for f in features])
    return counts.select(*keys, "n_rows", F.explode(long).alias("x")).select(*keys, "x.feature", "n_rows", "x.n_missing", (F.col("x.n_missing") * 100.0 / F.col("n_rows")).alias("pct_missing"))


def monthly_coverage(df: DataFrame, features: list[str], month: str = "month_id") -> DataFrame:
    """month, n_rows, and by feature the rows with a value; one pass, one row a month."""
    return df.groupBy(month).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(f).alias(f"{f}_n") for f in features])


def redundant(df: DataFrame, features: list[str], threshold: float = 0.999999999) -> list[str]:
    """Later columns whose absolute correlation with an earlier kept one reaches the threshold, in column order."""
    return [features[i] for i in moment_matrix(df, features).redundant(range(len(features)), threshold)]


def fixed_pivot(df: DataFrame, keys: list[str], name: str, value: str, names: list[str], agg=F.first) -> DataFrame:
    """Long to wide with the column names given, so that no job is needed to find them."""
    return df.groupBy(*keys).pivot(name, names).agg(agg(value))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "model", value: str = "score") -> DataFrame:
    return df.unpivot(keys, columns, name, value)
