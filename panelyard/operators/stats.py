"""Aggregate statistics as column expressions or one-pass group aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(a: str, b: str) -> Column:
    """Pearson over rows with both values; null without spread (Spark's corr raises there in ANSI mode)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    size = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.when(size > 0, F.covar_pop(a, b) / F.when(size > 0, size))


def t_stat(x: Column) -> Column:
    """mean / (sd / sqrt(n)); null with fewer than two values or no spread."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / (F.when(sd > 0, sd) / F.sqrt(F.count(x))))


def compound(r: Column) -> Column:
    return F.product(1 + r) - 1


def annualised(r: Column, months: int = 12) -> Column:
    """Geometric; null if the wealth is not positive."""
    wealth = F.product(1 + r)
    return F.when(wealth > 0, F.pow(F.when(wealth > 0, wealth), months / F.count(r)) - 1)


def volatility(r: Column, months: int = 12) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(months)))


def sharpe_geometric(r: Column) -> Column:
    v = volatility(r)
    return F.when(v > 0, annualised(r) / F.when(v > 0, v))


def sharpe_mean(r: Column) -> Column:
    sd = F.stddev_samp(r)
    return F.when(sd > 0, F.avg(r) / F.when(sd > 0, sd) * F.sqrt(F.lit(12.0)))


def downside_deviation(r: Column) -> Column:
    low = F.least(r, F.lit(0.0))
    return F.sqrt(F.avg(low * low))


def sortino(r: Column) -> Column:
    d = downside_deviation(r) * F.sqrt(F.lit(12.0))
    return F.when(d > 0, annualised(r) / F.when(d > 0, d))


def skewness(x: Column) -> Column:
    """Bias-corrected G1; null below three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n >= 3, n - 2))


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess G2; null below four values."""
    n = F.count(x).cast("double")
    d = F.when(n >= 4, (n - 2) * (n - 3))
    return F.when(n >= 4, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / d)


def ols(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Per group y = a + b x: n, alpha, beta, alpha_t, alpha_annual (alpha * 12); nulls below three points or without spread in x."""
    ok = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    m = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy")
    )
    fine = (F.col("n") >= 3) & (F.col("vx") > 0)
    beta = F.col("cxy") / F.when(F.col("vx") > 0, F.col("vx"))
    m = m.withColumn("beta", F.when(fine, beta)).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    n = F.col("n")
    s2 = n * (F.col("vy") - F.col("beta") * F.col("cxy")) / F.when(n > 2, n - 2)
    se = F.sqrt(F.greatest(s2, F.lit(0.0)) * (1 / n + F.col("mx") ** 2 / (n * F.when(F.col("vx") > 0, F.col("vx")))))
    return m.select(*keys, "n", "alpha", "beta", F.when(se > 0, F.col("alpha") / F.when(se > 0, se)).alias("alpha_t"), (F.col("alpha") * 12).alias("alpha_annual"))


def beta_alpha(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Per group n, beta, alpha (mean of y less beta times mean of x) and correlation by covariances, from two pairs on."""
    ok = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    spread = F.var_samp(x)
    m = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(spread > 0, F.covar_samp(x, y) / F.when(spread > 0, spread)).alias("beta"), F.avg(x).alias("__x"), F.avg(y).alias("__y"), correlation(y, x).alias("corr"))
    return m.select(*keys, "n", "beta", (F.col("__y") - F.col("beta") * F.col("__x")).alias("alpha"), "corr")


def ols2(df: DataFrame, keys: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Per group y = a + b1 x1 + b2 x2 from moments, with R2 of the single regressions; nulls if x1 and x2 are collinear."""
    ok = df.filter(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    m = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2"), F.covar_pop(x1, x2).alias("c12"), F.covar_pop(x1, y).alias("c1y"), F.covar_pop(x2, y).alias("c2y"),
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"), correlation(x1, y).alias("r1"), correlation(x2, y).alias("r2"),
    )
    det = F.col("v1") * F.col("v2") - F.col("c12") ** 2
    d = F.when((det > 1e-18) & (F.col("n") >= 4), det)
    b1 = (F.col("c1y") * F.col("v2") - F.col("c2y") * F.col("c12")) / d
    b2 = (F.col("c2y") * F.col("v1") - F.col("c1y") * F.col("c12")) / d
    return m.select(*keys, "n", b1.alias("b1"), b2.alias("b2"), (F.col("my") - b1 * F.col("m1") - b2 * F.col("m2")).alias("a"), (F.col("r1") ** 2).alias("r2_1"), (F.col("r2") ** 2).alias("r2_2"))


def regression_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("direction"), correlation(y, p).alias("pearson")
    )


def confusion(df: DataFrame, keys: list[str], y: str, p: str, classes: list[int]) -> DataFrame:
    """actual, predicted, n for every pair of classes, zeros included."""
    cells = [F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(f"__{a}_{b}") for a in classes for b in classes]
    wide = df.groupBy(*keys).agg(*cells)
    long = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"__{a}_{b}").alias("n")) for a in classes for b in classes])
    return wide.select(*keys, F.explode(long).alias("c")).select(*keys, "c.*")


def classification_metrics(df: DataFrame, keys: list[str], y: str, p: str, classes: list[int]) -> DataFrame:
    """accuracy, balanced_accuracy (mean recall of the classes present), macro_f1; precision and recall are 0 on empty."""
    hit = lambda k: F.count_if((F.col(y) == k) & (F.col(p) == k))
    agg = [F.count(F.lit(1)).alias("n")] + [c for k in classes for c in (hit(k).alias(f"h{k}"), F.count_if(F.col(y) == k).alias(f"a{k}"), F.count_if(F.col(p) == k).alias(f"p{k}"))]
    g = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(*agg)
    safe = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    f1 = [F.when(F.col(f"a{k}") + F.col(f"p{k}") > 0, 2 * F.col(f"h{k}") / F.when(F.col(f"a{k}") + F.col(f"p{k}") > 0, F.col(f"a{k}") + F.col(f"p{k}"))).otherwise(0.0) for k in classes]
    present = sum([(F.col(f"a{k}") > 0).cast("int") for k in classes[1:]], (F.col(f"a{classes[0]}") > 0).cast("int"))
    recalls = sum([safe(f"h{k}", f"a{k}") for k in classes[1:]], safe(f"h{classes[0]}", f"a{classes[0]}"))
    hits = sum([F.col(f"h{k}") for k in classes[1:]], F.col(f"h{classes[0]}"))
    return g.select(*keys, "n", (hits / F.col("n")).alias("accuracy"), (recalls / F.when(present > 0, present)).alias("balanced_accuracy"), (sum(f1[1:], f1[0]) / len(classes)).alias("macro_f1"),
                    *[x for k in classes for x in (safe(f"h{k}", f"p{k}").alias(f"precision_{k}"), safe(f"h{k}", f"a{k}").alias(f"recall_{k}"))])


def class_means(df: DataFrame, label: str, target: str, train: Column) -> DataFrame:
    return df.filter(train & F.col(label).isNotNull()).groupBy(label).agg(F.avg(target).alias("mean_target"), F.count(target).alias("n"))
