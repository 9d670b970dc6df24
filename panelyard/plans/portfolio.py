"""Portfolios from scores: weights for a grid of rules, returns, turnover with drift, baseline and quantile backtests.

Nothing here is recursive: weights drift from one month's targets, so a month needs the month before it only, and
all specifications of all models go through the same few shuffles on (spec, split, month).
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.operators.xsection import bucket, n_valid, rank_first
from panelyard.sources.writers import cut_lineage

#: rule -> total of the long and of the short leg
EXPOSURES = {"long_only": (1.0, 0.0), "long_short": (1.0, 1.0), "gross_normalized_long_short": (0.5, 0.5), "long_short_130_30": (1.3, 0.3)}


#: Rules that weights() takes at a time; the grid has fifty.
MOST_RULES = 1000


def strategy_grid(spark: SparkSession, fractions: tuple[float, ...] = (0.1, 0.2), thresholds: tuple[float, ...] = (0.0, 0.005, 0.01, 0.02), z: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """spec, rule, long_total, short_total, gate, q, threshold: the grid of rules and gates, a few dozen rows."""
    rows = []
    for rule, (long, short) in EXPOSURES.items():
        gates = [("none", q, 0.0) for q in fractions]
        if short:
            gates += [("sign", q, 0.0) for q in fractions] + [("absolute", q, t) for q, t in product(fractions, thresholds)] + [("zscore", 0.0, t) for t in z]
        rows += [(f"{rule}|{g}|{q:g}|{t:g}", rule, long, short, g, q, t) for g, q, t in gates]
    return spark.createDataFrame(rows, "spec string, rule string, long_total double, short_total double, gate string, q double, threshold double")


def scored(panel: DataFrame, score: str = "score", keys: tuple[str, ...] = ("model", "split", "month_id"), tie: tuple[str, ...] = ("entity",)) -> DataFrame:
    """panel with rank, n and z of the score per month, once for all specifications."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(score).over(w)
    return panel.withColumns({"__r": rank_first(score, list(keys), list(tie)), "__n": n_valid(score, list(keys)), "__z": F.when(sd > 0, (F.col(score) - F.avg(score).over(w)) / F.when(sd > 0, sd))})


def _few(grid: DataFrame) -> None:
    if grid.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: every row of the panel meets each of them, so take some at a time")


def _leg(s: Column, pct: Column, z: Column) -> Column:
    """1, -1 or null: the leg of a score with its rank's share and its z by the rule beside it."""
    high = F.when(F.col("gate") == "zscore", z >= F.col("threshold")).otherwise(pct >= 1 - F.col("q"))
    low = F.when(F.col("gate") == "zscore", z <= -F.col("threshold")).otherwise(pct <= F.col("q"))
    beyond = lambda x: F.when(F.col("gate") == "sign", x > 0).when(F.col("gate") == "absolute", x > F.col("threshold")).otherwise(F.lit(True))
    return F.when(F.coalesce(high & beyond(s), F.lit(False)), 1).when(F.coalesce(low & beyond(-s), F.lit(False)) & (F.col("short_total") > 0), -1)


def weights(panel: DataFrame, grid: DataFrame, score: str = "score", least: int = 10, keys: tuple[str, ...] = ("model", "split", "month_id"), entity: str = "entity") -> DataFrame:
    """Non-zero weights of every specification: spec, keys, entity, w, ret.

    Long: rank / n >= 1 - q, short: rank / n <= q, both inclusive; gate sign and absolute also ask for a score beyond
    0 or the threshold; gate zscore takes z beyond the threshold instead of the quantile. Equal weights within a leg;
    an empty leg is absent; a month with fewer than ``least`` scores has no weights.
    """
    _few(grid)
    df = scored(panel, score, keys).filter((F.col("__n") >= least) & F.col(score).isNotNull()).crossJoin(F.broadcast(grid))
    leg = _leg(F.col(score), F.col("__r") / F.col("__n"), F.col("__z"))
    legs = df.withColumn("leg", leg).filter("leg is not null")
    size = F.count(F.lit(1)).over(Window.partitionBy("spec", *keys, "leg"))
    w = F.when(F.col("leg") == 1, F.col("long_total") / size).otherwise(-F.col("short_total") / size)
    return legs.select("spec", *keys, entity, w.alias("w"), "ret")


def portfolio_returns(held: DataFrame, months: DataFrame, cost_bps: float = 25.0, keys: tuple[str, ...] = ("spec", "model", "split"), entity: str = "entity") -> DataFrame:
    """Monthly gross and net return, turnover, cost and exposures of every specification.

    months: model, split, month_id of all months; a month without weights is a row of zeros, its exit still trades.
    Turnover is sum |w| in the first month, else sum |w - w_prev (1 + r_prev) / (1 + gross_prev)|; undrifted if
    1 + gross_prev is not positive.
    """
    index = _numbered(months)
    r = F.coalesce("ret", F.lit(0.0))
    at = held.join(index, ["model", "split", "month_id"])
    at = at.withColumn("gross", F.sum(F.col("w") * r).over(Window.partitionBy(*keys, "idx")))
    moved = F.when(1 + F.col("gross") > 0, F.col("w") * (1 + r) / (1 + F.when(1 + F.col("gross") > 0, F.col("gross")))).otherwise(F.col("w"))
    # a weight takes part twice: in its month, and drifted in the trade of the month after
    none = F.lit(0.0)
    own = F.struct(F.col("idx"), F.col("w"), none.alias("before"), (F.col("w") * r).alias("pnl"))
    after = F.struct((F.col("idx") + 1).alias("idx"), none.alias("w"), moved.alias("before"), none.alias("pnl"))
    trades = at.select(*keys, entity, "last_idx", F.explode(F.array(own, after)).alias("t")).select(*keys, entity, "last_idx", "t.*").filter("idx <= last_idx")
    net = trades.groupBy(*keys, "idx", entity).agg(F.sum("w").alias("w"), F.sum("before").alias("before"), F.sum("pnl").alias("pnl"))
    monthly = net.groupBy(*keys, "idx").agg(
        F.sum("pnl").alias("gross_return"), F.sum(F.abs(F.col("w") - F.col("before"))).alias("turnover"), F.sum(F.abs("w")).alias("gross_exposure"), F.sum("w").alias("net_exposure"),
        F.count_if(F.col("w") > 0).alias("n_long"), F.count_if(F.col("w") < 0).alias("n_short"),
    )
    return _over_months(monthly, index, cost_bps, keys)


def _numbered(months: DataFrame) -> DataFrame:
    """months with idx, from 1, and last_idx."""
    order = Window.partitionBy("model", "split").orderBy("month_id")
    return months.withColumn("idx", F.row_number().over(order)).withColumn("last_idx", F.count(F.lit(1)).over(Window.partitionBy("model", "split")))


def _over_months(monthly: DataFrame, index: DataFrame, cost_bps: float, keys: tuple[str, ...]) -> DataFrame:
    """The rows of portfolio_returns() from the months in which a specification holds or trades something."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # a specification's months as one map, which is bounded by the calendar, laid over all months
    made = F.struct("gross_return", "turnover", "gross_exposure", "net_exposure", "n_long", "n_short")
    series = monthly.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("idx", made))).alias("__m"))
    out = series.join(index, ["model", "split"]).withColumns({"__x": F.try_element_at("__m", F.col("idx")), "__before": F.try_element_at("__m", F.col("idx") - 1)["gross_return"]})
    out = out.select(*keys, "month_id", "idx", "__before", "__x.*")
    cost = zero(F.col("turnover")) * cost_bps / 10_000
    method = F.when(F.col("idx") == 1, "initial_abs_weight").when(1 + zero(F.col("__before")) > 0, "drift_adjusted").otherwise("non_drift_fallback")
    return out.select(*keys, "month_id", zero(F.col("gross_return")).alias("gross_return"), zero(F.col("turnover")).alias("turnover"), cost.alias("trading_cost"), (zero(F.col("gross_return")) - cost).alias("net_return"),
                      zero(F.col("gross_exposure")).alias("gross_exposure"), zero(F.col("net_exposure")).alias("net_exposure"), F.coalesce("n_long", F.lit(0)).alias("n_long"), F.coalesce("n_short", F.lit(0)).alias("n_short"), method.alias("turnover_method"))


def grid_returns(panel: DataFrame, grid: DataFrame, months: DataFrame, cost_bps: float = 25.0, score: str = "score", least: int = 10, keys: tuple[str, ...] = ("model", "split"), entity: str = "entity") -> DataFrame:
    """portfolio_returns() of weights(): the same rows, for a panel that has an entity once a month.

    Rows meet the grid inside their tasks only, once for the size and return of each leg and once for the trades. What
    is shuffled are the panel's rows, with the month before beside each, and sums by specification and month.
    """
    _few(grid)
    index, named = _numbered(months), ("spec", *keys)
    ok = scored(panel, score, (*keys, "month_id")).filter((F.col("__n") >= least) & F.col(score).isNotNull())
    own = F.struct(F.col(score).alias("s"), (F.col("__r") / F.col("__n")).alias("pct"), F.col("__z").alias("z"), F.coalesce("ret", F.lit(0.0)).alias("r"))
    at = ok.join(F.broadcast(index), [*keys, "month_id"]).select(*keys, entity, "idx", "last_idx", own.alias("now"))  # index: a row a month
    w = Window.partitionBy(*keys, entity).orderBy("idx")
    at = at.withColumns({"before": F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag("now").over(w)), "next": F.lead("idx").over(w)})
    # an entity that is not in the month after is sold there
    here = F.struct("idx", "now", "before")
    gone = F.struct((F.col("idx") + 1).alias("idx"), F.when(F.lit(False), F.col("now")).alias("now"), F.col("now").alias("before"))
    sold = (F.col("idx") < F.col("last_idx")) & ~F.coalesce(F.col("next") == F.col("idx") + 1, F.lit(False))
    rows = cut_lineage(at.select(*keys, F.explode(F.when(sold, F.array(here, gone)).otherwise(F.array(here))).alias("t")).select(*keys, "t.*"))
    leg, long, short = _leg(F.col("s"), F.col("pct"), F.col("z")), F.col("leg") == 1, F.col("leg") == -1
    legs = rows.filter("now is not null").select(*keys, "idx", "now.*").crossJoin(F.broadcast(grid)).withColumn("leg", leg).filter("leg is not null")
    legs = legs.groupBy(*named, "idx").agg(F.count_if(long).alias("long"), F.count_if(short).alias("short"), F.sum(F.when(long, F.col("r"))).alias("r_long"), F.sum(F.when(short, F.col("r"))).alias("r_short"))
    rules = grid.select("spec", "gate", "q", "threshold", "long_total", "short_total")
    each = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.when(F.col(n) > 0, F.col(n)))
    legs = legs.join(F.broadcast(rules), "spec").withColumns({"up": each("long_total", "long"), "down": -each("short_total", "short")})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    size = lambda n, w: zero(F.col(n) * F.col(w))
    legs = legs.select(
        *named, "idx", "up", "down", (zero(F.col("up") * F.col("r_long")) + zero(F.col("down") * F.col("r_short"))).alias("gross_return"), (size("long", "up") - size("short", "down")).alias("gross_exposure"),
        (size("long", "up") + size("short", "down")).alias("net_exposure"), F.when(F.col("up") > 0, F.col("long")).otherwise(0).alias("n_long"), F.when(F.col("down") < 0, F.col("short")).otherwise(0).alias("n_short"),
    )
    # a specification's month with the legs of the month before: as many rows as there are months and rules
    legs = cut_lineage(legs)
    past = legs.select(*named, (F.col("idx") + 1).alias("idx"), F.col("up").alias("up0"), F.col("down").alias("down0"), F.col("gross_return").alias("gross0"))
    terms = legs.join(past, [*named, "idx"], "full").join(F.broadcast(rules), "spec")
    met = rows.join(F.broadcast(terms.select(*named, "idx", "up", "down", "up0", "down0", "gross0", "gate", "q", "threshold", "short_total")), [*keys, "idx"])
    of = lambda t, up, down: F.when(t == 1, F.col(up)).when(t == -1, F.col(down))
    w, held = (zero(of(_leg(F.col(f"{k}.s"), F.col(f"{k}.pct"), F.col(f"{k}.z")), up, down)) for k, up, down in (("now", "up", "down"), ("before", "up0", "down0")))
    drifts = 1 + F.col("gross0") > 0
    moved = F.when(drifts, held * (1 + F.col("before.r")) / (1 + F.when(drifts, F.col("gross0")))).otherwise(held)
    traded = met.groupBy(*named, "idx").agg(F.sum(F.abs(w - zero(moved))).alias("turnover"))
    return _over_months(traded.join(legs, [*named, "idx"], "left"), index, cost_bps, named)


def extreme_buckets(panel: DataFrame, fraction: float, score: str = "score", target: str = "ret", keys: tuple[str, ...] = ("model", "split", "month_id"), entity: str = "entity") -> DataFrame:
    """leg 1 and -1: max(1, floor(n * fraction)) rows of each end by (score, entity); a name at both ends is long only."""
    ok = panel.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    up, down = Window.partitionBy(*keys).orderBy(F.col(score), entity), Window.partitionBy(*keys).orderBy(F.col(score).desc(), entity)
    size = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) * fraction))
    leg = F.when(F.col("__d") <= F.col("__k"), 1).when(F.col("__u") <= F.col("__k"), -1)
    return ok.withColumns({"__u": F.row_number().over(up), "__d": F.row_number().over(down), "__k": size}).withColumn("leg", leg).filter("leg is not null").drop("__u", "__d", "__k")


def baseline_returns(panel: DataFrame, fraction: float, long_short: bool, keys: tuple[str, ...] = ("model", "split"), entity: str = "entity") -> DataFrame:
    """Equal-weight extreme portfolio: gross return (long mean, less short mean) and drift-adjusted turnover by month.

    Long-short months without a short side are left out and do not become anybody's month before.
    """
    legs = extreme_buckets(panel, fraction, keys=(*keys, "month_id"), entity=entity)
    if not long_short:
        legs = legs.filter("leg = 1")
    per_leg = Window.partitionBy(*keys, "month_id", "leg")
    held = legs.withColumn("w", F.col("leg") / F.count(F.lit(1)).over(per_leg)).withColumn("__short", F.count_if(F.col("leg") == -1).over(Window.partitionBy(*keys, "month_id")))
    if long_short:
        held = held.filter("__short > 0")
    held = held.select(*[F.col(k) for k in keys], "month_id", entity, "w", "ret").withColumn("spec", F.lit("baseline"))
    months = held.select("model", "split", "month_id").distinct()
    return portfolio_returns(held, months, 0.0, entity=entity).select(*keys, "month_id", "gross_return", "turnover", "n_long", "n_short")


def baseline_portfolios(panel: DataFrame, fractions: tuple[float, ...] = (0.1, 0.2), keys: tuple[str, ...] = ("model", "split"), entity: str = "entity") -> DataFrame:
    """baseline_returns() of long-only and long-short portfolios of every fraction, told apart by ``portfolio``."""
    made = [baseline_returns(panel, q, ls, keys, entity).withColumn("portfolio", F.lit(f"{'long_short' if ls else 'long_only'}_{q:g}")) for ls, q in product((False, True), fractions)]
    return reduce(DataFrame.unionByName, made)


def quantile_portfolios(panel: DataFrame, k: int = 5, score: str = "score", target: str = "ret", keys: tuple[str, ...] = ("model", "split", "month_id"), tie: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Equal-weight return of each of k score buckets a month, and of the highest less the lowest."""
    ok = panel.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    cut = ok.withColumn("bucket", bucket(rank_first(score, list(keys), list(tie)), n_valid(score, list(keys)), k)).filter("bucket is not null")
    per = cut.groupBy(*keys, F.concat(F.lit("Q"), F.col("bucket").cast("string")).alias("portfolio")).agg(F.avg(target).alias("ret"), F.count(F.lit(1)).alias("n"))
    diff = cut.groupBy(*keys).agg(
        (F.avg(F.when(F.col("bucket") == k, F.col(target))) - F.avg(F.when(F.col("bucket") == 1, F.col(target)))).alias("ret"), F.count_if(F.col("bucket").isin(1, k)).alias("n")
    )
    return per.unionByName(diff.select(*keys, F.lit(f"Q{k}-Q1").alias("portfolio"), "ret", "n"))


def benchmark_aligned(months: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A formation month gets the benchmark's return of the month after; months without one stay null (gate them)."""
    return months.join(benchmark.select((F.col("month_id") - 1).alias("month_id"), "benchmark_return"), "month_id", "left")


def naive_scores(panel: DataFrame, momentum: Column, last_return: Column, train: Column) -> DataFrame:
    """Momentum and reversal scores; missing ones take the median of the training rows."""
    made = panel.withColumns({"__m": momentum, "__r": -last_return})
    middle = made.filter(train).agg(F.median("__m").alias("__mm"), F.median("__r").alias("__rm"))
    return made.crossJoin(F.broadcast(middle)).withColumns({"score_momentum": F.coalesce("__m", "__mm"), "score_reversal": F.coalesce("__r", "__rm")}).drop("__m", "__r", "__mm", "__rm")
