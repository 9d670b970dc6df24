"""Window features of an entity's months. Lags count calendar months: a gap in the months gives null."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelyard.functions.scalars import clip, log1p_return


def by(entity: str | list[str], month: str = "month_id") -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else entity
    return Window.partitionBy(*keys).orderBy(month)


def shifted(value: Column, k: int, w: WindowSpec, month: str = "month_id") -> Column:
    """value k months before (k > 0) or after (k < 0), null unless the row there is exactly that month."""
    return F.when(F.lag(month, k).over(w) == F.col(month) - k, F.lag(value, k).over(w))


def _full(value: Column, w: WindowSpec, n: int | None, least: int | None = None) -> tuple[WindowSpec, Column]:
    frame = w.rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)
    return frame, F.count(value).over(frame) >= (n if least is None else least)


def rolling(value: Column, how: str, n: int | None, w: WindowSpec, least: int | None = None) -> Column:
    """sum, mean, std (ddof 1), min or max of the last n rows; null with fewer than least (default n) values.

    n None: of all rows so far, with a least given. Medians: with_medians().
    """
    frame, enough = _full(value, w, n, least)
    made = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[how](value).over(frame)
    return F.when(enough, made)


def running_medians(values: np.ndarray, n: int | None, least: int) -> np.ndarray:
    """Median of the last n values (None: of all so far) at each place; NaN are no values, and so is the result below least.

    The values of the frame are held in order: one is put in and one taken out at each place.
    """
    held: list[float] = []
    out = np.full(len(values), np.nan)
    for i, v in enumerate(values.tolist()):
        if v == v:
            insort(held, v)
        if n is not None and i >= n and (gone := float(values[i - n])) == gone:
            held.pop(bisect_left(held, gone))
        if len(held) >= least:
            k = len(held) // 2
            out[i] = held[k] if len(held) % 2 else (held[k - 1] + held[k]) / 2
    return out


def with_medians(df: DataFrame, value: str, keys: list[str], month: str, windows: dict[str, tuple[int | None, int]]) -> DataFrame:
    """df with a column for each window (rows, least values): the running median of value along the months of the keys.

    rows None: all rows so far. One ordered pass per series and window; nulls are no values.
    """
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in windows]])

    def run(series: pa.Table) -> pa.Table:
        series = series.take(pc.sort_indices(series, sort_keys=[(month, "ascending")]))
        v = series.column(value).cast(pa.float64()).to_numpy()
        for name, (n, least) in windows.items():
            series = series.append_column(name, pa.array(running_medians(v, n, least), from_pandas=True))
        return series

    return df.groupBy(*keys).applyInArrow(run, schema)


def momentum(logs: Column, lag: int, n: int, w: WindowSpec, month: str = "month_id") -> Column:
    """Compounded return of n months that end lag months ago, from logs = log(1 + return); the n months must be whole."""
    ends = w.rowsBetween(1 - n - lag, -lag)
    whole = (F.count(logs).over(ends) == n) & (F.lag(month, n + lag - 1).over(w) == F.col(month) - (n + lag - 1))
    return F.when(whole, F.expm1(F.sum(logs).over(ends)))


def return_features(panel: DataFrame, entity: str = "entity", month: str = "month_id", ret: str = "ret", market: str = "market_ret") -> DataFrame:
    """Lags 1, 2, 3, 6 of the return, momentum 6 and 12-1, volatility 12 and 24, beta 24, and the lagged market return."""
    w = by(entity, month)
    r = F.col(ret)
    df = panel.withColumns({"__l": log1p_return(r), "__lag": shifted(r, 1, w, month), "__mlag": shifted(F.col(market), 1, w, month)})
    lag, both = F.col("__lag"), F.when(F.col("__mlag").isNotNull(), F.col("__lag"))
    pair = F.when(F.col("__lag").isNotNull(), F.col("__mlag"))
    sums = {k: rolling(v, "sum", 24, w) for k, v in {"x": both, "y": pair, "xy": both * pair, "yy": pair * pair}.items()}
    variance = sums["yy"] - sums["y"] * sums["y"] / 24
    made = {f"ret_lag{k}": shifted(r, k, w, month) for k in (1, 2, 3, 6)} | {
        "mom_6m": momentum(F.col("__l"), 1, 6, w, month),
        "mom_12_1": momentum(F.col("__l"), 2, 11, w, month),
        "vol_12m": rolling(lag, "std", 12, w),
        "vol_24m": rolling(lag, "std", 24, w),
        "beta_24m": F.when(variance > 1e-12, (sums["xy"] - sums["x"] * sums["y"] / 24) / F.when(variance > 1e-12, variance)),
        "market_lag1": F.col("__mlag"),
    }
    return df.withColumns(made).drop("__l", "__lag", "__mlag")


def with_drawdown(df: DataFrame, ret: str, entity: list[str], month: str, from_one: bool, out: str = "drawdown") -> DataFrame:
    """df with wealth / highest wealth so far - 1 after each row; null returns count as 0.

    from_one: the starting wealth of 1 counts as a high (variant B), else the first month's wealth is the first high (A).
    """
    upto = by(entity, month).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__wealth", F.product(1 + F.coalesce(ret, F.lit(0.0))).over(upto))
    high = F.max("__wealth").over(upto)
    return df.withColumn(out, F.col("__wealth") / (F.greatest(F.lit(1.0), high) if from_one else high) - 1).drop("__wealth")


def market_series(panel: DataFrame, value: str, month: str = "month_id") -> DataFrame:
    """month, market_ret: growth of the total. One row a month, so one window without keys is bounded by the calendar."""
    total = panel.groupBy(month).agg(F.sum(value).alias("__total"))
    w = Window.orderBy(month)
    return total.select(month, (F.col("__total") / shifted(F.col("__total"), 1, w, month) - 1).alias("market_ret"))


def month_end_returns(daily: DataFrame, entity: str, date: str, price: str) -> DataFrame:
    """Last price of each month and its growth on the month before (null after a gap)."""
    month = (F.year(date) * 12 + F.month(date)).cast("int")
    last = daily.groupBy(entity, month.alias("month_id")).agg(F.max_by(price, date).alias("price"))
    return last.withColumn("ret", F.col("price") / shifted(F.col("price"), 1, by(entity)) - 1)


def factor_features(wide: DataFrame, factors: list[str], month: str = "month_id") -> DataFrame:
    """For each factor return lag 1, 12-month compounded return and 12-month volatility, all up to the month before."""
    w = Window.orderBy(month)  # one row a month
    made = {}
    for f in factors:
        made[f"{f}_lag1"] = shifted(F.col(f), 1, w, month)
        made[f"{f}_mom12"] = momentum(log1p_return(F.col(f)), 1, 12, w, month)
        back = w.rowsBetween(-12, -1)
        whole = (F.count(f).over(back) == 12) & (F.lag(month, 12).over(w) == F.col(month) - 12)
        made[f"{f}_vol12"] = F.when(whole, F.stddev_samp(f).over(back))
    return wide.withColumns(made)


def trailing_compound(ret: Column, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(ret).over(w.rowsBetween(1 - n, 0)) == n, F.product(1 + ret).over(w.rowsBetween(1 - n, 0)) - 1)


def volatility_state(df: DataFrame, ret: str, keys: list[str], month: str, lookback: int = 4, normal: int = 36, low: float = 0.03, high: float = 1.0) -> DataFrame:
    """realized_vol: annualised, of the lookback months before; normal_vol: its rolling median, within [low, high]."""
    w = by(keys, month)
    df = df.withColumn("__r", F.lag(F.coalesce(ret, F.lit(0.0)), 1).over(w))
    df = df.withColumn("realized_vol", rolling(F.col("__r"), "std", lookback, w) * F.sqrt(F.lit(12.0)))
    df = with_medians(df.drop("__r"), "realized_vol", keys, month, {"__recent": (normal, lookback), "__all": (None, lookback)})
    return df.withColumn("normal_vol", clip(F.coalesce("__recent", "__all"), low, high)).drop("__recent", "__all")


def history(panel: DataFrame, entity: str, values: list[str], steps: int = 24, month: str = "month_id", fill: float | None = 0.0) -> DataFrame:
    """Per row the last ``steps`` calendar months as an array, oldest first, with a mask (true where no month is). An entity has a month once.

    fill: for missing values of months that are there; None keeps them null. Masked steps are 0.

    Array lengths are fixed, so rows stay small; months are placed by their distance, so gaps are masked places.
    """
    w = by(entity, month)
    # the months wanted are among the last steps rows, since an entity's months differ
    row = F.struct(F.col(month).alias("m"), *values)
    seen = F.array_compact(F.array(*[F.lag(row, k).over(w) for k in range(steps - 1, 0, -1)], row))
    # where a month stands among those seen: 0 if it does not
    place = F.transform(F.sequence(F.col(month) - (steps - 1), F.col(month)), lambda m: F.array_position("__months", m).cast("int"))
    made = panel.withColumn("__seen", seen).withColumn("__months", F.transform("__seen", lambda x: x["m"])).withColumn("__place", place)
    value = lambda i, v: F.when(i > 0, F.coalesce(F.get(F.col("__seen"), i - 1)[v], F.lit(fill).cast("double"))).otherwise(0.0).alias(v)
    return made.withColumns({
        "steps": F.transform("__place", lambda i: F.struct(*[value(i, v) for v in values])),
        "masked": F.transform("__place", lambda i: i == 0),
    }).drop("__seen", "__months", "__place")


def calendar_years(df: DataFrame, keys: list[str], ret: str, month: str = "month_id") -> DataFrame:
    """Per year: compounded return and the deepest drawdown within the year, from a start of 1."""
    year = F.floor((F.col(month) - 1) / 12).cast("int")
    inside = with_drawdown(df.withColumn("year", year), ret, [*keys, "year"], month, from_one=True)
    return inside.groupBy(*keys, "year").agg((F.product(1 + F.coalesce(ret, F.lit(0.0))) - 1).alias("annual_return"), F.min("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("n_months"))

