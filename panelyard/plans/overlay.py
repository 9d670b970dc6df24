"""Drawdown overlay: a monthly exposure from drawdown state, speed and re-entry signals; its own wealth feeds back.

The state of a month depends on the months before through the overlay's wealth, so a series is followed in order, one
month after the other. A series is one specification's months, for all methods at once; series are spread over the
cluster. The same steps serve a whole table and a stream, whose state they carry.
"""

from __future__ import annotations

import json
import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: Fixed values of the state table: exposure by state and multiple of normal volatility by state or re-entry.
EXPOSURE = {"new_high": 1.0, "shock_drawdown": 0.5, "grinding_drawdown": 0.5, "stale_recovery": 0.75, "recovery": 0.75, "deep_drawdown_not_recovering": 0.65, "shallow_drawdown": 0.85}
MULTIPLE = {"shallow_drawdown": 1.10, "recovery": 1.25, "stale_recovery": 1.05, "deep_drawdown_not_recovering": 0.90, "shock_drawdown": 0.75, "grinding_drawdown": 0.75}
ONE_MONTH, TWO_MONTHS = "reentry_1m_positive", "reentry_2m_gt_2pct"

#: method -> whether the volatility target limits the exposure too.
METHODS = {"dd_speed_phase_control": False, "dd_speed_phase_vol_target": True}

ROW = [
    ("month_id", IntegerType()), ("lambda_dd", DoubleType()), ("lambda_t", DoubleType()), ("state", StringType()), ("drawdown_before", DoubleType()),
    ("overlay_net_return", DoubleType()), ("overlay_turnover", DoubleType()), ("drawdown_after", DoubleType()), ("method", StringType()),
]


@dataclass
class Path:
    """The overlay's wealth by one method, as months before left it. drawdowns: of the last three months, latest first."""

    wealth: float = 1.0
    peak: float = 1.0
    trough: float = 1.0
    age: int = 0
    recovered: int = 0
    drawdowns: list[float] = field(default_factory=list)
    exposure: float | None = None
    gross: float = 0.0

    def band(self, drawdown: float, last: float | None, last_two: float | None, threshold: float) -> str:
        speed = drawdown - (self.drawdowns[0] if self.drawdowns else 0.0)
        slow = drawdown - self.drawdowns[2] if len(self.drawdowns) == 3 else None
        recovering = self.wealth > self.trough * 1.01 and speed > 0
        if not drawdown < 0:
            return "new_high"
        if speed <= -0.10 or (last is not None and last <= -0.10):
            return "shock_drawdown"
        if self.age >= 3 and ((slow is not None and slow <= -0.05) or (speed <= 0 and last_two is not None and last_two < 0)):
            return "grinding_drawdown"
        if recovering:
            strong = last_two is not None and last_two > threshold
            return "stale_recovery" if self.recovered >= 3 and drawdown < -0.05 and not strong else "recovery"
        return "deep_drawdown_not_recovering" if drawdown <= -0.25 else "shallow_drawdown"

    def moved(self, net: float, drawdown: float, exposure: float, gross: float) -> None:
        wealth = self.wealth * (1 + net)
        high, deeper = wealth >= self.peak, wealth < self.trough
        if high or deeper:
            self.recovered = 0
        elif wealth > self.trough * 1.01:
            self.recovered += 1
        self.age = 0 if high else self.age + 1
        self.peak = wealth if high else self.peak
        self.trough = wealth if high or deeper else self.trough
        self.wealth, self.exposure, self.gross = wealth, exposure, gross
        self.drawdowns = [drawdown, *self.drawdowns][:3]


@dataclass
class Series:
    """What the months so far leave to the next one; to_json() and from_json() carry it over a stream's batches."""

    paths: dict[str, Path]
    month: int | None = None
    returns: list[float] = field(default_factory=list)  # the last four
    recent: list[float | None] = field(default_factory=list)  # realised volatilities of the last 36 months
    ordered: list[float] = field(default_factory=list)  # of all months, ascending

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Series:
        d = json.loads(text)
        return Series(**{**d, "paths": {k: Path(**v) for k, v in d["paths"].items()}})

    def volatilities(self) -> tuple[float | None, float | None]:
        """(realised, normal): annualised deviation of the last four returns, and its median over 36 months, or over all, within bounds."""
        realised = None
        if len(self.returns) == 4:
            mean = sum(self.returns) / 4
            realised = math.sqrt(sum((r - mean) ** 2 for r in self.returns) / 3) * math.sqrt(12)
            insort(self.ordered, realised)
        self.recent = [*self.recent, realised][-36:]
        known = sorted(v for v in self.recent if v is not None)
        known = known if len(known) >= 4 else self.ordered
        if len(known) < 4:
            return realised, None
        k = len(known) // 2
        middle = known[k] if len(known) % 2 else (known[k - 1] + known[k]) / 2
        return realised, min(max(middle, 0.03), 1.0)

    def follow(self, month: dict, cost: float, threshold: float) -> Iterator[tuple]:
        """The rows (ROW) of the next month: month_id, gross_return, net_return, turnover, gross_exposure; nulls count as 0, an exposure as 1."""
        value = lambda name, other=0.0: other if month[name] is None or month[name] != month[name] else month[name]
        last = self.returns[-1] if self.returns else None
        last_two = (1 + self.returns[-2]) * (1 + last) - 1 if len(self.returns) > 1 else None
        realised, normal = self.volatilities()
        two, one = last_two is not None and last_two > threshold, last is not None and last > 0
        for method, path in self.paths.items():
            drawdown = path.wealth / path.peak - 1
            state = path.band(drawdown, last, last_two, threshold)
            by_state, multiple = EXPOSURE[state], MULTIPLE.get(state)
            if two:
                by_state, multiple, state = 1.0, 1.5, f"{state}_{TWO_MONTHS}"
            elif one:
                by_state, multiple, state = max(by_state, 0.75), 1.25, f"{state}_{ONE_MONTH}"
            exposure = by_state
            if METHODS[method] and realised and normal is not None and multiple is not None:
                exposure = min(exposure, normal * multiple / realised, 1.0)
            gross = value("gross_exposure", 1.0)
            turnover = exposure * gross if path.exposure is None else exposure * value("turnover") + abs(exposure - path.exposure) * path.gross
            net = exposure * value("gross_return") - turnover * cost
            path.moved(net, drawdown, exposure, gross)
            yield month["month_id"], by_state, exposure, state, drawdown, net, turnover, path.wealth / path.peak - 1, method
        self.month = month["month_id"]
        self.returns = [*self.returns, value("net_return")][-4:]


MONTH = ["month_id", "gross_return", "net_return", "turnover", "gross_exposure"]


def row_schema(df: DataFrame, keys: list[str]) -> StructType:
    return StructType([*df.select(*keys).schema.fields, *[StructField(name, kind) for name, kind in ROW]])


def overlays(monthly: DataFrame, keys: list[str], methods: tuple[str, ...] = tuple(METHODS), cost_bps: float = 25.0, threshold: float = 0.02) -> DataFrame:
    """keys, method and, for each month, exposure, state, drawdowns, overlay net return and turnover.

    monthly: keys and the columns MONTH. Signals use months before only: the last net return, and the last two
    compounded. With a volatility target the exposure is also at most the state's multiple of normal volatility over
    the realised one. One exchange and one ordered pass for all methods.
    """

    def run(series: pa.Table) -> pa.Table:
        key = series.slice(0, 1).select(keys)
        series = series.take(pc.sort_indices(series, sort_keys=[("month_id", "ascending")])).select(MONTH)
        carried = Series({m: Path() for m in methods})
        rows = [r for month in series.to_pylist() for r in carried.follow(month, cost_bps / 10_000, threshold)]
        out = key.take(pa.array([0] * len(rows)))
        for i, (name, kind) in enumerate(ROW):
            out = out.append_column(name, pa.array([r[i] for r in rows], {IntegerType: pa.int32(), DoubleType: pa.float64(), StringType: pa.string()}[type(kind)]))
        return out

    rows = monthly.select(*keys, F.col("month_id").cast("int").alias("month_id"), *[F.col(c).cast("double").alias(c) for c in MONTH[1:]])
    return rows.groupBy(*keys).applyInArrow(run, row_schema(rows, keys))


def overlay(monthly: DataFrame, keys: list[str], vol_target: bool, cost_bps: float = 25.0, threshold: float = 0.02) -> DataFrame:
    """overlays() of one method."""
    method = next(m for m, v in METHODS.items() if v == vol_target)
    return overlays(monthly, keys, (method,), cost_bps, threshold).drop("method")


def overlay_changes(base: DataFrame, changed: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Per keys: each measure of the base, of the overlay, and the difference."""
    both = base.select(*keys, *[F.col(m).alias(f"base_{m}") for m in measures]).join(changed.select(*keys, *[F.col(m).alias(f"overlay_{m}") for m in measures]), keys)
    return both.withColumns({f"delta_{m}": F.col(f"overlay_{m}") - F.col(f"base_{m}") for m in measures})


def average_changes(deltas: DataFrame, groups: list[str], measures: list[str]) -> DataFrame:
    return deltas.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *[f(f"delta_{m}").alias(f"{n}_{m}") for m in measures for n, f in (("mean", F.avg), ("median", F.median))], *[F.avg((F.col(f"delta_{m}") > 0).cast("double")).alias(f"share_up_{m}") for m in measures])
