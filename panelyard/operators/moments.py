"""Moments of all pairs of columns in one pass: counts, means, variances and covariances over the rows that have both."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUMS = ("n", "x", "xx", "xy")


@dataclass
class Moments:
    """rows: of the data. low, high: by column. n, x, xx, xy: by pair (i, j) over the rows with both: how many, and the
    sums of i, of its square and of the product, all about ``shift``."""

    rows: int
    low: np.ndarray
    high: np.ndarray
    shift: np.ndarray
    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray

    def variance(self, i: int) -> float:
        """Population variance; NaN without a value."""
        n = self.n[i, i]
        return float(self.xx[i, i] / n - (self.x[i, i] / n) ** 2) if n else float("nan")

    def mean(self, i: int) -> float:
        return float(self.shift[i] + self.x[i, i] / self.n[i, i]) if self.n[i, i] else float("nan")

    def correlations(self) -> np.ndarray:
        """Pearson's by pair, over the rows with both; NaN without spread."""
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = self.x / self.n
            spread = np.sqrt(np.maximum(self.xx / self.n - mean**2, 0))
            return (self.xy / self.n - mean * mean.T) / (spread * spread.T)

    def redundant(self, columns: Iterable[int], threshold: float = 0.999999999) -> list[int]:
        """Of the given columns those that reach the absolute correlation with an earlier one that is kept."""
        close = np.abs(self.correlations()) >= threshold
        kept: list[int] = []
        dropped: list[int] = []
        for i in columns:
            (dropped if any(close[k, i] for k in kept) else kept).append(i)
        return dropped


def moment_matrix(df: DataFrame, columns: list[str]) -> Moments:
    """Moments of the columns; nulls and NaN count as missing.

    Each task multiplies its batches with themselves and gives one row for each pair of columns, Spark adds these up.
    What reaches the driver depends on the number of columns alone. Sums are taken about the means of the first rows,
    so that large levels cost no digits.
    """
    p = len(columns)
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    first = values.limit(1000).agg(*[F.avg(f"c{i}") for i in range(p)]).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((p, p)) for k in _SUMS}
        low, high, rows = np.full(p, np.inf), np.full(p, -np.inf), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            rows += len(x)
            there = ~np.isnan(x)
            low, high = np.fmin(low, np.where(there, x, np.inf).min(axis=0, initial=np.inf)), np.fmax(high, np.where(there, x, -np.inf).max(axis=0, initial=-np.inf))
            x = np.where(there, x - shift, 0.0)
            there = there.astype(np.float64)
            sums["n"] += there.T @ there
            sums["x"] += x.T @ there
            sums["xx"] += (x * x).T @ there
            sums["xy"] += x.T @ x
        i, j = (a.ravel() for a in np.indices((p, p), dtype=np.int32))
        ends = [np.repeat(np.where(np.isfinite(e), e, np.nan), p) for e in (low, high)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), pa.array(np.full(p * p, rows, np.int64)), *[pa.array(e, from_pandas=True) for e in ends], *[pa.array(sums[k].ravel()) for k in _SUMS]],
            names=["i", "j", "rows", "low", "high", *_SUMS],
        )

    parts = values.mapInArrow(run, "i int, j int, rows long, low double, high double, n double, x double, xx double, xy double")
    total = parts.groupBy("i", "j").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(k).alias(k) for k in _SUMS])
    out = Moments(0, np.full(p, np.nan), np.full(p, np.nan), shift, *[np.zeros((p, p)) for _ in _SUMS])
    for r in total.collect():  # a row for each pair of columns
        out.rows = r["rows"]
        if r["low"] is not None:
            out.low[r["i"]], out.high[r["i"]] = r["low"], r["high"]
        for k in _SUMS:
            getattr(out, k)[r["i"], r["j"]] = r[k]
    return out
