"""Exact quantiles of all columns and months at once, by repeated narrowing.

Doubles become integers that order alike. Each pass over the data counts, for every value that is looked for, the next
bits of the numbers that share the bits found so far; the bits of the value follow from the counts. A task adds up its
own counts, so a pass shuffles histograms and no data, and no task holds the values of a month.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS = 12  # found in a pass
_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0.0 as 0.0."""
    b = (values + 0.0).view(np.uint64)
    return np.where(b & _SIGN, ~b, b | _SIGN)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(np.float64)


@dataclass
class Selected:
    """groups: the keys of each group, in order. n (group, column): values. lower, upper (group, column, probability): the values
    at the places around (n - 1) * probability, NaN without a value."""

    groups: list[tuple]
    n: np.ndarray
    lower: np.ndarray
    upper: np.ndarray

    def quantiles(self, probabilities: list[float]) -> np.ndarray:
        """(group, column, probability), linear between the two places."""
        place = np.maximum(self.n - 1, 0)[:, :, None] * np.array(probabilities)
        part = place - np.floor(place)
        with np.errstate(invalid="ignore"):  # inf - inf
            return np.where(part > 0, self.lower + (self.upper - self.lower) * part, self.lower)


def select(df: DataFrame, keys: list[str], columns: list[str], probabilities: list[float], most_targets: int = 1_000_000) -> Selected:
    """The values around each probability of each column in each group of the keys; nulls and NaN are no values.

    What the driver and every task hold is a few numbers for each group, column and probability, whatever the number of
    rows; more than most_targets of these are refused: select some columns at a time then.
    """
    names = [tuple(r) for r in df.select(*keys).distinct().orderBy(*keys).limit(most_targets + 1).collect()] if keys else [()]
    shape = (len(names), len(columns), 2 * len(probabilities))
    if np.prod(shape) > most_targets:
        raise ValueError(f"{shape} values to find are more than {most_targets}: take fewer columns at a time")
    spark = df.sparkSession
    numbered = df.select(*keys, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    if keys:
        schema = df.select(*keys).schema
        rows = spark.createDataFrame([(*r, i) for i, r in enumerate(names)], schema.add("__g", "integer"))
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        numbered = numbered.join(F.broadcast(rows.withColumnsRenamed({k: f"__k_{k}" for k in keys})), same)
    else:
        numbered = numbered.withColumn("__g", F.lit(0))
    numbered = numbered.select("__g", *[f"__v{i}" for i in range(len(columns))])
    n, found = np.zeros(shape[:2], np.int64), np.zeros(shape, np.uint64)
    places = np.zeros(shape, np.int64)  # of what is looked for, among the values that share the bits found so far
    for shift in range(64 - _BITS, -_BITS, -_BITS):
        low = max(shift, 0)
        counted = _histograms(numbered, found if low < 64 - _BITS else None, low, shape)
        if low == 64 - _BITS:
            sizes = counted.groupBy("target").agg(F.sum("n").alias("n")).toPandas()
            n.reshape(-1)[sizes["target"]] = sizes["n"]
            reach = np.maximum(n - 1, 0)[:, :, None] * np.array(probabilities)
            places = np.stack((np.floor(reach), np.ceil(reach)), axis=3).astype(np.int64).reshape(shape)
            counted = counted.select(F.explode(F.sequence(F.col("target") * shape[2], F.col("target") * shape[2] + shape[2] - 1)).alias("target"), "bin", "n")
        wanted = spark.createDataFrame(pd.DataFrame({"target": np.arange(places.size), "place": places.reshape(-1)})) if places.size else None
        if wanted is None or not n.any():
            break
        upto = Window.partitionBy("target").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        held = counted.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(wanted), "target").filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        held = held.select("target", "bin", (F.col("place") - F.col("upto") + F.col("n")).alias("place")).toPandas()  # a row for each value that is looked for
        found.reshape(-1)[held["target"]] |= held["bin"].to_numpy(np.uint64) << np.uint64(low)
        places.reshape(-1)[held["target"]] = held["place"]
        if low == 0:
            break
    values = np.where((n > 0)[:, :, None], from_bits(found), np.nan).reshape(*shape[:2], len(probabilities), 2)
    return Selected(names, n, values[..., 0], values[..., 1])


def _histograms(numbered: DataFrame, found: np.ndarray | None, low: int, shape: tuple[int, int, int]) -> DataFrame:
    """target, bin, n: how often the bits from ``low`` on follow the bits that are found for a target.

    In the first pass nothing is found, and a target is a group and column; later it is one value that is looked for.
    """
    shared = numbered.sparkSession.sparkContext.broadcast(found)
    mask, above = np.uint64((1 << _BITS) - 1), np.uint64(low + _BITS)
    if low == 0:  # the last pass may have fewer new bits: those found already stay as they are
        mask, above = np.uint64((1 << (64 % _BITS or _BITS)) - 1), np.uint64(64 % _BITS or _BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            group = batch.column(0).to_numpy().astype(np.int64)
            targets, bins = [], []
            for c in range(shape[1]):
                x = batch.column(1 + c).to_numpy(zero_copy_only=False).astype(np.float64)
                there = ~np.isnan(x)
                bits, own = ordered_bits(x[there]), group[there]
                if found is None:
                    targets.append(own * shape[1] + c)
                    bins.append(bits >> np.uint64(low))
                    continue
                for t in range(shape[2]):
                    fits = np.flatnonzero((bits >> above) == (found[own, c, t] >> above))
                    targets.append((own[fits] * shape[1] + c) * shape[2] + t)
                    bins.append((bits[fits] >> np.uint64(low)) & mask)
            pairs, counts = np.unique(np.stack((np.concatenate(targets), np.concatenate(bins).astype(np.int64))), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(counts.astype(np.int64))], names=["target", "bin", "n"])

    return numbered.mapInArrow(run, "target long, bin long, n long").groupBy("target", "bin").agg(F.sum("n").alias("n"))


def exact_quantiles(df: DataFrame, keys: list[str], columns: list[str], probabilities: list[float]) -> DataFrame:
    """keys, column, n, probability, value: exact quantiles, linear between places; null without a value."""
    s = select(df, keys, columns, probabilities)
    q = s.quantiles(probabilities)
    kinds = df.select(*keys).schema.add("column", "string").add("n", "long").add("probability", "double").add("value", "double")
    rows = [
        (*group, c, int(s.n[g, i]), float(p), None if s.n[g, i] == 0 else float(q[g, i, j]))
        for g, group in enumerate(s.groups)
        for i, c in enumerate(columns)
        for j, p in enumerate(probabilities)
    ]
    return df.sparkSession.createDataFrame(rows, kinds)
