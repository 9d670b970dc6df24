"""Gates around joins and writes. Each raises ValueError with a few offending keys, or returns its input unchanged."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    lost = [c for c in columns if c.lower() not in {x.lower() for x in df.columns}]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    return df


def require_unique(df: DataFrame, keys: list[str], shown: int = 20) -> DataFrame:
    twice = df.groupBy(*keys).count().filter("count > 1").orderBy(*keys).limit(shown).collect()
    if twice:
        raise ValueError(f"keys {keys} repeat: {[tuple(r)[:-1] for r in twice]}")
    return df


def require_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    if any(counts.values()):
        raise ValueError(f"nulls: { {k: v for k, v in counts.items() if v} }")
    return df


def require_complete(df: DataFrame, column: str, keys: list[str], shown: int = 20) -> DataFrame:
    """After a left join: every row found its partner."""
    lost = df.filter(F.col(column).isNull()).select(*keys).distinct().orderBy(*keys).limit(shown).collect()
    if lost:
        raise ValueError(f"no {column} for {[tuple(r) for r in lost]}")
    return df


def require_no_leakage(features: list[str], targets: tuple[str, ...] = ("target", "label", "split")) -> list[str]:
    bad = [f for f in features if any(t in f.lower() for t in targets)]
    if bad:
        raise ValueError(f"target columns among the features: {bad}")
    return features


def require_ordered_splits(df: DataFrame, split: str, month: str, order: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Every split has rows and ends before the next begins."""
    ends = {r[split]: (r["lo"], r["hi"]) for r in df.groupBy(split).agg(F.min(month).alias("lo"), F.max(month).alias("hi")).collect()}
    lost = [s for s in order if s not in ends]
    if lost or any(ends[a][1] >= ends[b][0] for a, b in zip(order, order[1:])):
        raise ValueError(f"splits empty or out of order: {ends}")
    return df


def require_coverage(df: DataFrame, features: list[str], split: str = "split", strict: str = "train") -> list[str]:
    """Every feature has a value in the strict split, or ValueError; warnings on those without one in another split."""
    row = df.groupBy(split).agg(*[F.count(f).alias(f) for f in features]).collect()  # a row a split
    lost = {r[split]: [f for f in features if not r[f]] for r in row}
    if lost.get(strict):
        raise ValueError(f"no value in {strict}: {lost[strict]}")
    return [f"no value in {s}: {f}" for s in sorted(k for k in lost if k) for f in lost[s]]


def require_same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """A join or write that must keep the number of rows did so."""
    n, m = before.count(), after.count()
    if n != m:
        raise ValueError(f"{n} rows became {m}")
    return after


class Watched:
    """Gates on data that are written anyway: counts are taken on the way, by Spark's observed metrics, with no scan of their own.

    Mark points of a plan with watch(), run one action on what comes of it, then ask the gates.
    """

    def __init__(self):
        self.points: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, *metrics: Column) -> DataFrame:
        """df, which counts its rows (``rows``), and the metrics, whenever an action runs it."""
        self.points[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self.points[name], F.count(F.lit(1)).alias("rows"), *metrics)

    def unchanged(self, df: DataFrame, name: str, column: str, original: str) -> DataFrame:
        """df, watched for the greatest absolute difference of two columns (``difference``) and the rows where only one is null (``one_null``)."""
        a, b = F.col(column), F.col(original)
        return self.watch(df, name, F.max(F.abs(a - b)).alias("difference"), F.count_if(a.isNull() != b.isNull()).alias("one_null"))

    def counts(self, name: str) -> dict:
        return self.points[name].get

    def require_same_count(self, before: str, after: str) -> None:
        n, m = self.counts(before)["rows"], self.counts(after)["rows"]
        if n != m:
            raise ValueError(f"{n} rows became {m}")

    def require_unchanged(self, name: str, most: float = 0.0) -> None:
        got = self.counts(name)
        if got["one_null"] or (got["difference"] or 0.0) > most:
            raise ValueError(f"values changed: {got}")


def written_with_count(before: DataFrame, change: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], drop: Callable[[], None]) -> int:
    """Writes change(before), a step that keeps the number of rows, and checks that it did; one run of the plan.

    If it did not, what was written is dropped and ValueError raised. Returns the rows.
    """
    watched = Watched()
    write(watched.watch(change(watched.watch(before, "before")), "after"))
    try:
        watched.require_same_count("before", "after")
    except ValueError:
        drop()
        raise
    return watched.counts("after")["rows"]


def require_one_date_a_month(df: DataFrame, date: str, month: str) -> DataFrame:
    twice = df.groupBy(month).agg(F.count_distinct(date).alias("dates")).filter("dates > 1").orderBy(month).limit(20).collect()
    if twice:
        raise ValueError(f"months with several dates: {[r[month] for r in twice]}")
    return df


def require_predictions(df: DataFrame, scores: list[str], split: str = "split", skipped: tuple[str, ...] = ()) -> DataFrame:
    """Every score but the skipped ones is there in all rows of validation and test."""
    wanted = [s for s in scores if s not in skipped]
    lost = df.filter(F.col(split).isin("validation", "test")).agg(*[F.count_if(F.col(s).isNull()).alias(s) for s in wanted]).first().asDict() if wanted else {}
    if any(lost.values()):
        raise ValueError(f"missing predictions: { {k: v for k, v in lost.items() if v} }")
    return df


def lookahead_audit(df: DataFrame, date: str, available: str) -> DataFrame:
    """One row: rows, rows with a value, those that use it before it is available, and the share of these."""
    early = F.col(available) > F.col(date)
    n = F.count(available)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), n.alias("n_with_value"), F.count_if(early).alias("n_early"), F.when(n > 0, F.count_if(early) / F.greatest(n, F.lit(1))).alias("share_early"))


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """A join whose right keys (and left ones, if one_to_one) are known to be unique, so a left join keeps the row count."""
    require_unique(right, keys)
    if one_to_one:
        require_unique(left, keys)
    return left.join(right, keys, how)


def gate_table(df: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """gate, value, threshold, passed: the share of rows with each condition (SQL text) against its threshold."""
    shares = df.agg(*[F.avg(F.expr(cond).cast("double")).alias(name) for name, (cond, _) in gates.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.lit(float(t)).alias("threshold")) for n, (_, t) in gates.items()])
    return shares.select(F.explode(rows).alias("g")).select("g.*", (F.col("g.value") >= F.col("g.threshold")).alias("passed"))
