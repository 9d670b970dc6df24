"""Deduplication by priority, conflicts and duplicate summaries."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import is_placeholder


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in an order that must be total."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(at)).filter("__n = 1").drop("__n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k per task before it shuffles."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(at)).filter(F.col("__n") <= k).drop("__n")


def priority_dedup(df: DataFrame, keys: list[str], core: list[str], metadata: list[str], tie: list[str]) -> DataFrame:
    """Exact copies once, then of each key the row with the best metadata.

    metadata is compared column by column: a value that is no placeholder goes before one that is; then by tie, and
    rows equal in these by all other columns in their order, so that every run gives the same rows. Keys whose core
    columns differ are a conflict for core_conflicts(), not for this function.
    """
    rest = [c for c in df.columns if c not in {*keys, *tie}]
    order = [is_placeholder(F.col(c)).asc() for c in metadata] + [F.col(c).asc_nulls_last() for c in [*tie, *rest]]
    return first_by(df.distinct(), keys, order)


def _differs(c: str) -> Column:
    """Whether a group's values of a column differ, null being a value; least and greatest tell, so nothing is expanded."""
    return (F.coalesce(F.min(c) != F.max(c), F.lit(False))) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))


def core_conflicts(df: DataFrame, keys: list[str], core: list[str]) -> DataFrame:
    """Keys with more than one value (null is one) in a core column, and the names of those columns."""
    kinds = df.groupBy(*keys).agg(*[_differs(c).alias(f"__{c}") for c in core])
    names = F.array_compact(F.array(*[F.when(F.col(f"__{c}"), F.lit(c)) for c in core]))
    return kinds.select(*keys, F.array_join(names, ",").alias("conflicts")).filter("conflicts <> ''")


def resolve_or_stop(df: DataFrame, keys: list[str], core: list[str], metadata: list[str], tie: list[str], conflicts_path: str) -> DataFrame:
    """priority_dedup() if no key has a conflict in its core columns.

    Else all rows of such keys, exact copies once, are written to conflicts_path with the names of the columns that
    differ, and ValueError is raised with their number.
    """
    once = df.distinct()
    bad = core_conflicts(once, keys, core)
    watched = Observation()
    once.join(bad, keys).observe(watched, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(conflicts_path)
    if rows := watched.get["rows"]:
        raise ValueError(f"{rows} rows disagree in {core}; they are in {conflicts_path}")
    return priority_dedup(df, keys, core, metadata, tie)


def raw_duplicates(df: DataFrame, keys: list[str], texts: list[str], codes: list[str]) -> DataFrame:
    """One row on the repeated keys of a raw table, by two aggregations: of equal rows, then of keys.

    rows, keys, duplicate_keys, rows_in_duplicate_keys, extra_rows_by_key, unique_rows, extra_rows_by_row, and how many
    duplicate keys have only equal rows, several different ones, a row without metadata (no text, no code or code 0),
    both such a row and one with metadata.
    """
    once = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    empty = reduce(and_, [F.col(c).isNull() for c in texts] + [F.coalesce(F.col(c) == 0, F.lit(True)) for c in codes])
    per = once.groupBy(*keys).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.bool_or(empty).alias("bare"), F.bool_or(~empty).alias("full"))
    twice = F.col("n") > 1
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(twice).alias("duplicate_keys"), F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows_by_key"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("unique_rows"), F.coalesce(F.sum(F.col("n") - F.col("kinds")), F.lit(0)).alias("extra_rows_by_row"),
        F.count_if(twice & (F.col("kinds") == 1)).alias("keys_of_equal_rows"), F.count_if(F.col("kinds") > 1).alias("keys_of_different_rows"),
        F.count_if(twice & F.col("bare")).alias("keys_with_bare_row"), F.count_if(twice & F.col("bare") & F.col("full")).alias("keys_with_bare_and_full_row"),
    )


def conflict_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """column, duplicate_keys_with_conflict: of every other column, how many keys have different values of it."""
    others = [c for c in df.columns if c not in keys]
    per = df.groupBy(*keys).agg(*[_differs(c).alias(c) for c in others])
    counts = per.agg(*[F.count_if(c).alias(c) for c in others])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("duplicate_keys_with_conflict")) for c in others])).alias("r")).select("r.*")


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """group_size, n_keys: how many keys have so many rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).groupBy("group_size").agg(F.count(F.lit(1)).alias("n_keys"))


def duplicate_inspection(df: DataFrame, keys: list[str], core: list[str]) -> DataFrame:
    """One row on a raw table: rows, keys, exact copies, repeated keys and those that differ in a core column."""
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.xxhash64(*[F.col(c) for c in df.columns])).alias("kinds"),
        *[_differs(c).alias(f"__{c}") for c in core],
    )
    clash = reduce(or_, [F.col(f"__{c}") for c in core])
    return per.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.col("n") - F.col("kinds")).alias("n_exact_copies"),
        F.count_if(F.col("n") > 1).alias("n_repeated_keys"),
        F.count_if(clash).alias("n_conflicting_keys"),
        reduce(add, [F.count_if(F.col(f"__{c}")) for c in core]).alias("n_conflicting_columns"),
        F.max("n").alias("largest_group"),
    )
