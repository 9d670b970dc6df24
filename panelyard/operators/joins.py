"""Interval and as-of joins without cross products: unions ordered within a key, or range joins on equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import orders, quality


def interval_link(rows: DataFrame, links: DataFrame, row_id: str, key: str, date: str, start: str, end: str, best: list[Column], carry: list[str]) -> DataFrame:
    """Left join to the best link whose [start, end] holds the row's date; an open end never ends.

    best: order of preference among the links of one row (columns of links), which must be total. Rows without a
    fitting link stay with nulls.
    """
    right = links.select(F.col(key).alias("__k"), F.col(start).alias("__from"), F.coalesce(F.col(end), F.lit("2100-12-31").cast("date")).alias("__to"), *carry, *[c.alias(f"__b{i}") for i, c in enumerate(best)])
    left = rows.select(row_id, key, date)
    fits = (left[key] == right["__k"]) & (left[date] >= right["__from"]) & (left[date] <= right["__to"])
    order = F.struct(*[F.col(f"__b{i}") for i in range(len(best))])
    chosen = left.join(right, fits).groupBy(row_id).agg(F.min_by(F.struct(*carry), order).alias("__c"))
    return rows.join(chosen, row_id, "left").select(*rows.columns, *[F.col(f"__c.{c}").alias(c) for c in carry])


def link_order(primary: str = "linkprim", kind: str = "linktype", start: str = "linkdt") -> list[Column]:
    """P before C, LC before LU before LS, then the latest start."""
    return [
        F.when(F.col(primary) == "P", 0).when(F.col(primary) == "C", 1).otherwise(2),
        F.when(F.col(kind) == "LC", 0).when(F.col(kind) == "LU", 1).when(F.col(kind) == "LS", 2).otherwise(3),
        -F.unix_date(F.col(start)),
    ]


def _stream(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, carry: list[str], tie: list[str]) -> DataFrame:
    """Both sides as rows of one stream: __k, __at, __side (0: right), __tie, and __row or __value."""
    value = F.struct(F.col(right_date).alias("__date"), *[F.col(c) for c in carry])
    ties = F.struct(*[F.col(c) for c in tie])
    kind = lambda c: right.select(c).schema[0].dataType
    none = F.lit(None)
    one = left.select(F.struct("*").alias("__row"), F.col(key).alias("__k"), F.col(left_date).alias("__at"), F.lit(1).alias("__side"), none.cast(kind(ties)).alias("__tie"), none.cast(kind(value)).alias("__value"))
    usable = right.filter(F.col(right_date).isNotNull() & F.col(key).isNotNull())
    two = usable.select(none.cast(one.schema["__row"].dataType).alias("__row"), F.col(key).alias("__k"), F.col(right_date).alias("__at"), F.lit(0).alias("__side"), ties.alias("__tie"), value.alias("__value"))
    return one.unionByName(two)


def _latest(stream: DataFrame, out: str, segmented: bool, ahead: bool = False) -> DataFrame:
    """stream with the last right value at or before each row, or the next one at or after it."""
    names = ("__at", "__side", "__tie")
    if segmented:
        return orders.carried(stream, "__k", [F.col(c) for c in names], "__value", out, ahead)
    order = [F.col(c).desc() if ahead else F.col(c).asc() for c in names]
    return stream.withColumn(out, F.last("__value", ignorenulls=True).over(Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def asof_backward(
    left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, carry: list[str], tie: list[str], max_age_days: int | None = None, segmented: bool = False
) -> DataFrame:
    """Each left row with the last right row of its key at or before its date.

    Both sides are put into one ordered stream per key, so one shuffle and one sort do it. Of right rows with one date
    the last by tie wins. With max_age_days older matches are nulls. Adds carry, age_days and matched.

    segmented: for data where one key may have more rows than a task should sort. The stream is cut into ranges of key
    and date, and each range is handed the last right row of those before it.
    """
    found = _latest(_stream(left, right, key, left_date, right_date, carry, tie), "__m", segmented).filter("__side = 1")
    age = F.datediff("__at", "__m.__date")
    fresh = F.col("__m").isNotNull() & (age <= max_age_days if max_age_days is not None else F.lit(True))
    return found.select("__row.*", *[F.when(fresh, F.col(f"__m.{c}")).alias(c) for c in carry], F.when(fresh, age).alias("age_days"), fresh.alias("matched"))


def asof_nearest(
    left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, carry: list[str], tie: list[str], tolerance_days: int, segmented: bool = False
) -> DataFrame:
    """Each left row with the nearest right row of its key within tolerance_days; equally near, the earlier one.

    segmented: as in asof_backward().
    """
    # two running passes: one that looks back, one over the opposite order; frames to the end would be quadratic
    stream = _latest(_stream(left, right, key, left_date, right_date, carry, tie), "__b", segmented)
    stream = _latest(stream, "__f", segmented, ahead=True).filter("__side = 1")
    behind, ahead = F.datediff("__at", "__b.__date"), F.datediff("__f.__date", "__at")
    m = F.when(F.col("__b").isNotNull() & (F.col("__f").isNull() | (behind <= ahead)), F.col("__b")).otherwise(F.col("__f"))
    near = stream.withColumn("__m", m).withColumn("__d", F.abs(F.datediff("__at", "__m.__date")))
    ok = F.coalesce(F.col("__d") <= tolerance_days, F.lit(False))
    return near.select("__row.*", *[F.when(ok, F.col(f"__m.{c}")).alias(c) for c in carry], F.when(ok, F.col("__d")).alias("distance_days"), ok.alias("matched"))


def agreeing_merge(a: DataFrame, b: DataFrame, keys: list[str], agree: list[str], overwrite: list[str]) -> DataFrame:
    """a with the overwrite columns of b; raises if the two disagree in an agree column on a common key."""
    both = a.alias("a").join(b.alias("b"), keys, "left")
    bad = both.filter(" OR ".join(f"(b.{c} IS NOT NULL AND NOT a.{c} <=> b.{c})" for c in agree)).limit(5).collect()
    if bad:
        raise ValueError(f"sets disagree on {[tuple(r[k] for k in keys) for r in bad]}")
    return both.select(*keys, *[F.col(f"a.{c}").alias(c) for c in a.columns if c not in keys and c not in overwrite], *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in a.columns else F.col(f"b.{c}").alias(c) for c in overwrite])


def to_panel_dates(rows: DataFrame, panel: DataFrame, month: str, date: str) -> DataFrame:
    """rows by calendar month with the panel's date of that month as ``date``; months that the panel lacks go.

    Raises if a month of the panel has two dates: the match must be one to one.
    """
    dates = quality.require_one_date_a_month(panel.select(month, date).distinct(), date, month)
    return rows.drop(date).join(dates, month)
