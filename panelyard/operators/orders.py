"""Orders over more rows than one task should sort: ranks of whole tables and values carried along one key.

Both cut the ordered rows into ranges, a partition each, do their work inside the ranges, and then hand each range what
it needs to know of those before it: one row per range and key. A key may hold all rows, a value may be any share of
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.sources.writers import cut_lineage

_BEFORE = Window.unboundedPreceding


def ordered_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, value, n (rows with the value, or their weights), before (those of the key with smaller values), pieces (rows of df).

    Equal values are counted first, so a value in many rows is one row here; nulls are a value, the smallest.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*keys, value).agg(count.alias("n"), F.count(F.lit(1)).alias("pieces"))
    ranged = counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # the ranges must be the same in both uses below
    inside = F.sum("n").over(Window.partitionBy("__part", *keys).orderBy(value).rowsBetween(_BEFORE, 0)) - F.col("n")
    sizes = ranged.groupBy("__part", *keys).agg(F.sum("n").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(_BEFORE, 0)
    offsets = sizes.withColumn("__offset", F.sum("__n").over(earlier) - F.col("__n")).drop("__n").withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__part": "__p"})
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    placed = ranged.withColumn("__inside", inside).join(offsets, same)
    return placed.select(*keys, value, "n", (F.col("__inside") + F.col("__offset")).alias("before"), "pieces")


def with_global_rank(df: DataFrame, keys: list[str], value: str, out: str, weight: str | None = None, hot: int = 1000) -> DataFrame:
    """df, without its null values, with the average rank of value among all rows of the keys (1 is the smallest).

    Values that stand in more than one in ``hot`` of the rows, of which there are fewer than hot, are joined by
    broadcast, so no task gets the rows of one value.
    """
    df = df.filter(F.col(value).isNotNull())
    ranks = ordered_counts(df, keys, value, weight)
    ranks = cut_lineage(ranks.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(value).alias("__v"), (F.col("before") + (F.col("n") + 1) / 2).alias(out), "pieces"))
    often = ranks.agg(F.sum("pieces")).first()[0] or 0
    same = F.col(value) == F.col("__v")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    columns = [*df.columns, out]
    is_hot = F.col("pieces") * hot > often
    first = df.join(F.broadcast(ranks.filter(is_hot)), same, "left").select(*columns)
    rest = first.filter(F.col(out).isNull()).drop(out).join(ranks.filter(~is_hot), same).select(*columns)
    return first.filter(F.col(out).isNotNull()).unionByName(rest)


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation per keys over the rows with both values: n, spearman (null without spread).

    Equal pairs are counted once with their weight. Ranks are average ranks over all rows of the keys; their mean is
    known, (n + 1) / 2, so the sums are taken about it.
    """
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("__w"))
    pairs = cut_lineage(pairs)
    ranked = with_global_rank(with_global_rank(pairs, keys, "__a", "__ra", "__w"), keys, "__b", "__rb", "__w")
    n = pairs.groupBy(*keys).agg(F.sum("__w").alias("__n")).withColumnsRenamed({k: f"__m_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__m_{k}"))
    x, y, w = F.col("__ra") - (F.col("__n") + 1) / 2, F.col("__rb") - (F.col("__n") + 1) / 2, F.col("__w")
    sums = ranked.join(n, same).groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * x * x).alias("__xx"), F.sum(w * y * y).alias("__yy"), F.sum(w * x * y).alias("__xy"))
    size = F.sqrt(F.col("__xx")) * F.sqrt(F.col("__yy"))
    return sums.select(*keys, "n", F.when(size > 0, F.col("__xy") / F.when(size > 0, size)).alias("spearman"))


def carried(df: DataFrame, key: str, order: list[Column], value: str, out: str, ahead: bool = False) -> DataFrame:
    """df with the last non-null value at or before each row of its key, by the order; a key may hold all rows.

    ahead: the next one at or after the row instead. A null key carries nothing. Rows whose order is equal may see each other or not, as in any ordered window.
    """
    df = df.withColumns({f"__o{i}": c for i, c in enumerate(order)})
    names = [F.col(f"__o{i}") for i in range(len(order))]
    ranged = cut_lineage(df.repartitionByRange(F.col(key), *names).withColumn("__part", F.spark_partition_id()))
    last = F.last(value, ignorenulls=True)
    turned = lambda columns: [c.desc() if ahead else c.asc() for c in columns]
    inside = ranged.withColumn(out, last.over(Window.partitionBy("__part", key).orderBy(*turned(names)).rowsBetween(_BEFORE, 0)))
    # what a range leaves to the next one: its last value of each key that goes on there, which can be its last key only
    ends = ranged.groupBy("__part", key).agg((F.min_by if ahead else F.max_by)(F.when(F.col(value).isNotNull(), F.struct(value)), F.when(F.col(value).isNotNull(), F.struct(*names))).alias("__end"))
    twice = Window.partitionBy(key)
    ends = ends.withColumn("__ranges", F.count(F.lit(1)).over(twice)).filter("__ranges > 1")
    handed = F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy(*turned([F.col("__part")])).rowsBetween(_BEFORE, -1))
    handed = ends.select(F.col("__part").alias("__to_part"), F.col(key).alias("__to_key"), handed.alias("__from"))
    joined = inside.join(F.broadcast(handed), (F.col("__part") == F.col("__to_part")) & (F.col(key) == F.col("__to_key")), "left")  # two rows a range at most
    got = F.when(F.col(key).isNotNull(), F.coalesce(F.col(out), F.col(f"__from.{value}")))
    return joined.select(*[c for c in df.columns if not c.startswith("__o")], got.alias(out))
