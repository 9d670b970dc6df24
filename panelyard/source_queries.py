"""Queries of discovery, conversion, keyed joins and duplicates, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import scalars as x
from panelyard.functions.dates import month_id
from panelyard.more_queries import _USED, _labelled
from panelyard.operators import dedup, features, joins, models, quality, xsection
from panelyard.queries import _LINKS, _links, query, rounded
from panelyard.sources import readers, writers
from panelyard.sources.readers import table


@query(
    """SELECT 'a/nation.csv' AS name, 'written' AS first, 'kept' AS second, 'written' AS third, count(*) AS n_rows FROM nation UNION ALL SELECT 'region.csv', 'written', 'kept', 'written', count(*) FROM region
UNION ALL SELECT 'tmp_region.csv', 'skipped', 'skipped', 'skipped', NULL"""
)
def converted_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three CSV files in folders as Parquet: a first time, again, and again with overwriting."""
    source, target = writers.scratch(spark, "csv"), writers.scratch(spark, "converted")
    for name, part in (("nation", "a/nation.csv"), ("region", "region.csv"), ("region", "tmp_region.csv")):
        at = writers.scratch(spark, "one")
        table(spark, sf_dir, name).coalesce(1).write.option("header", True).csv(at)
        (made,) = readers.files_below(spark, at, ".csv")
        writers.rename(spark, made, f"{source}/{part}")
    runs = [dict(readers.convert_folder(spark, source, target, overwrite=o, skip=("tmp_",))) for o in (False, False, True)]
    rows = [(n, *(r[n] for r in runs), spark.read.parquet(f"{target}/{n.removesuffix('.csv')}.parquet").count() if runs[0][n] == "written" else None) for n in runs[0]]
    return spark.createDataFrame(rows, "name string, first string, second string, third string, n_rows long")


@query("SELECT n_nationkey, n_name FROM nation")
def located_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one of three files that has the columns and the best name; and a fallback for a path that is not there."""
    folder = writers.scratch(spark, "located")
    n = table(spark, sf_dir, "nation")
    for name, df in (("old_all_nations", n.filter("n_nationkey < 3")), ("all_nations_monthly", n), ("nations_monthly_all_new", n.drop("n_regionkey"))):
        writers.parquet(df.coalesce(1), f"{folder}/{name}")
    best = readers.locate(spark, folder, ["n_nationkey", "n_regionkey"], {"monthly": 5, "all_": 2, "old": -1})
    return spark.read.parquet(readers.first_path(spark, f"{folder}/none", best)).select("n_nationkey", "n_name")


@query(
    """SELECT 'prediction_a' AS model, count(*) AS n, round(avg(s_acctbal), 4) AS mean FROM supplier UNION ALL SELECT 'score_b', count(*) FILTER (s_suppkey % 2 = 0), round(avg(s_suppkey) FILTER (s_suppkey % 2 = 0), 4) FROM supplier"""
)
def discovered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files by name, their score columns by schema and values, as one long table of scores."""
    folder = writers.scratch(spark, "runs")
    s = table(spark, sf_dir, "supplier")
    made = s.select("s_suppkey", F.col("s_acctbal").alias("prediction_a"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("double")).alias("score_b"), F.lit(0.1).alias("prob_a_top"), F.lit(None).cast("double").alias("score_none"), F.col("s_name").alias("score_text"))
    for name in ("run_predictions.parquet", "debug_predictions.parquet"):
        writers.parquet(made, f"{folder}/{name}")
    names, lacking = readers.prediction_names(["run_predictions.parquet", "debug_predictions.parquet", "readme.txt"], ["run_predictions.parquet"])
    if lacking:
        raise ValueError(lacking)
    df = spark.read.parquet(*[f"{folder}/{n}" for n in names])
    long = df.unpivot(["s_suppkey"], features.score_columns(df), "model", "score")
    return rounded(long.groupBy("model").agg(F.count("score").alias("n"), F.avg("score").alias("mean")), 4)


@query("SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part")
def catalogued_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by a catalogue of feature groups in a JSON file, in group order, each once."""
    path = writers.scratch(spark, "groups")
    writers.report(spark, writers.json_lines({"sizes": ["p_size", "p_retailprice"], "prices": ["p_retailprice"]}), path)
    groups = readers.json_groups("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))
    part = table(spark, sf_dir, "part")
    used = readers.feature_list(groups, ["sizes", "prices"], part.columns)
    return part.select("p_partkey", *[F.col(c).cast("double").alias(c) for c in used])


@query(
    f"""WITH {_LINKS}, c AS (SELECT o_orderkey, gvkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY prim, kind, linkdt DESC) AS n FROM orders JOIN links ON permno = o_custkey AND CAST(o_orderdate AS DATE) BETWEEN linkdt AND linkenddt)
SELECT o.o_orderkey, CASE WHEN o.o_custkey % 7 <> 0 THEN c.gvkey END AS gvkey FROM orders o LEFT JOIN c ON c.o_orderkey = o.o_orderkey AND n = 1"""
)
def link_by_cleaned_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval link on ids that one side writes as numbers with ``.0`` and blanks, some of them missing."""
    raw = F.when(F.col("o_custkey") % 7 == 0, "nan").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", x.clean_identifier(raw, 8).alias("id"), F.to_date("o_orderdate").alias("date"))
    links = _links(spark, sf_dir).withColumn("id", x.clean_identifier(F.col("permno"), 8))
    return joins.interval_link(rows, links, "o_orderkey", "id", "date", "linkdt", "linkenddt", joins.link_order(), ["gvkey"]).select("o_orderkey", "gvkey")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS score FROM orders")
def merged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets that agree on their keys' columns; the second one's scores replace the first one's where it has any."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score"))
    b = a.filter("o_orderkey % 3 = 0").withColumn("score", F.col("score") / 2)
    return joins.agreeing_merge(a, b, ["o_orderkey"], ["o_custkey"], ["score"])


@query("SELECT o_orderkey, o_totalprice, dense_rank() OVER (ORDER BY substr(o_orderpriority, 1, 1)) AS class FROM orders")
def rejoined_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a table joined back to the file when it is read again: by the key that both carry, never by position."""
    path = writers.scratch(spark, "rescanned")
    writers.parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(3, "o_totalprice"), path)
    about = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("class"))
    joined = quality.checked_join(spark.read.parquet(path), about, ["o_orderkey"], one_to_one=True)
    return quality.require_complete(joined, "class", ["o_orderkey"])


_RAW = "raw AS (SELECT o_custkey % 400 AS k, substr(o_orderpriority, 1, 1) AS p, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS text, CASE WHEN o_orderkey % 2 > 0 THEN o_custkey % 2 END AS code FROM orders)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 400).alias("k"), F.substring("o_orderpriority", 1, 1).alias("p"), F.when(k % 3 > 0, F.col("o_orderstatus")).alias("text"), F.when(k % 2 > 0, F.col("o_custkey") % 2).alias("code")
    )


@query(
    f"""WITH {_RAW}, u AS (SELECT k, p, text, code, count(*) AS n, text IS NULL AND coalesce(code = 0, true) AS bare FROM raw GROUP BY ALL), g AS (SELECT k, p, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds, bool_or(bare) AS b, bool_or(NOT bare) AS f FROM u GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows_by_key, CAST(sum(kinds) AS BIGINT) AS unique_rows,
  CAST(sum(n - kinds) AS BIGINT) AS extra_rows_by_row, count(*) FILTER (n > 1 AND kinds = 1) AS keys_of_equal_rows, count(*) FILTER (kinds > 1) AS keys_of_different_rows, count(*) FILTER (n > 1 AND b) AS keys_with_bare_row, count(*) FILTER (n > 1 AND b AND f) AS keys_with_bare_and_full_row FROM g"""
)
def raw_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.raw_duplicates(_raw(spark, sf_dir), ["k", "p"], ["text"], ["code"])


@query(
    f"""WITH {_RAW}, g AS (SELECT k, p, (count(DISTINCT text) + max(CAST(text IS NULL AS INTEGER))) > 1 AS a, (count(DISTINCT code) + max(CAST(code IS NULL AS INTEGER))) > 1 AS b FROM raw GROUP BY ALL)
SELECT 'text' AS "column", count(*) FILTER (a) AS duplicate_keys_with_conflict FROM g UNION ALL SELECT 'code', count(*) FILTER (b) FROM g"""
)
def conflict_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.conflict_columns(_raw(spark, sf_dir), ["k", "p"])


@query(
    f"""WITH {_RAW}, u AS (SELECT DISTINCT * FROM raw), g AS (SELECT k, p FROM u GROUP BY ALL HAVING (count(DISTINCT code) + max(CAST(code IS NULL AS INTEGER))) > 1)
SELECT k, p, text, code, 'code' AS conflicts FROM u SEMI JOIN g USING (k, p)"""
)
def stopped_on_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that were written when a deduplication stopped on keys that disagree."""
    path = writers.scratch(spark, "conflicts")
    try:
        dedup.resolve_or_stop(_raw(spark, sf_dir), ["k", "p"], ["code"], ["text"], ["text"], path)
    except ValueError:
        return spark.read.parquet(path)
    raise AssertionError("the table has conflicts")


@query()
def elastic_net_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores of the best elastic net of four rates and three mixes, from the saved model."""
    df = _labelled(spark, sf_dir)
    grid = {f"{a:g}/{mix:g}": models.elastic_net(a, mix, "target") for a in (1e-4, 1e-3, 1e-2, 1e-1) for mix in (0.1, 0.5, 0.9)}
    name, model, _ = models.fit_grid(df, _USED, "target", grid)
    path = writers.scratch(spark, "elastic")
    models.save_model(model, _USED, path)
    scored = models.load_model(spark, path, _USED).transform(df.filter("split = 'test'"))
    return scored.select("entity", "month_id", F.lit(name).alias("model"), "score", "target")


_MONTH_DATES = "p AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS month_id, max(l_shipdate) AS day FROM lineitem GROUP BY 1)"


@query(f"WITH {_MONTH_DATES}, o AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month_id, count(*) AS n_orders FROM orders GROUP BY 1) SELECT CAST(month_id AS INTEGER) AS month_id, n_orders, CAST(day AS DATE) AS day FROM o JOIN p USING (month_id)")
def panel_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by calendar month, on the date that the order lines' panel has for the month."""
    lines = table(spark, sf_dir, "lineitem", ["l_shipdate"]).select(month_id(F.col("l_shipdate")).alias("month_id"), F.to_date("l_shipdate").alias("day"))
    last = lines.groupBy("month_id").agg(F.max("day").alias("day"))
    made = table(spark, sf_dir, "orders", ["o_orderdate"]).groupBy(month_id(F.col("o_orderdate")).alias("month_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.to_panel_dates(made, last, "month_id", "day")


@query(
    """WITH l AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS month_id, CASE WHEN l_linenumber > 1 THEN l_discount END AS discount, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS returned FROM lineitem)
SELECT month_id, count(*) AS n_rows, count(discount) AS discount_n, count(returned) AS returned_n FROM l GROUP BY 1"""
)
def monthly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").select(month_id(F.col("l_shipdate")).alias("month_id"), F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("discount"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("returned"))
    return xsection.monthly_coverage(made, ["discount", "returned"])


@query("SELECT c_mktsegment AS family, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def family_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with one CSV folder for each family, read back."""
    path = writers.scratch(spark, "families")
    made = rounded(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")), 4)
    writers.csv(made, path, partition_by=["family"])
    return spark.read.schema("n long, mean double, family string").option("header", True).csv(path)
