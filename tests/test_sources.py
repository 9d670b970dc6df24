"""Discovery of files, a database scan, conflicts that stop, coverage gates."""

import pytest
from pyspark.sql import functions as F

from panelyard.operators import dedup, joins, quality
from panelyard.sources import readers


def test_database_scan_runs_in_the_database(spark):
    url = "jdbc:derby:memory:panel;create=true"
    rows = spark.createDataFrame([(1, "LC", 5.0), (2, "LU", 6.0), (-3, "LC", 7.0), (4, "XX", 8.0)], "LPERMNO int, LINKTYPE string, V double")
    rows.write.format("jdbc").option("url", url).option("dbtable", "LINKS").option("createTableColumnTypes", "LINKTYPE VARCHAR(8)").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    df = readers.jdbc(spark, url, "LINKS", {"LPERMNO": "PERMNO", "V": "VALUE_OF"}, "LPERMNO", ("LINKTYPE", ["LC", "LU"]), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(map(tuple, df.collect())) == [(1, 5.0), (2, 6.0)] and df.columns == ["PERMNO", "VALUE_OF"]
    assert "JDBCRelation" in df._jdf.queryExecution().executedPlan().toString()


def test_paths(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a"))
    (tmp_path / "a" / "_hidden.parquet").write_bytes(b"")
    assert len(readers.files_below(spark, str(tmp_path), ".parquet")) == 1
    assert readers.first_path(spark, str(tmp_path / "no"), str(tmp_path / "a")) == str(tmp_path / "a")
    with pytest.raises(ValueError, match="none of"):
        readers.first_path(spark, str(tmp_path / "no"))
    with pytest.raises(ValueError, match="no file"):
        readers.locate(spark, str(tmp_path), ["missing"], {})


def test_conflicts_stop_and_leave_their_rows(spark, tmp_path):
    rows = [(1, 1.0, "a"), (1, 1.0, "a"), (1, 1.0, None), (2, 2.0, "b"), (3, None, "c"), (3, 4.0, "d")]
    df = spark.createDataFrame(rows, "k int, core double, meta string")
    with pytest.raises(ValueError, match="2 rows disagree"):
        dedup.resolve_or_stop(df, ["k"], ["core"], ["meta"], ["meta"], str(tmp_path / "bad"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "bad")).collect()), key=str) == [(3, 4.0, "d", "core"), (3, None, "c", "core")]
    fine = dedup.resolve_or_stop(df.filter("k < 3"), ["k"], ["core"], ["meta"], ["meta"], str(tmp_path / "none"))
    assert sorted(map(tuple, fine.collect())) == [(1, 1.0, "a"), (2, 2.0, "b")]
    one = dedup.raw_duplicates(df, ["k"], ["meta"], []).first()
    assert (one["rows"], one["keys"], one["duplicate_keys"], one["unique_rows"], one["keys_with_bare_and_full_row"]) == (6, 3, 2, 5, 1)
    assert dedup.raw_duplicates(df.limit(0), ["k"], ["meta"], []).first()["rows"] == 0


def test_coverage(spark):
    df = spark.createDataFrame([("train", 1.0, None), ("test", None, 1.0)], "split string, a double, b double")
    with pytest.raises(ValueError, match="no value in train"):
        quality.require_coverage(df, ["a", "b"])
    assert quality.require_coverage(df, ["a"]) == ["no value in test: a"]


def test_schema_of_an_empty_table(spark):
    got = readers.schema_table(spark.range(0).withColumn("x", F.lit("a"))).collect()
    assert sorted((r["column"], r["nonmissing"], r["n_unique"], r["examples"]) for r in got) == [("id", 0, 0, ""), ("x", 0, 0, "")]


def test_a_month_of_the_panel_has_one_date(spark):
    rows = spark.createDataFrame([(1, 10.0), (3, 30.0)], "month_id int, v double").withColumn("day", F.lit("own"))
    panel = spark.createDataFrame([(1, "2000-01-31"), (1, "2000-01-31"), (2, "2000-02-29")], "month_id int, day string")
    assert [tuple(r) for r in joins.to_panel_dates(rows, panel, "month_id", "day").collect()] == [(1, 10.0, "2000-01-31")]
    with pytest.raises(ValueError, match="several dates"):
        joins.to_panel_dates(rows, panel.unionByName(panel.withColumn("day", F.lit("2000-01-30"))), "month_id", "day")
