"""State that a stream carries, gates on the way of a write, counts from footers."""

import pytest
from pyspark.sql import functions as F

from panelyard.operators import quality
from panelyard.plans import overlay
from panelyard.sources import readers, writers
from panelyard.streaming import overlays


def test_stream_gives_the_rows_of_the_table_and_takes_no_month_twice(spark, tmp_path):
    wild = F.sin(F.col("id") * F.col("id") + F.hash("spec") % 7) * 0.12
    rows = spark.range(1, 61).crossJoin(spark.createDataFrame([("a",), ("b",), (None,)], "spec string"))
    rows = rows.select("spec", F.col("id").alias("month_id"), wild.alias("gross_return"), (wild - 0.001).alias("net_return"), F.when(F.col("id") % 5 > 0, 0.4).alias("turnover"), F.lit(1.6).alias("gross_exposure"))
    for batch, months in enumerate(("month_id <= 20", "month_id between 11 and 33", "month_id > 33")):  # the second one sends some months again
        rows.filter(months).coalesce(1).write.parquet(str(tmp_path / f"in/{batch}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in range(2):  # stopped and started again
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
            made = overlays.overlays(stream, ["spec"])
            made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(240)
    finally:
        spark.conf.set(key, before)
    order = ["spec", "method", "month_id"]
    tidy = lambda df: [(r["spec"], r["method"], r["month_id"], r["state"], *[round(r[c], 12) for c in ("lambda_t", "overlay_net_return", "drawdown_after")]) for r in df.orderBy(*order).collect()]
    got, want = tidy(spark.read.parquet(str(tmp_path / "out"))), tidy(overlay.overlays(rows, ["spec"]))
    assert got == want and len(want) == 360 and len({r[3] for r in want}) > 5


def test_series_survive_json():
    series = overlay.Series({"dd_speed_phase_control": overlay.Path()})
    for m in range(50):
        rows = list(series.follow({"month_id": m, "gross_return": (-1) ** m * 0.05, "net_return": (-1) ** m * 0.05, "turnover": None, "gross_exposure": None}, 0.0025, 0.02))
        assert len(rows) == 1
        again = overlay.Series.from_json(series.to_json())
        assert again == series
        series = again


def test_watched_writes_run_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(count, "id long")
    dropped = []
    path = str(tmp_path / "t")
    n = quality.written_with_count(df, lambda d: d.withColumn("x", F.col("id") * 2), lambda d: writers.parquet(d, path), lambda: dropped.append(path))
    assert n == 100 and runs.value == 100 and not dropped
    with pytest.raises(ValueError, match="100 rows became 50"):
        quality.written_with_count(df, lambda d: d.filter("id < 50"), lambda d: writers.parquet(d, path), lambda: dropped.append(path))
    assert dropped == [path]
    w = quality.Watched()
    w.unchanged(spark.range(5).select(F.col("id").alias("a"), F.when(F.col("id") > 0, F.col("id")).alias("b")), "x", "a", "b").count()
    with pytest.raises(ValueError, match="changed"):
        w.require_unchanged("x")


def test_footer_counts_read_no_column(spark, sf_dir):
    df = readers.footer_counts(spark, {"orders": f"{sf_dir}/orders.parquet"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert df.first()["n_rows"] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
