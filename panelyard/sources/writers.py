"""Sinks. Large results stay distributed; reports are for small tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def parquet(df: DataFrame, path: str, compression: str = "zstd", partition_by: list[str] = ()) -> None:
    """Replaces the target only when all tasks are done, by Spark's commit protocol."""
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def csv(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, or, on one machine that names none, below the temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from files in the shared folder, so that partitions are the same for all its readers and outlive executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what was written to the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file, with folders made as needed."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(make(to).getParent())
    if not files.rename(make(path), make(to)):
        raise OSError(f"{path} was not moved to {to}")


def report(spark: SparkSession, text: str, path: str) -> None:
    """Write a small report (markdown(), json_lines()) as one text file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def json_lines(summary: dict) -> str:
    return json.dumps(summary, indent=2, sort_keys=True, default=str)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small result; more than most rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
