"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between two of these is a word.
WORD_BREAK = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (as in tests) that names none gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelyard-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there.

    It goes at the end of the innermost passing_tables(). For loops: unlike a checkpoint, the table has the size that its files have. A checkpoint carries the estimate of
    its plan along, and estimates of joins multiply, so after some rounds of joins they fill the driver.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _tables:
        _tables[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of written() tables, for each open passing_tables().
_tables: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are written() inside are removed at the end: what is needed after it must not read them."""
    _tables.append([])
    try:
        yield
    finally:
        for path in _tables.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that was written to the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[str]:
    """A path in the shared folder for a table; what is there goes at the end."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def slices(batch: pa.RecordBatch, text: int, most_rows: int, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most most_rows rows and, but for single longer ones, most_bytes of column ``text``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        room = (int(ends[at - 1]) if at else 0) + most_bytes
        stop = max(at + 1, min(at + most_rows, int(np.searchsorted(ends, room, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to differ from every column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


#: Bytes of a table of fixed-width rows up to which a join may broadcast it.
BROADCAST_BYTES = 32 << 20


def small(rows: DataFrame) -> DataFrame:
    """rows with a broadcast hint if their counted size is below BROADCAST_BYTES, else as it is, so that the join shuffles.

    The columns must have a bounded width: numbers, digests, ids. Strings and binaries count with their bytes.
    """
    wide = [c for c, kind in rows.dtypes if kind in ("string", "binary")]
    size = F.lit(16 * len(rows.columns) + 32) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(0))
    total = rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows
