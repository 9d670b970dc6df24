"""Exact deduplication over content-defined chunk recipes.

A text is cut where a hash of its last bytes has a given pattern, so equal passages are cut alike wherever
they stand. Each chunk gets an identifier that is verified on the chunk's bytes; a document becomes the
ordered list of its chunk identifiers (its recipe), and from then on only recipes are grouped and joined.
The text itself moves through one shuffle at most, in which equal chunks have already met map-side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm._common import cut_lineage, free_name, slices, small

#: Multiplier of the byte-window hash: a fixed odd 32-bit number (2^32 divided by the golden ratio).
_MIX = 2654435761
_WINDOW = 16


def cut_points(data: bytes, mean: int, least: int, most: int) -> list[int]:
    """Ends of the content-defined chunks of data; the last is len(data). Empty data has no chunk."""
    n = len(data)
    if n == 0:
        return []
    if n <= least:
        return [n]
    b = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    # sum of byte * 2^k over the window: old bytes leave at the top, as in a shift-register hash
    h = b.copy()
    span = 1
    while span < _WINDOW:
        older = h[:-span] << np.uint32(span)
        h[span:] += older
        span *= 2
    marks = np.flatnonzero(((h * np.uint32(_MIX)) >> np.uint32(8)) % np.uint32(mean) == 0) + 1
    ends, start = [], 0
    for end in marks.tolist():
        while end - start > most:
            start += most
            ends.append(start)
        if end - start >= least and end < n:
            ends.append(end)
            start = end
    while n - start > most:
        start += most
        ends.append(start)
    ends.append(n)
    return ends


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = 4096, least: int = 1024, most: int = 32768) -> DataFrame:
    """One row per document: id, recipe (16 bytes of identifier per chunk, in order), sha256 of the text, its chunks.

    A null text counts as empty: no chunk, the empty recipe.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, 1024)):
            recipes, hashes, parts = [], [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                start, recipe, own = 0, [], []
                for end in cut_points(data, mean, least, most):
                    part = data[start:end]
                    recipe.append(xxhash.xxh3_128_digest(part))
                    own.append(part)
                    start = end
                recipes.append(b"".join(recipe))
                hashes.append(hashlib.sha256(data).hexdigest())
                parts.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(recipes, pa.binary()), pa.array(hashes, pa.string()), pa.array(parts, pa.list_(pa.binary()))],
                names=["id", "recipe", "text_sha256", "parts"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type}, recipe binary, text_sha256 string, parts array<binary>")


def colliding_identifiers(chunked: DataFrame) -> DataFrame:
    """Verify identifiers on content: identifiers (column ``chunk``) that stand for more than one content.

    Equal chunks of one task meet before the shuffle, so a passage that a third of the documents share
    crosses it once per task.
    """
    pairs = chunked.select(F.posexplode("parts").alias("pos", "content"), "recipe").select(
        F.expr("substring(recipe, pos * 16 + 1, 16)").alias("chunk"), "content"
    )
    return pairs.distinct().groupBy("chunk").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("chunk")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Group documents with identical texts.

    Returns one row per input row: id_col, keep_id (largest id of the group), group_size, kept, text_sha256.
    Null text counts as empty text; empty texts are equal to each other. A null id is smaller than any other:
    it is kept only where all ids of its group are null. Rows that repeat the kept id are all marked kept.
    Columns other than the two named are not read. An empty table gives an empty result.
    """
    return grouped(chunks(docs, id_col, text_col, **sizes), id_col)


def grouped(chunked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """exact_duplicates() of the rows of chunks(): verify identifiers, then compare recipes."""
    clashes = cut_lineage(colliding_identifiers(chunked))
    # texts are cut a second time for the recipes: that costs less than to write and read every chunk in between
    recipes = chunked.select("id", "recipe", "text_sha256")
    if not clashes.isEmpty():  # two contents under one 128-bit identifier: such documents are told apart by their whole text's sha256 too
        bad = clashes.select(F.col("chunk").alias("c"))
        hit = chunked.select("id", "recipe", "text_sha256", F.posexplode("parts").alias("pos", "content")).select(
            "recipe", F.expr("substring(recipe, pos * 16 + 1, 16)").alias("c")
        ).join(bad, "c", "left_semi").select("recipe").distinct().withColumn("clash", F.lit(True))
        recipes = recipes.join(hit, "recipe", "left").select(
            "id", F.when(F.col("clash"), F.concat("recipe", F.col("text_sha256").cast("binary"))).otherwise(F.col("recipe")).alias("recipe"), "text_sha256"
        )
    recipes = cut_lineage(recipes)
    groups = cut_lineage(recipes.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    return recipes.join(groups, "recipe", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("id").eqNullSafe(F.coalesce("keep_id", "id")), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """The rows of docs, all columns, whose document exact_duplicates() keeps; of a row repeated with id and text, one.

    Null texts count as empty and are equal to each other; of such rows with one null id one stays. Columns may have
    any names.
    """
    i, d, r = (free_name(docs, x) for x in ("judged_id", "judged_digest", "judged_rows"))
    short = lambda sha: F.unhex(F.substring(sha, 1, 32))  # noqa: E731  16 bytes of it tell texts with one id apart
    judged = exact_duplicates(docs, id_col, text_col, **sizes).select(F.col(id_col).alias(i), F.col("kept").alias(r), short(F.col("text_sha256")).alias(d))
    same = docs[id_col].eqNullSafe(F.col(i)) & (short(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)) == F.col(d))
    dropped = cut_lineage(judged.filter(~F.col(r)).select(i, d).distinct())
    repeated = cut_lineage(judged.filter(r).groupBy(i, d).agg(F.count(F.lit(1)).alias(r)).filter(F.col(r) > 1).drop(r))
    left = docs.join(small(dropped), same, "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(small(repeated), same, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(small(repeated), same, "left_anti").unionByName(once)
