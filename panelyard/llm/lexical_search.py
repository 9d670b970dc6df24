"""Ranked lexical search by MaxScore, shard by shard.

``build_index`` cuts the documents into shards of bounded size and writes an inverted index for each: a row with the
shard's documents, their lengths, its terms and, one after the other, the postings of each term. ``search`` scores a
set of items against every shard. In a shard the terms of an item are ordered by upper bound. As long as documents
that hold only the terms still to come can reach the threshold (the k-th best score so far), a term is essential: its
postings are added up. The terms after that are non-essential: they are looked up for documents found before only,
and these drop out as soon as the bounds of what is left cannot take them to the threshold. A task carries its best
scores from shard to shard, so the threshold is high after the first one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm._common import ascii_lower, cut_lineage, slices, small, temporary

#: Terms: letters and digits of ASCII and all other characters, A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else i if i >= 128 else 32 for i in range(256))

#: Columns of an index beside the documents' ids.
_POSTINGS = "n_docs long, n_terms long, lengths array<long>, terms array<string>, doc_counts array<int>, docs array<int>, counts array<int>"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.encode().translate(_BYTES).split()


class _Codes(dict):
    """term -> its number, in order of first sight."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _shard(ids: list[pa.Array], texts: list[str], id_type: pa.DataType) -> pa.RecordBatch | None:
    """One row of the index for some documents; None if none of them has a term."""
    codes = _Codes()
    found = [np.fromiter(map(codes.__getitem__, terms_of(t)), np.int64) for t in texts]
    lengths = np.array([len(x) for x in found], np.int64)
    some = np.flatnonzero(lengths)
    if not len(some):
        return None
    own = np.arange(len(some))
    keys, counts = np.unique(np.concatenate([found[i] for i in some]) * len(some) + np.repeat(own, lengths[some]), return_counts=True)
    term, doc = np.divmod(keys, len(some))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    arrays = [
        pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.concat_arrays(ids).cast(id_type).take(pa.array(some))),
        pa.array([len(some)], pa.int64()),
        pa.array([int(lengths.sum())], pa.int64()),
        one(lengths[some], pa.int64()),
        one([t.decode() for t in codes], pa.string()),
        one(np.bincount(term, minlength=len(codes)).astype(np.int32), pa.int32()),
        one(doc.astype(np.int32), pa.int32()),
        one(counts.astype(np.int32), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["ids", "n_docs", "n_terms", "lengths", "terms", "doc_counts", "docs", "counts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 2048, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per shard: ids, n_docs, n_terms, lengths, terms, doc_counts, docs and counts (postings, by term then document).

    A shard has at most shard_docs documents and, but for a single longer one, shard_bytes of text. Documents without a
    term (also null and empty texts) are not in the index. Every other row is a document of its own, whatever its id.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, kind = [], [], 0, None
        for part in (p for batch in batches for p in slices(batch, 1, 256, shard_bytes // 8)):
            kind, own = part.schema.field(0).type, part.column(1)
            more = pc.sum(pc.fill_null(pc.binary_length(own), 0)).as_py() or 0
            if texts and (len(texts) + part.num_rows > shard_docs or size + more > shard_bytes):
                if (row := _shard(ids, texts, kind)) is not None:
                    yield row
                ids, texts, size = [], [], 0
            ids.append(part.column(0))
            texts += [t or "" for t in own.to_pylist()]
            size += more
        if texts and (row := _shard(ids, texts, kind)) is not None:
            yield row

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"ids array<{id_type}>, {_POSTINGS}")


def _best(n_docs: int, terms: list[tuple[int, np.ndarray, np.ndarray]], threshold: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that can be among the k best; terms: (upper bound, documents ascending, scores), highest bound first.

    A document whose score is below the threshold, or below k others found here, may be left out.
    """
    rest = np.concatenate((np.cumsum([b for b, _, _ in terms][::-1])[::-1], [0])).tolist()
    total, essential = np.zeros(n_docs, np.int64), 0
    for bound, docs, scores in terms:
        if threshold > rest[essential]:
            break
        total[docs] += scores
        essential += 1
        if n_docs >= k:
            threshold = max(threshold, int(np.partition(total, n_docs - k)[n_docs - k]))
    found = np.flatnonzero((total > 0) & (total + rest[essential] >= threshold))
    score = total[found]
    for i in range(essential, len(terms)):
        if not len(found):
            break
        _, docs, scores = terms[i]
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        score += np.where(docs[at] == found, scores[at], 0)
        if len(found) >= k:
            threshold = max(threshold, int(np.partition(score, len(score) - k)[len(score) - k]))
        keep = score + rest[i + 1] >= threshold
        found, score = found[keep], score[keep]
    return found, score


def _scored(index: DataFrame, items: list[list[tuple[int, int]]], terms: list[str], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """number (of the item), id, score: the k best documents of each task for every item, which is a list of (term number, weight)."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast((items, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms = shared.value
        wanted = pa.array(terms, pa.string())
        best: list[list[tuple[int, bool, object]]] = [[] for _ in items]
        kind = None
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            ids, lengths, own_terms, doc_counts, docs, counts = (c.flatten() for c in row.columns)
            kind = ids.type
            docs, counts, doc_counts = (np.asarray(c, np.int64) for c in (docs, counts, doc_counts))
            m = 75 + 25 * np.asarray(lengths, np.int64) * n_docs // n_terms
            part = 1_000_000_000 * counts // (1000 * counts + 12 * m[docs])
            stops = np.cumsum(doc_counts)
            starts = stops - doc_counts
            most = np.maximum.reduceat(part, starts)
            place = np.asarray(pc.fill_null(pc.index_in(wanted, value_set=own_terms), -1), np.int64)
            for number, item in enumerate(items):
                here = sorted(((w * int(most[p]), w, p) for t, w in item if (p := place[t]) >= 0), reverse=True)
                listed = [(b, docs[starts[p] : stops[p]], w * part[starts[p] : stops[p]]) for b, w, p in here]
                old = best[number]
                threshold = -old[-1][0] if len(old) == k else 1
                found, score = _best(len(lengths), listed, threshold, k)
                good = score >= threshold
                if good.any():
                    named = ids.take(pa.array(found[good])).to_pylist()
                    best[number] = sorted([*old, *((-s, d is None, d) for s, d in zip(score[good].tolist(), named, strict=True))], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:k]
        rows = [(i, d, -s) for i, found in enumerate(best) for s, _, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["number", "id", "score"])

    return index.select("ids", "lengths", "terms", "doc_counts", "docs", "counts").mapInArrow(run, f"number int, id {id_type}, score long")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({TERM})"), F.lit(1))


def search(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", most_terms: int = 200_000) -> DataFrame:
    """The k best documents of the index for each item: item_col, rank (from 1), doc_id, score.

    A document's score is the sum over the item's terms, repeats included, of w * (10^9 tf div (1000 tf + 12 m)) with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 75 + 25 n N div L, in whole numbers but for w. N and L count the
    documents and terms of the index, n a document's terms, df the documents with the term, tf its occurrences there.
    Documents with score 0 are no result; equal scores come by ascending id, a null id last.

    most_terms: items are searched in blocks of about so many (item, term) pairs; a block is what the driver and each
    task hold, so its size does not grow with the items. Rows that share an item id are one item. An item without a
    term has no result. Other columns are not read. An empty index or no items give an empty result.
    """
    spark = index.sparkSession
    id_type, item_type = index.schema["ids"].dataType.elementType.simpleString(), items.schema[item_col].dataType.simpleString()
    of_items = items.select(F.col(item_col).alias("item"), F.explode(_terms(F.coalesce(text_col, F.lit("")))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    of_items = cut_lineage(of_items)
    n_pairs = of_items.count()
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    empty = spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, doc_id {id_type}, score long")
    if not n_pairs or not n_docs:
        return empty
    held = index.select(F.inline(F.arrays_zip("terms", "doc_counts"))).withColumnRenamed("terms", "term")
    held = held.join(small(of_items.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("doc_counts").alias("df"))
    blocks = -(-n_pairs // most_terms)
    weighed = cut_lineage(of_items.join(held, "term").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))))
    found = None
    for block in range(blocks):
        rows = weighed.filter(F.col("block") == block).select("item", "term", "times", "df").collect()
        numbers: dict[object, int] = {}
        names: dict[str, int] = {}
        pairs: list[list[tuple[int, int]]] = []
        for item, term, times, df in rows:
            if (at := numbers.setdefault(item, len(numbers))) == len(pairs):
                pairs.append([])
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            pairs[at].append((names.setdefault(term, len(names)), weight * times))
        if not rows:
            continue
        top = _scored(index, pairs, list(names), n_docs, n_terms, k)
        ids = spark.createDataFrame(list(enumerate(numbers)), f"number int, item {item_type}")
        top = top.join(F.broadcast(ids), "number").drop("number")
        found = top if found is None else found.unionByName(top)
    if found is None:
        return empty
    # the best of each of some shares first: what one task gets for an item does not grow with the tasks before
    order = [F.desc("score"), F.asc_nulls_last("id")]
    shares = F.pmod(F.xxhash64("id", "score"), F.lit(16))
    first = found.withColumn("share", shares).withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).filter(F.col("rank") <= k).drop("rank", "share")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """search() over an index of docs that is written to the shared folder for this search and removed after it."""
    with temporary(docs.sparkSession) as path:
        # few rows to a row group: a reader holds one group at a time, and a row may have some megabytes
        build_index(docs, id_col, text_col).write.option("parquet.block.row.count.limit", 4).parquet(path)
        index = docs.sparkSession.read.parquet(path)
        return cut_lineage(search(index, items, k, **more))
