"""Near-duplicate components by MinHash with tensored banding.

Two small collections of ``side`` sub-keys are drawn for each document, a sub-key being ``width`` MinHash values.
Every pair (i, j) of a first and a second sub-key names one table, so ``side ** 2`` tables of ``2 * width`` values
cost only ``2 * side * width`` MinHash values: about the square root of what separate tables would take.
A pair of similarity s meets in some table with probability ``(1 - (1 - s ** width) ** side) ** 2``; with the
defaults that is 0.99986 at 0.85 and higher above. Every candidate is confirmed on the full shingle sets.

Inside a table's bucket no pairs are listed. In rounds, each class of equal sets is compared with one centre (a star),
that which it shares most buckets with, and components are formed; buckets whose members all have one component are
closed. Members of buckets that are open in the end are compared further by an exact join on rare shingles. So no link between components of a bucket is lost, whatever its size, and a group of copies costs about as
many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm._common import cut_lineage, free_name, passing_tables, slices, small, written

_SEED = 20_240_607
#: Sets with one shingle among their first that one task compares with all others.
_HOLDERS = 1000
#: Sets with one shingle among their first that are compared with each other; more are compared by way of a center.
_CROWD = 200


class _WordHashes(dict):
    """word -> 64-bit hash, filled as words turn up and emptied when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _forget() -> None:
    """At a task's end: a worker that is used again keeps no words."""
    _hashes.clear()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; with fewer words, of the whole sequence."""
    tokens = text.encode().lower().split() if text else []  # bytes: lower() and split() know ASCII only
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    out = h[: len(h) - size + 1]
    for k in range(1, size):
        out = _mixed(out) + h[k : len(h) - size + 1 + k]
    out = np.sort(_mixed(out + np.uint64(size)))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, side: int, width: int) -> DataFrame:
    """id, n_shingles, digest (16 bytes of the set), sig (2 * side sub-keys of 32 bits); no set: null digest and sig."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 2**63, 2 * side * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, 2 * side * width, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, 1024)):
            sizes, digests, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    sigs.append(None)
                    continue
                least = np.full(len(a), 2**64 - 1, np.uint64)
                for at in range(0, len(s), 2048):  # bounded memory however long the text
                    part = s[at : at + 2048, None] * a
                    part += b
                    part ^= part >> np.uint64(32)
                    np.minimum(least, part.min(axis=0), out=least)
                keys = np.zeros(2 * side, np.uint64)
                for k in least.reshape(2 * side, width).T:
                    keys = _mixed(keys + k)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append((keys >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                names=["id", "n", "digest", "sig"],
            )
        _forget()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type}, n long, digest binary, sig array<int>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id and its whole shingle set as bytes."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1024):
                found = [shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])
        _forget()

    return docs.mapInArrow(run, f"id {id_type}, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    id_type = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(first[i].as_buffer(), np.uint64)
                y = np.frombuffer(second[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s1"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("s2"))
    # the centre b has many pairs: its set is joined last, so it is never shuffled once per pair
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s1", "s2").mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for the nodes of links (a, b); labels spread and jump until none changes."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = written(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        labels = written(spread.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", "far").alias("label")))
        if labels.filter("old <> label").isEmpty():
            return labels.select("node", "label")


def _elements(rows: DataFrame) -> DataFrame:
    """The columns of rows without ``shingles``, the last one, then w (how many there are) and h, a row for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(part.num_columns - 1)]
                sizes = np.array([len(x) for x in own], np.int64)
                row = pa.array(np.repeat(np.arange(len(own)), sizes))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in part.columns[:-1]), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(own))], names=[*part.schema.names[:-1], "w", "h"])

    kept = [f"{c} {kind}" for c, kind in rows.dtypes[:-1]]
    return rows.mapInArrow(run, ", ".join([*kept, "w long", "h long"]))


def _first(held: DataFrame, need: Column) -> DataFrame:
    """h, id, label, n, w, room of the elements h at which a set can meet another of its center that it has ``need`` in common with.

    held: center, id, label, n, w, h. Elements are ordered by how many of the sets hold them, rarest first. Two sets
    with ``need`` common ones share one of their first ``w - need + 1``; room is how many are left from h on. Elements
    that one set alone holds fill the first places and join nothing, so sets with many edits of their own drop out.
    """
    counts = cut_lineage(held.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).filter("f > 1"))
    shared = held.join(counts, "h")
    by_set = Window.partitionBy("center", "id", "n", "w")
    place = F.row_number().over(by_set.orderBy("f", "h")) + F.col("w") - F.count(F.lit(1)).over(by_set)
    first = shared.withColumn("place", place).filter(F.col("place") <= F.col("w") - need + 1)
    return cut_lineage(first.filter("low <> high").select("h", "id", "label", "n", "w", (F.col("w") - F.col("place") + 1).alias("room")))


def _first_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """_first() for the whole sets of nodes (id, label)."""
    held = _elements(nodes.join(sets, "id").select("id", "label", "shingles")).withColumn("n", F.col("w"))
    return _first(held.withColumn("center", F.lit(None).cast(nodes.schema["id"].dataType)), F.ceil(F.col("n") * percent / 100))


def _met(first: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, labels one and two) of sets with different labels that meet in first and have room there for percent.

    Sets of n_a and n_b shingles reach the similarity if they differ in ``(n_a + n_b) * (100 - percent) / (100 + percent)``
    shingles at most. What they hold of w_a and w_b elements differs in the same, so they share half of the rest.
    """
    # an element that stands first in many sets is dealt out: each of its sets to one share, to be met there by all
    shares = F.ceil(F.col("holders") / F.lit(_HOLDERS)).cast("int")
    often = cut_lineage(first.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") > _HOLDERS).select("h", shares.alias("shares")))
    first = first.join(small(often), "h", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    x, y = (first.select("h", "shares", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "label", "n", "w", "room")]) for k in "ab")
    x = x.withColumnRenamed("id_a", "a").withColumn("share", F.pmod(F.xxhash64("a"), "shares").cast("int")).drop("shares")
    y = y.withColumnRenamed("id_b", "b").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    fits = (
        (F.col("a") > F.col("b"))
        & (F.col("label_a") != F.col("label_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (F.least("room_a", "room_b") * (2 * (100 + percent)) >= (F.col("w_a") + F.col("w_b")) * (100 + percent) - (F.col("n_a") + F.col("n_b")) * (100 - percent))
    )
    return x.join(y, ["h", "share"]).filter(fits).select("a", "b", F.col("label_a").alias("one"), F.col("label_b").alias("two")).distinct()


def _pairs_by_prefix(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes (id, label) with different labels whose sets can reach percent, by prefix filtering."""
    return _met(_first_shingles(nodes, sets, percent), percent)


def _crowds(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The elements (h) that more than _CROWD sets hold among their first; id and center of the sets that hold them.

    The center of an element is that of its sets which meets most others: a copy with few edits of its own.
    """
    often = cut_lineage(first.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") > _CROWD))
    held = first.join(small(often), "h").select("h", "id", "holders")
    held = held.join(held.groupBy("id").agg(F.sum("holders").alias("meets")), "id")
    center = held.groupBy("h").agg(F.max(F.struct("meets", "id"))["id"].alias("center"))
    return often.select("h"), written(held.join(small(center), "h").select("id", "center").distinct())


def _differences(around: DataFrame, sets: DataFrame) -> DataFrame:
    """center, id, label, n, w, h: for each row of around (id, center, label) where its set differs from the center's."""
    kinds = {f.name: f.dataType.simpleString() for f in around.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(3)]
            differ = [np.setxor1d(x, np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True).tobytes() for x, y in zip(own, batch.column(4), strict=True)]
            sizes = pa.array([len(x) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, pa.array(differ, pa.binary())], names=["center", "id", "label", "n", "shingles"])

    centers = sets.join(around.select(F.col("center").alias("id")).distinct(), "id").select(F.col("id").alias("center"), F.col("shingles").alias("middle"))
    both = around.join(sets, "id").join(small(centers), "center").filter(F.col("id") != F.col("center")).select("center", "id", "label", "shingles", "middle")
    differ = both.mapInArrow(run, f"center {kinds['center']}, id {kinds['id']}, label {kinds['label']}, n long, shingles binary")
    return _elements(differ).withColumn("h", F.xxhash64("center", "h"))


def _settled(labels: DataFrame, rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """labels (rep, label) with those made one that any link between nodes of rest (id, label) connects.

    Sets that share a first shingle with at most _CROWD others are compared with those. The sets of a larger crowd are
    compared with its center. Two that it leaves apart have in common more than nothing of what each differs in from
    the center: they meet by prefix filtering over the differences, where copies with edits of their own drop out.
    """
    first = _first_shingles(rest, sets, percent)
    crowded, around = _crowds(first)
    if not around.isEmpty():
        of = rest.select(F.col("id").alias("center"), F.col("label").alias("two"))
        stars = around.join(rest, "id").join(of, "center").filter("label <> two").select(F.col("id").alias("a"), F.col("center").alias("b"), F.col("label").alias("one"), "two")
        moved, first = _joined(labels.select("rep", "label"), first, written(stars), sets, percent)
        around = around.join(moved.select(F.col("rep").alias("id"), "label"), "id")
        apart = around.groupBy("center").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("center")
        around = written(around.join(small(apart), "center", "left_semi").select("id", "center", "label"))
        need = F.greatest(F.lit(1), F.col("w") - F.floor(F.col("n") * (100 - percent) / percent))
        pairs = _met(_first(_differences(around, sets), need), percent)
        pairs = written(pairs.unionByName(_met(first.join(small(crowded), "h", "left_anti"), percent)).distinct())
        labels = moved
    else:
        pairs = written(_met(first, percent))
    return _joined(labels, first, pairs, sets, percent)[0]


def _open(at: DataFrame) -> DataFrame:
    """The buckets (key) with members of several labels, and their centre (least rep) with its label."""
    by_key = at.groupBy("key").agg(F.min("rep").alias("center"), F.min_by("label", "rep").alias("center_label"), F.min("label").alias("low"), F.max("label").alias("high"))
    return by_key.filter("low <> high").select("key", "center", "center_label")


def _untried(at: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of a member and its bucket's centre (a, b) with different labels (one, two), in how many buckets, that are not among tried."""
    pairs = at.filter("label <> center_label").groupBy(F.col("rep").alias("a"), F.col("center").alias("b")).agg(
        F.count(F.lit(1)).alias("buckets"), F.min("label").alias("one"), F.min("center_label").alias("two"), F.lit(False).alias("old")
    )
    both = pairs.unionByName(tried.withColumn("old", F.lit(True)), allowMissingColumns=True)
    found = both.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("buckets", "one", "two", "old")])
    return found.filter("not old").drop("old")


def _joined(labels: DataFrame, at: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """labels (rep, label) and at (key, rep, label) with those labels made one that a confirmed pair (a, b, labels one and two) connects."""
    found = written(_confirmed(pairs.select("a", "b"), sets, percent))
    if found.isEmpty():
        return labels, at
    links = found.join(pairs, ["a", "b"]).select(F.col("one").alias("a"), F.col("two").alias("b")).distinct()
    moved = small(components(written(links)).select(F.col("node").alias("label"), F.col("label").alias("to")))
    return tuple(written(x.join(moved, "label", "left").select(*[c for c in x.columns if c != "label"], F.coalesce("to", "label").alias("label"))) for x in (labels, at))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, side: int = 12, width: int = 3, rounds: int = 3
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    words: words per shingle (a text with fewer is one shingle). side, width: see the module; side 12 with width 3
    finds 0.9996 of the pairs at similarity 0.8, and what the stars of a bucket leave open is settled exactly.
    rounds: of stars; in each but the last a class is compared with one centre, in the last with all that are left.

    Returns one row per input row: id_col, n_shingles, component_id (smallest id reachable), kept (id = component_id).
    Null, empty and blank texts have no shingle and are linked with nothing. A row with a null id is linked with
    nothing and kept, its component_id is null. Rows that repeat an id are one node of the graph; each is
    judged by its own text. Very long texts are read whole. Columns other than the two named are not read. An empty table gives an empty result.
    """
    sketched = cut_lineage(sketches(docs, id_col, text_col, words, side, width))
    with passing_tables(docs.sparkSession):  # what stays is checkpointed
        some = sketched.filter("id is not null and n > 0")
        classes = cut_lineage(some.groupBy("digest", "n", "sig").agg(F.min("id").alias("rep")))
        # a class joins a table's bucket with others only if it shares both sub-keys of the pair: most share none
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        single = classes.select("rep", "sig").repartition(parts, "rep").select("rep", F.posexplode("sig").alias("i", "x"))
        single = single.select("rep", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("x").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("k"))
        common = single.groupBy("k").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("k")
        held = single.join(cut_lineage(common), "k", "left_semi").groupBy("rep").agg(F.collect_list("k").alias("k"))  # 2 * side at most
        of = lambda test: F.filter("k", lambda k: test(F.shiftright(k, 32)))
        pairs = F.flatten(F.transform(of(lambda i: i < side), lambda x: F.transform(of(lambda i: i >= side), lambda y: F.xxhash64(x, y))))
        keyed = cut_lineage(held.select("rep", F.explode(pairs).alias("key")))
        shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("key")
        at = written(keyed.join(cut_lineage(shared), "key", "left_semi").withColumn("label", F.col("rep")))
        labels = written(at.select("rep", "label").distinct())
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        sets = cut_lineage(_sets(texts.join(small(labels.select(F.col("rep").alias("id"))), "id", "left_semi"), words))
        tried = labels.limit(0).select(F.col("rep").alias("a"), F.col("label").alias("b"))
        for k in range(rounds):
            at = written(at.join(_open(at), "key").select("key", "rep", "label", "center", "center_label"))
            pairs = written(_untried(at, tried))
            if pairs.isEmpty():
                break
            if k < rounds - 1:
                pairs = written(pairs.groupBy("a").agg(F.max(F.struct("buckets", "b", "one", "two")).alias("best")).select("a", "best.b", "best.one", "best.two"))
            labels, at = _joined(labels, at.select("key", "rep", "label"), pairs, sets, percent)
            tried = written(tried.unionByName(pairs.select("a", "b")))
        rest = written(at.join(_open(at).select("key"), "key", "left_semi").select(F.col("rep").alias("id"), "label").distinct())
        if not rest.isEmpty():  # what the stars leave open is settled for all pairs
            labels = _settled(labels, rest, sets, percent)
        labels = labels.select(F.col("rep").alias("node"), "label")
        of_class = classes.select("digest", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
        of_class = cut_lineage(of_class)
    judged = sketched.filter("n > 0").join(of_class, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component"))
    blank = sketched.filter("n = 0").select("id", "n", F.col("id").alias("component"))  # no digest, no partner: they do not meet in a join
    return judged.unionByName(blank).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, **more: int) -> DataFrame:
    """The rows of docs, all columns, with one document of each component of near_duplicates(): that with the smallest id.

    Rows that repeat that id all stay: tell them apart by an exact deduplication before. Null ids and texts without a
    word stay. Columns may have any names.
    """
    judged = near_duplicates(docs, id_col, text_col, words, percent, **more)
    name = free_name(docs, "dropped_id")
    dropped = cut_lineage(judged.filter(~F.col("kept")).select(F.col(id_col).alias(name)).distinct())
    return docs.join(small(dropped), docs[id_col] == F.col(name), "left_anti")
