"""Packing of token sequences by large-item matching and best fit.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` rows whatever the input: pieces
above a third of the capacity can stand at most twice in a sequence and are matched greedily, largest first, each
with the largest partner that fits; smaller pieces then go, largest first, to the fullest sequence with room.
Each piece finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm._common import cut_lineage, slices


_CLOSING = b".,;:!?%$&*#|)"


class WordIds:
    """Token ids (little-endian unsigned 32-bit, as bytes) of words in lower-cased UTF-8, each encoded once.

    For tokenizers that lower-case, never join text across white space and split letters and digits from other
    signs. Holds the words used last, 2 * ``most`` at most: about 200 bytes each.

    plain: whether the strings of special tokens are ordinary text. Else, as in the library, they become their own ids
    wherever they stand, and texts with one must be encoded whole: see special().
    """

    def __init__(self, path: str, plain: bool = False, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = {} if plain else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        strings = [] if plain else [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, strings)), re.I).search if strings else lambda text: None
        added.pop(getattr(self.tokenizer.model, "unk_token", None), None)
        self.between = next(iter(added.items()), None)  # a string that no word holds, and its id, which no word has
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def add(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + 2 * len(new) > self.most:
            self.older, self.known = self.known, {}
            new = list(words)
        older = self.older
        missing = []
        for w in new:
            ids = older.get(w)
            if ids is None:
                missing.append(w)
            else:
                self.known[w] = ids
        cut = {}  # word -> its part before closing signs
        for w in missing:
            core = w.rstrip(_CLOSING)
            if core and core != w and core[-1:].isalnum():  # bytes: ASCII only
                cut[w] = core
        self._encode({*missing} - cut.keys() | {core for core in cut.values() if core not in self.known} | {w[len(core) :] for w, core in cut.items()})
        for w, core in cut.items():
            self.known[w] = self.known[core] + self.known[w[len(core) :]]

    def _encode(self, words: set[bytes]) -> None:
        """Ids of new words: 32 in one string, parted by the special token, as a call for each word costs more than its ids."""
        new = list(words)
        together = 32 if self.between else 1
        for at in range(0, len(new), 4096):
            groups = [new[i : i + together] for i in range(at, min(at + 4096, len(new)), together)]
            mark, mark_id = self.between or ("", -1)
            encoded = self.tokenizer.encode_batch_fast([mark.join([w.decode() for w in g]) for g in groups], add_special_tokens=False)
            for group, e in zip(groups, encoded, strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == mark_id).tolist() if mark else []
                data, at_id = ids.tobytes(), 0
                for w, cut in zip(group, [*cuts, len(ids)], strict=True):
                    self.known[w] = data[4 * at_id : 4 * cut]
                    at_id = cut + 1

    def of(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased: bytes know no other letters and blanks."""
    return text.encode().lower().split() if text else []


_word_ids: dict[tuple[str, bool, int], WordIds] = {}


def word_ids(path: str, plain: bool = False, most: int = 600_000) -> WordIds:
    """One in a worker, for the vocabulary used last, kept between tasks."""
    key = path, plain, most
    if key not in _word_ids:
        _word_ids.clear()
        _word_ids[key] = WordIds(path, plain, most)
    return _word_ids[key]


def pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 600_000
) -> DataFrame:
    """id_col, piece, start, length, ids_crc32: each document's ids and end_id, cut every capacity ids if longer.

    The ids are those of the library for the whole text, without added special tokens; strings of special tokens in a
    text become their ids there, so here too.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_path, most=cached_words)
        for batch in batches:
            for part in slices(batch, 1, 256):
                texts = [t or "" for t in part.column(1).to_pylist()]
                special = [bool(ids.special(t)) for t in texts]
                split = [[] if s else words_of(t) for t, s in zip(texts, special, strict=True)]
                ids.add(set().union(*split))
                row, piece, start, length, crc = [], [], [], [], []
                for i, ws in enumerate(split):
                    data = memoryview((ids.whole(texts[i]) if special[i] else ids.of(ws)) + end)
                    for k, a in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[a : a + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type}, piece long, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (number of sequences, [(length, copies), ...] of each) that hold every piece of the histogram.

    Works on counts, so its size depends on the capacity only.
    """
    left = dict(histogram)
    third = capacity // 3  # above it at most two pieces meet
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    order: list[int] = []  # gaps in use, ascending

    def put(gap: int, count: int, pattern: list[tuple[int, int]]) -> None:
        if count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((count, pattern))

    large = sorted((x for x in left if x > third), reverse=True)
    for x in large:
        while (n := left.get(x, 0)) > 0:
            mate = next((y for y in large if y <= x and y + x <= capacity and left[y] > (y == x)), None)
            if mate is None:
                put(capacity - x, n, [(x, 1)])
                left[x] = 0
            elif mate == x:
                put(capacity - 2 * x, n // 2, [(x, 2)])
                left[x] = n % 2
            else:
                both = min(n, left[mate])
                put(capacity - x - mate, both, [(x, 1), (mate, 1)])
                left[x] -= both
                left[mate] -= both
    for x in sorted((x for x in left if x <= third), reverse=True):
        n = left[x]
        while n > 0:
            at = bisect_left(order, x)
            if at == len(order):  # no room anywhere: new sequences, filled with copies of x
                each = capacity // x
                put(capacity - each * x, n // each, [(x, each)])
                put(capacity - (n % each) * x, 1 if n % each else 0, [(x, n % each)])
                break
            gap = order[at]
            count, pattern = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // x
            full = min(count, n // each)
            put(gap - each * x, full, [*pattern, (x, each)])
            n -= full * each
            if full < count and n > 0:  # fewer than each pieces are left: all in one sequence
                put(gap - n * x, 1, [*pattern, (x, n)])
                full += 1
                n = 0
            put(gap, count - full, pattern)
    return [g for gap in order for g in gaps[gap]]


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, copies per sequence, first sequence, offset in it), by rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for count, pattern in groups:
        offset = 0
        for length, copies in pattern:
            at = ranks.get(length, 0)
            found.setdefault(length, []).append((at, copies, sequence, offset))
            ranks[length] = at + count * copies
            offset += copies * length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in found.items()}


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 600_000
) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    cached_words: a worker keeps the ids of the words used last, twice so many at most; it changes time and memory only.

    Returns per piece: id_col, piece (from 0), start (ids of its document before it), length, ids_crc32,
    sequence_id, offset (gapless from 0 in its sequence). Null and empty texts are the one id end_id. A null or
    repeated id makes pieces like any other row. Very long texts are cut, never shortened. Columns other than the two named are not read. An empty table
    gives an empty result.
    """
    cut = cut_lineage(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, cached_words)).withColumn("part", F.spark_partition_id())
    by_part = cut_lineage(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))
    # the rank of a piece among those of its length: those in earlier partitions, then those before it in its own
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("inside", inside).join(before, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                t = table[int(x)]
                row = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                sequence[own] = row[:, 2] + (rank[own] - row[:, 0]) // row[:, 1]
                offset[own] = row[:, 3] + (rank[own] - row[:, 0]) % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"id {id_type}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
