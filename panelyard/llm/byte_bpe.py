"""Byte-level BPE encoding with a segment tree over byte positions, and decoding.

Every leaf of the tree stands for a byte position and holds the rank of the pair that starts there; every inner node
holds the smaller of its children's ranks, the left one's on a tie. The root so tells the leftmost pair of least
rank. A merge removes one position from the list of live neighbours and updates two or three leaves, each in
logarithmic time, so a run of n bytes without a break costs n log n and not n squared.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm._common import slices

_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match of the splitting pattern."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    size = 1 << max(n - 2, 0).bit_length()
    tree = [_NONE] * (2 * size)  # keys: rank * n + position, so that a plain minimum is the leftmost least rank
    find = ranks.get
    for i in range(n - 1):
        rank = find(word[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))  # start of the next live token, n at the end
    before = list(range(-1, n - 1))

    def update(leaf: int, value: int) -> None:
        k = size + leaf
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return _NONE
        rank = find(word[i : after[j]])
        return _NONE if rank is None else rank * n + i

    while tree[1] < _NONE:
        i = tree[1] % n
        gone = after[i]
        after[i] = end = after[gone]
        if end < n:
            before[end] = i
        if gone < n - 1:  # the last position has no leaf: no pair starts there
            update(gone, _NONE)
        update(i, pair(i))
        left = before[i]
        if left >= 0:
            update(left, pair(left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


class PairRanks:
    """Rank of the token that two adjacent tokens make, by their ids, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], 0)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        both = (self.byte[:, None] << 32 | self.byte[None, :]).ravel()
        self.of_bytes = self(both)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)


def merge_many(words: list[bytes], leaves: int, pairs: PairRanks) -> list[list[int]]:
    """merge() for many words of 2 to leaves + 1 bytes at once, a segment tree of so many leaves for each."""
    count, width = len(words), leaves + 1
    sizes = np.fromiter(map(len, words), np.int64, count)
    text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width).astype(np.int64)
    at = np.arange(width)
    ids = np.where(at < sizes[:, None], pairs.byte[text], -1)
    after = np.broadcast_to(at + 1, (count, width)).copy()
    before = np.broadcast_to(at - 1, (count, width)).copy()
    scale = 2 * leaves
    tree = np.full((count, 2 * leaves), _NONE)
    rank = pairs.of_bytes[text[:, :-1] << 8 | text[:, 1:]]
    tree[:, leaves:] = np.where((at[:-1] < sizes[:, None] - 1) & (rank < _NONE), rank * scale + at[:-1], _NONE)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def update(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
        k = leaves + leaf
        tree[rows, k] = value
        k = k >> 1
        while k.size and k[0]:
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            k = k >> 1

    def join(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = pairs(ids[rows, left] << 32 | ids[rows, right])
        return np.where(rank < _NONE, rank * scale + left, _NONE)

    while (rows := np.flatnonzero(tree[:, 1] < _NONE)).size:
        least = tree[rows, 1]
        i = least % scale
        gone = after[rows, i]
        end = np.minimum(after[rows, np.minimum(gone, leaves)], sizes[rows])
        ids[rows, i] = least // scale
        ids[rows, gone] = -1
        after[rows, i] = end
        inner = end < sizes[rows]
        before[rows[inner], end[inner]] = i[inner]
        some = gone < leaves  # the last position of all has no leaf
        update(rows[some], gone[some], _NONE)
        value = np.full(len(rows), _NONE)
        value[inner] = join(rows[inner], i[inner], end[inner])
        update(rows, i, value)
        left = before[rows, i]
        some = left >= 0
        update(rows[some], left[some], join(rows[some], left[some], i[some]))
    live = ids >= 0
    flat, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes texts; keeps the ids of up to ``most`` matches no longer than 65 bytes: some 50 MB at 150 bytes a match."""

    def __init__(self, path: str, pattern: str, most: int = 300_000):
        self.ranks = read_ranks(path)
        self.pairs = PairRanks(self.ranks)
        self.find = regex.compile(pattern).findall
        self.most = most
        self.known: dict[str, bytes] = {}

    def _learn(self, matches: set[str]) -> dict[str, bytes]:
        """Ids of all the matches, as 32-bit numbers: in known those that are kept, returned those that are too long for that."""
        new = [m for m in matches if m not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = list(matches)
        long: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        for m in new:
            word = m.encode()
            rank = self.ranks.get(word)
            if rank is not None:
                self.known[m] = array("i", (rank,)).tobytes()
            elif len(word) > 65:
                long[m] = array("i", merge(word, self.ranks)).tobytes()
            else:
                by_size.setdefault(max(8, 1 << (len(word) - 2).bit_length()), []).append(m)
        for leaves, own in by_size.items():
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                ids = merge_many([m.encode() for m in part], leaves, self.pairs)
                self.known.update(zip(part, (array("i", x).tobytes() for x in ids), strict=True))
        return long

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        found = [self.find(t) for t in texts]
        long = self._learn(set().union(*found))
        ids = (self.known | long if long else self.known).__getitem__
        return [np.frombuffer(b"".join(map(ids, matches)), np.int32) for matches in found]


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One in a worker, for the vocabulary used last, kept between tasks."""
    return Encoder(path, pattern)


@lru_cache(maxsize=1)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array<int>) of each text; null counts as empty, empty texts have no ids.

    One row per input row, whatever the id (null and repeated ids stay). Very long texts are encoded whole, by
    themselves. No special tokens: their strings are ordinary text. Columns other than the two named are not read. An
    empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, 512):
                ids = own.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids_col and bytes (binary) of each list of ids; null counts as no ids. An unknown id raises KeyError."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(path).__getitem__
        for batch in batches:
            values = [b"".join(map(token, ids.values.to_numpy().tolist() if ids.is_valid else ())) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], names=["id", "ids", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, ids array<int>, bytes binary").withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)
