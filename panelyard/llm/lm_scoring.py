"""Language-model scores: a causal self-attention model trained in numpy on subword ids, beside a unigram base.

A text's subword ids are read in windows of ``2 * HALF`` inputs that overlap by half; a window scores its second half,
so each id is scored once and sees HALF to 2 * HALF - 1 ids before it. All windows of some hundred texts go through
together, with one mask. Each id has an embedding; one masked self-attention layer and a residual make the context,
and the next id's probability is a product of yes-or-no decisions along its path in a Huffman tree of all ids
(hierarchical softmax): every decision depends on the context, and probabilities sum to one exactly.

Nothing is sampled. Word counts, subword counts, the tree and its starting biases (which give the unigram
probabilities) come from all training texts. The weights are then trained on every window of every training text: the
texts are dealt into rounds; in a round each task goes once over its windows, from the weights that the round before
ended with, and the changes of all tasks are averaged row by row, weighted by how often the task used the row.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm._common import cut_lineage, slices
from panelyard.llm.packing import WordIds, word_ids, words_of

HALF = 32
_LOG10E = math.log10(math.e)


class Tree:
    """A Huffman tree over ids: the inner nodes on each id's path, and at each the side (+1 or -1) that the id lies on."""

    def __init__(self, counts: np.ndarray, top: int = 63):
        """counts: of each id; half an occurrence is added, so every id has a path.

        The ``top`` nodes that lie on most paths are held apart, with the side of every id at each (0 where its path
        does not go), so that decisions at them are matrix products. ``top_at`` and ``top_own`` are the same as lists:
        each id's places among them and sides, filled up with the place after the last and 0.
        """
        n = len(counts)
        heap = [(float(c) + 0.5, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side, mass = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8), np.zeros(2 * n - 1)
        mass[:n] = counts + 0.5
        for node in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            side[i], side[j], mass[node] = -1, 1, a + b
            heapq.heapreplace(heap, (a + b, node))
        owners, nodes, sides = [], [], []
        at = owner = np.arange(n)
        while len(at) and n > 1:
            up = parent[at]
            owners.append(owner)
            nodes.append(up - n)
            sides.append(side[at])
            inner = up != 2 * n - 2
            at, owner = up[inner], owner[inner]
        self.top = np.sort(np.argsort(-mass[n:], kind="stable")[:top])
        place = np.full(n - 1, -1)
        place[self.top] = np.arange(len(self.top))
        owner, node, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, nodes, sides))
        high = place[node] >= 0
        self.top_sides = np.zeros((n, len(self.top)), np.int8)
        self.top_sides[owner[high], place[node[high]]] = own[high]
        many = np.count_nonzero(self.top_sides, axis=1)
        self.top_at = np.full((n, int(many.max())), len(self.top), np.int16)
        self.top_own = np.zeros(self.top_at.shape, np.float32)
        ids, at = np.nonzero(self.top_sides)
        rank = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
        self.top_at[ids, rank], self.top_own[ids, rank] = at, self.top_sides[ids, at]
        self.top_spare = self.top_at.shape[1] - many
        owner, node, own = owner[~high], node[~high], own[~high]
        order = np.argsort(owner, kind="stable")
        self.nodes, self.sides = node[order].astype(np.int32), own[order].astype(np.float32)
        self.lengths = np.bincount(owner, minlength=n)
        self.depths = self.lengths.astype(np.uint8)  # a path is as long only as counts of ids double along it
        self.starts = np.cumsum(self.lengths) - self.lengths
        yes = np.zeros(n - 1)
        yes[parent[:-1][side[:-1] == 1] - n] = mass[:-1][side[:-1] == 1]
        self.bias = np.log(yes / (mass[n:] - yes)).astype(np.float32)

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the ids' decisions below the top, one id after the other: node, side, which id it belongs to."""
        lengths = self.lengths[ids]
        first = np.cumsum(lengths) - lengths
        at = np.repeat(self.starts[ids] - first, lengths) + np.arange(int(lengths.sum()))
        return self.nodes[at], self.sides[at], np.repeat(np.arange(len(ids)), lengths)


def _one_and_odds(z: np.ndarray) -> np.ndarray:
    """1 + exp(-z), one over the chance of z, in the place of z."""
    np.negative(z, out=z)
    np.minimum(z, 30, out=z)
    np.maximum(z, -30, out=z)
    np.exp(z, out=z)
    z += 1
    return z


class Decisions(NamedTuple):
    """The decisions on some ids' paths, ids with long paths first, so that each level below the top is a run of the first.

    own: contexts, with a 1 behind; order: where each stood. top, below: one over each decision's chance; top_sides is 0
    where a list of top nodes is filled up. below, nodes, sides and weights hold one level after the other; of each
    level, levels has the number of ids.
    """

    own: np.ndarray
    order: np.ndarray
    head: np.ndarray
    top: np.ndarray
    top_at: np.ndarray
    top_sides: np.ndarray
    spare: np.ndarray
    below: np.ndarray
    nodes: np.ndarray
    sides: np.ndarray
    weights: np.ndarray
    levels: list[int]

    def logs(self) -> np.ndarray:
        """Natural log probability of each id, in the order that they were given in."""
        sums = self.spare * math.log(2) - np.log(self.top.prod(axis=1, dtype=np.float64))
        at = 0
        low = np.log(self.below)
        for n in self.levels:
            sums[:n] -= low[at : at + n]
            at += n
        out = np.empty_like(sums)
        out[self.order] = sums
        return out


class Attention:
    """Embeddings, one layer of causal self-attention with a bias by distance, decision vectors of the tree's nodes."""

    def __init__(self, tree: Tree, ids: int, dims: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.tree, self.dims = tree, dims
        near = -0.1 * np.arange(2 * HALF)
        self.p = {  # the last row of E is the start of a text; N's last column is the bias
            "E": draw(0.5, ids + 1, dims), "N": np.concatenate((draw(0.02, ids - 1, dims), tree.bias[:, None]), axis=1),
            "Q": draw(0.5 / math.sqrt(dims), dims, dims), "K": draw(0.5 / math.sqrt(dims), dims, dims), "V": draw(0.5 / math.sqrt(dims), dims, dims), "R": near.astype(np.float32),
        }
        self.back = np.arange(HALF)[:, None] + HALF - np.arange(2 * HALF)[None, :]  # how far a key lies before a query

    def bias(self) -> np.ndarray:
        return np.where(self.back >= 0, self.p["R"][np.maximum(self.back, 0)], np.float32(-1e9)).astype(np.float32)

    def tables(self) -> dict[str, np.ndarray]:
        """Queries, keys and values of each id."""
        p = self.p
        return {"E": p["E"], "q": p["E"] @ p["Q"] * np.float32(1 / math.sqrt(self.dims)), "k": p["E"] @ p["K"], "v": p["E"] @ p["V"], "bias": self.bias()}

    @staticmethod
    def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values' mean by attention, and the attention as weights and their sums, which no mean divides by twice.

        The row maximum is subtracted only where it could be so large or small that weights overflow or vanish.
        """
        a = q @ k.transpose(0, 2, 1)
        most = bias.max(axis=1)
        plain = not a.size or (a.max() + most.max() < 60 and a.min() + most.min() > -60)
        a += bias
        if not plain:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        sums = (a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], a.dtype)).reshape(*a.shape[:2], 1)
        mean = a @ v
        mean /= sums
        return mean, a, sums

    @staticmethod
    def contexts(tables: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the model knows after each input of the second halves (windows, HALF, dims), and the attention."""
        late = inputs[:, HALF:]
        y, a, sums = Attention.attend(tables["q"].take(late, 0), tables["k"].take(inputs, 0), tables["v"].take(inputs, 0), tables["bias"])
        y += tables["E"].take(late, 0)
        a /= sums
        return y, a

    def decisions(self, y: np.ndarray, ids: np.ndarray) -> Decisions:
        """The decisions on the ids' paths, for contexts y."""
        tree, p = self.tree, self.p["N"]
        order = np.argsort(~tree.depths.take(ids), kind="stable")
        ids = ids.take(order)
        own = np.ones((len(ids), p.shape[1]), p.dtype)
        own[:, :-1] = y.take(order, 0)
        head = np.concatenate((p.take(tree.top, 0), np.zeros((1, p.shape[1]), p.dtype)))
        top_at = tree.top_at.take(ids, 0) + np.arange(len(ids))[:, None] * len(head)
        top_sides = tree.top_own.take(ids, 0)
        z = (own @ head.T).take(top_at)
        z *= top_sides
        levels = (len(ids) - np.cumsum(np.bincount(tree.lengths.take(ids))))[:-1].tolist()
        starts = tree.starts.take(ids)
        at = np.concatenate([starts[:n] + k for k, n in enumerate(levels)] or [starts[:0]])
        nodes, sides = tree.nodes.take(at), tree.sides.take(at)
        weights = p.take(nodes, 0)
        low = np.concatenate([own[:n] for n in levels] or [own[:0]])
        low *= weights
        low = low @ np.ones(p.shape[1], p.dtype)
        low *= sides
        return Decisions(own, order, head, _one_and_odds(z), top_at, top_sides, tree.top_spare.take(ids), _one_and_odds(low), nodes, sides, weights, levels)

    def log10_probabilities(self, tables: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 probability of each target (windows, HALF), 0 where a target is below 0."""
        y, _ = self.contexts(tables, inputs)
        some = targets >= 0
        out = np.zeros(targets.shape)
        if some.any():
            out[some] = self.decisions(y[some], targets[some]).logs() * _LOG10E
        return out


class Learner:
    """Adagrad over windows, row by row for embeddings and nodes; remembers where it began."""

    def __init__(self, model: Attention, rate: float = 0.2):
        self.model, self.rate = model, rate
        self.began = {k: v.copy() for k, v in model.p.items()}
        self.sums = {k: np.full(len(v) if k in "EN" else v.shape, 1e-6, np.float32) for k, v in model.p.items()}
        self.used = {"E": np.zeros(len(model.p["E"]), np.float32), "N": np.zeros(len(model.p["N"]), np.float32)}
        self.seen = 0

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, tuple | np.ndarray]]:
        """Mean log probability (nats) and by parameter its gradient of the sum; E and N as (rows, gradient, uses)."""
        d, g = self._gradients(inputs, targets)
        return float(d.logs().sum()) / max(len(d.own), 1), g

    def _gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[Decisions, dict[str, tuple | np.ndarray]]:
        m, p, dims, n = self.model, self.model.p, self.model.dims, len(inputs)
        root = np.float32(1 / math.sqrt(dims))
        x = p["E"].take(inputs.ravel(), 0)
        maps = np.concatenate((p["Q"] * root, p["K"], p["V"]), axis=1)
        made = np.empty((len(x), 3 * dims + 1), x.dtype)  # of each input query, key, value and a 1
        made[:, -1] = 1
        np.matmul(x, maps, out=made[:, :-1])
        made = made.reshape(n, 2 * HALF, -1)
        q, k, v = made[:, HALF:, :dims], made[:, :, dims : 2 * dims], made[:, :, 2 * dims : -1]
        mean, a, sums = m.attend(q, k, v, m.bias())
        y = mean + x.reshape(n, 2 * HALF, dims)[:, HALF:]
        some = np.flatnonzero(targets >= 0)
        d = m.decisions(y.reshape(-1, dims).take(some, 0), targets.ravel().take(some))

        # Where the decisions want each context to go, and how they would move their nodes.
        high = np.zeros((len(d.own), len(d.head)), y.dtype)
        high.put(d.top_at, d.top_sides - d.top_sides / d.top)
        low = d.sides - d.sides / d.below
        down = high @ d.head[:, :-1]
        push, pull = np.empty((dims, len(low)), y.dtype), np.empty((dims + 1, len(low)), y.dtype)
        np.multiply(d.weights.T[:-1], low, out=push)
        own, back, at = np.ascontiguousarray(d.own.T), np.ascontiguousarray(down.T), 0
        np.concatenate([own[:, :size] for size in d.levels] or [own[:, :0]], axis=1, out=pull)
        pull *= low
        for size in d.levels:
            back[:, :size] += push[:, at : at + size]
            at += size
        rows, value, uses = _by_row(d.nodes, pull, len(p["N"]))
        often = np.bincount(m.tree.top_at.take(targets.ravel().take(some), 0).ravel(), minlength=len(d.head))[:-1]
        met = often > 0
        above = (high.T @ d.own)[:-1][met]
        g: dict[str, tuple | np.ndarray] = {"N": (np.concatenate((rows, m.tree.top[met])), np.concatenate((value, above)), np.concatenate((uses, often[met])).astype(np.float32))}

        # Back through the attention: dy over its sums, and less what all keys of a row have in common.
        dy = np.zeros((n * HALF, dims), y.dtype)
        dy[some.take(d.order)] = back.T
        dy = dy.reshape(n, HALF, dims)
        part = np.empty((n, HALF, dims + 1), y.dtype)
        np.divide(dy, sums, out=part[:, :, :-1])
        mean *= part[:, :, :-1]
        part[:, :, -1] = -(mean.reshape(-1, dims) @ np.ones(dims, y.dtype)).reshape(n, HALF)
        ds = part @ made[:, :, 2 * dims :].transpose(0, 2, 1)
        ds *= a
        g["R"] = np.bincount(np.maximum(m.back, 0).ravel(), np.where(m.back >= 0, ds.sum(axis=0), 0).ravel(), 2 * HALF).astype(np.float32)
        moved = np.empty((n, 2 * HALF, 3 * dims), y.dtype)
        moved[:, :HALF, :dims] = 0
        np.matmul(ds, k, out=moved[:, HALF:, :dims])
        np.matmul(ds.transpose(0, 2, 1), q, out=moved[:, :, dims : 2 * dims])
        np.matmul(a.transpose(0, 2, 1), part[:, :, :-1], out=moved[:, :, 2 * dims :])
        moved = moved.reshape(-1, 3 * dims)
        by_map = (moved.T @ x).T
        g["Q"], g["K"], g["V"] = by_map[:, :dims] * root, by_map[:, dims : 2 * dims], by_map[:, 2 * dims :]
        dx = moved @ maps.T
        dx.reshape(n, 2 * HALF, dims)[:, HALF:] += dy
        g["E"] = _by_row(inputs.ravel(), np.ascontiguousarray(dx.T), len(p["E"]))
        return d, g

    def step(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        _, g = self._gradients(inputs, targets)
        for name, value in g.items():
            if name in self.used:
                rows, value, uses = value
                self.used[name][rows] += uses
                sums = self.sums[name].take(rows) + (value.T * value.T).mean(axis=0) / (uses * uses)
                self.sums[name][rows] = sums
                value = value * (self.rate / (uses * np.sqrt(sums)))[:, None]
                value += self.model.p[name].take(rows, 0)
                self.model.p[name][rows] = value
            else:
                value = value / targets.size
                self.sums[name] += value * value
                self.model.p[name] += np.float32(0.1 * self.rate) * value / np.sqrt(self.sums[name])
        self.seen += int((targets >= 0).sum())

    def changes(self) -> list[tuple[str, bytes, bytes, bytes]]:
        """name, rows that were used, how often, by how much they moved; nothing if there were no windows."""
        out = []
        for name, value in self.model.p.items() if self.seen else ():
            uses = self.used.get(name, np.full(len(value), self.seen, np.float32))
            rows = np.flatnonzero(uses).astype(np.int32)
            out.append((name, rows.tobytes(), uses[rows].tobytes(), (value[rows] - self.began[name][rows]).astype(np.float32).tobytes()))
        return out


def _by_row(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that occur, the sum of their values (one column a value), and how often they occur."""
    place, own = np.empty(size, np.int64), np.arange(len(rows))
    place[rows] = own
    found = rows[place.take(rows) == own]  # one place of each row stays
    place[found] = own[: len(found)]
    at = place.take(rows)
    sums = np.empty((len(values), len(found)), np.float32)
    for k, value in enumerate(values):
        sums[k] = np.bincount(at, value, len(found))
    return found, sums.T, np.bincount(at, minlength=len(found)).astype(np.float32)


class Average:
    """Changes of many learners: their mean by row, weighted by uses."""

    def __init__(self):
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, name: str, rows: bytes, uses: bytes, moved: bytes) -> None:
        at, w, v = np.frombuffer(rows, np.int32), np.frombuffer(uses, np.float32).astype(float), np.frombuffer(moved, np.float32)
        v = v.reshape(len(at), -1)
        size = int(at[-1]) + 1 if len(at) else 0
        weight, total = self.sums.get(name, (np.zeros(0), np.zeros((0, v.shape[1]))))
        if size > len(weight):
            weight = np.concatenate((weight, np.zeros(size - len(weight))))
            total = np.concatenate((total, np.zeros((size - len(total), v.shape[1]))))
        weight[at] += w
        total[at] += w[:, None] * v
        self.sums[name] = weight, total

    def rows(self) -> list[tuple[str, bytes, bytes, bytes]]:
        out = []
        for name, (weight, total) in self.sums.items():
            at = np.flatnonzero(weight).astype(np.int32)
            out.append((name, at.tobytes(), weight[at].astype(np.float32).tobytes(), (total[at] / weight[at, None]).astype(np.float32).tobytes()))
        return out

    def move(self, model: Attention) -> None:
        for name, (weight, total) in self.sums.items():
            at = np.flatnonzero(weight)
            value = model.p[name] if model.p[name].ndim == 2 else model.p[name][:, None]
            value[at] += (total[at] / weight[at, None]).astype(np.float32)


def windows(sequences: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, 2 * HALF), targets (n, HALF; -1 beyond the end) and the sequence of each window."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    counts = -(-sizes // HALF)
    room = counts * HALF
    base = np.cumsum(room + HALF) - (room + HALF)
    line = np.full(int((room + HALF).sum()), start, np.int64)  # per sequence: HALF starts, then its ids moved by one
    goal = np.full(len(line), -1, np.int64)
    for s, b in zip(sequences, base.tolist(), strict=True):
        line[b + HALF + 1 : b + HALF + len(s)] = s[:-1]
        goal[b + HALF : b + HALF + len(s)] = s
    owner = np.repeat(np.arange(len(sequences)), counts)
    at = base[owner] + HALF * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    return line[at[:, None] + np.arange(2 * HALF)], goal[at[:, None] + HALF + np.arange(HALF)], owner


class SubwordModel:
    """The tree of the ids' counts and the attention over them."""

    def __init__(self, counts: np.ndarray, dims: int = 16):
        """counts: of each id in all training texts."""
        self.start = len(counts)
        self.net = Attention(Tree(counts), len(counts), dims)

    def learn(self, texts: Iterator[list[np.ndarray]], batch: int = 64, rate: float = 0.2) -> list[tuple[str, bytes, bytes, bytes]]:
        """Go once over all windows of the texts, so many a step; returns the changes. The model itself moves too."""
        learner = Learner(self.net, rate)
        for some in texts:
            inputs, targets, _ = windows(some, self.start)
            order = np.random.default_rng(len(inputs)).permutation(len(inputs))  # neighbours share a step no more
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                learner.step(inputs[rows], targets[rows])
        return learner.changes()

    def score(self, texts: list[np.ndarray], tables: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of each text, a list of ids that ends with the end."""
        tables = tables or self.net.tables()
        inputs, targets, owner = windows(texts, self.start)
        out = np.zeros(len(texts))
        for at in range(0, len(inputs), 128):
            some = slice(at, at + 128)
            out += np.bincount(owner[some], self.net.log10_probabilities(tables, inputs[some], targets[some]).sum(axis=1), len(texts))
        return out


_CHANGES = "name string, at binary, uses binary, moved binary"


def _batch(rows: list[tuple[str, bytes, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["name", "at", "uses", "moved"])


def averaged(changes: DataFrame, fan: int = 64) -> Average:
    """The mean of all tasks' changes. Tasks add up ``fan`` others at a time; what comes back is as large as one model."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Average()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total.add(*row)
        yield _batch(total.rows())

    left = changes.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // fan)
        changes = changes.repartition(left).mapInArrow(merge, _CHANGES)
    total = Average()
    for r in changes.toLocalIterator():
        total.add(r["name"], bytes(r["at"]), bytes(r["uses"]), bytes(r["moved"]))
    return total


def _with_end(ids: bytes, end_id: int) -> np.ndarray:
    return np.append(np.frombuffer(ids, "<u2").astype(np.int64), end_id)


def word_counts(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """word, c (occurrences in all texts); counted in each task first, in tables of at most most words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(words_of(text))
                if len(found) > most:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _key(word: bytes) -> bytes:
    """A word, or if it is long its digest after a byte that no word begins with."""
    return word if len(word) <= 64 else b"\xff" + hashlib.sha256(word).digest()


class Lexicon:
    """Words by number, so that one look-up finds a word's subword ids (16-bit) and its log10(c + 1), -1 if logs has none.

    Keeps the words of logs that it has met; numbers of others hold until numbers() is called again.
    """

    def __init__(self, ids: WordIds, logs: dict[bytes, float]):
        self.ids, self.logs, self.passing = ids, logs, []
        self.index: dict[bytes, int] = {}
        self.starts, self.known, self.flat = array("q", [0]), array("d"), array("H")

    def _add(self, words: list[bytes]) -> None:
        data = [self.ids.known[w] for w in words]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.known.extend([self.logs.get(_key(w), -1.0) for w in words])
        self.starts.frombytes((self.starts[-1] + np.cumsum([len(x) // 4 for x in data], dtype=np.int64)).tobytes())
        self.flat.frombytes(np.frombuffer(b"".join(data), "<u4").astype("<u2").tobytes())

    def numbers(self, words: list[bytes]) -> np.ndarray:
        for w in self.passing:
            del self.index[w]
        kept = len(self.index)
        del self.flat[self.starts[kept] :], self.starts[kept + 1 :], self.known[kept:]
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        met = [words[k] for k in missing.tolist()]
        new = set(met)
        self.passing = [w for w in new if _key(w) not in self.logs]
        if new:
            self.ids.add(new)
            self._add([*new.difference(self.passing)])
            self._add(self.passing)
            at[missing] = list(map(self.index.__getitem__, met))
        return at

    def log_counts(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.known).take(numbers) if len(numbers) else np.zeros(0)

    def subwords(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one after the other, and where each word's begin, with their end."""
        starts = np.frombuffer(self.starts, np.int64)
        first = starts.take(numbers)
        ends = np.concatenate(([0], np.cumsum(starts.take(numbers + 1) - first)))
        at = np.repeat(first - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
        return (np.frombuffer(self.flat, np.uint16).take(at) if len(at) else np.zeros(0, np.uint16)), ends


_lexicons: list[Lexicon] = []


def _lexicon(ids: WordIds, logs: dict[bytes, float]) -> Lexicon:
    """One in a worker, kept between tasks that share ids and logs."""
    if not _lexicons or _lexicons[0].ids is not ids or _lexicons[0].logs is not logs:
        _lexicons[:] = [Lexicon(ids, logs)]
    return _lexicons[0]


def _frequent(counts: DataFrame, most_words: int) -> tuple[dict[bytes, float], float]:
    """log10(c + 1) by _key() of the words with at least ``least`` occurrences, least so that they are at most most_words."""
    bands = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect()  # some hundred rows
    total, least = 0, math.inf
    for r in sorted(bands, key=lambda r: -r["band"]):
        total += r["n"]
        if total > most_words:
            break
        least = r["low"]
    if least == math.inf:
        return {}, least
    word = F.col("word").cast("binary")
    key = F.when(F.octet_length("word") <= 64, word).otherwise(F.concat(F.lit(b"\xff"), F.unhex(F.sha2(word, 256))))
    return {bytes(r["key"]): math.log10(r["c"] + 1) for r in counts.filter(F.col("c") >= least).select(key.alias("key"), "c").collect()}, least


def train(encoded: DataFrame, counts: np.ndarray, end_id: int, rounds: int = 4) -> SubwordModel:
    """A model that has seen every window of encoded (id, ids: 16-bit numbers) once, a share of the texts in each round.

    A text's round comes from a hash of its id and ids, so every text has one whatever its id.
    """
    model = SubwordModel(counts)
    dealt = F.pmod(F.xxhash64("id", F.lit(41), F.substring("ids", 1, 4096)), F.lit(rounds))
    for k in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=0.2 / (k + 1)) -> Iterator[pa.RecordBatch]:
            own: SubwordModel = copy.deepcopy(shared.value)  # a worker's copy of a broadcast serves later tasks too
            yield _batch(own.learn(([_with_end(x, end_id) for x in part.column(0).to_pylist()] for batch in batches for part in slices(batch, 0, 256, 1 << 20)), rate=rate))

        averaged(encoded.filter(dealt == k).select("ids").mapInArrow(run, _CHANGES)).move(model.net)
        shared.unpersist()
    return model


def score_documents(
    docs: DataFrame, held_out: Column, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 49407, vocabulary: int = 49408, most_words: int = 1 << 18
) -> DataFrame:
    """Score every whole text, with models that learn from all rows where held_out is false.

    held_out: a column of docs. most_words: words whose counts are broadcast (at most 64 bytes each, longer ones by a
    digest); all others are looked up by a join. vocabulary: ids of the tokenizer, 65,536 at most.

    Returns one row per input row: id_col, held_out, n_tokens (words and one end), n_known (those that training texts
    contain), train_tokens, base_score (add-one unigram log10 probability of the words), score (log10 probability of
    the text's subword ids and its end under the model). Null and empty texts are the end alone. Rows with null or
    repeated ids are learned and scored like others. With no training rows every count is 0 and the model knows no id
    from another. Very long texts are scored whole. Columns not named are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    counts = cut_lineage(word_counts(training.select("t")))
    n_docs = training.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = n_words + n_docs, distinct + (n_docs > 0)
    frequent, least = _frequent(counts, most_words)

    def subword_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums = word_ids(tokenizer_path, True), np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in slices(batch, 0, 8192):
                words = part.column(0).cast(pa.binary()).to_pylist()
                ids.add(set(words))
                own = [ids.known[w] for w in words]
                sums += np.bincount(np.frombuffer(b"".join(own), "<u4"), np.repeat(part.column(1).to_numpy(), [len(x) // 4 for x in own]), vocabulary).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["sub", "c"])

    by_id = counts.mapInArrow(subword_counts, "sub long, c long").groupBy("sub").agg(F.sum("c").alias("c")).collect()  # at most vocabulary rows
    subs = np.zeros(vocabulary, np.int64)
    for r in by_id:
        subs[r["sub"]] = r["c"]
    subs[end_id] += n_docs
    shared = spark.sparkContext.broadcast(frequent)
    end_log, end_known = math.log10(n_docs + 1), int(n_docs > 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(word_ids(tokenizer_path, True), shared.value)
        for batch in batches:
            for part in slices(batch, 1, 256):
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                words = list(chain.from_iterable(texts))
                numbers = lexicon.numbers(words)
                logs = lexicon.log_counts(numbers)
                ids, ends = lexicon.subwords(numbers)
                missing = np.flatnonzero(logs < 0)
                logs[missing] = 0
                stops = np.cumsum([0, *map(len, texts)])
                rare = [b" ".join([words[k] for k in missing[a:b]]).decode() for a, b in pairwise(np.searchsorted(missing, stops).tolist())]
                known = np.diff(stops) - np.diff(np.searchsorted(missing, stops)) + end_known
                base = [math.fsum(logs[a:b].tolist()) + end_log for a, b in pairwise(stops.tolist())]
                own = [ids[a:b].tobytes() for a, b in pairwise(ends[stops].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(stops) + 1), pa.array(known), pa.array(base, pa.float64()), pa.array(rare, pa.string()), pa.array(own, pa.binary())],
                    names=["id", "held_out", "n_tokens", "n_known", "base", "rare", "ids"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    encoded = rows.mapInArrow(read, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, rare string, ids binary")
    encoded = cut_lineage(encoded.withColumn("row", F.monotonically_increasing_id()))
    model = spark.sparkContext.broadcast(train(encoded.filter(~F.col("held_out")), subs, end_id))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = model.value, model.value.net.tables()
        for batch in batches:
            for part in slices(batch, 6, 256, 1 << 20):
                score = own.score([_with_end(x, end_id) for x in part.column(6).to_pylist()], tables)
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base", "row", "score"])

    per = encoded.select("id", "held_out", "n_tokens", "n_known", "base", "row", "ids")
    per = per.mapInArrow(scored, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, row long, score double")
    others = counts.filter(F.col("c") < least) if frequent else counts
    words = encoded.filter("rare <> ''").select("row", F.explode(F.split("rare", " ")).alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("k"))
    extra = words.join(others, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_base"))
    none = math.log10(total + kinds + 1)
    return per.join(extra, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(none)).alias("base_score"),
        "score",
    )
