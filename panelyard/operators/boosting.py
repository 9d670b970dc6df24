"""Boosted trees for several classes, or a number, on histograms of gradients that Spark adds up.

Features are cut into bins once. In a round each class gets a tree, and all trees of the round, and those of all
candidates of a grid, grow by a level with one pass over the data: a task adds the gradients of its rows by node,
feature and bin, the histograms of a node meet in one task, and its best split comes back. So a pass moves
histograms, whose size depends on leaves, features and bins, and no rows. Once no tree has many rows left in nodes that
may still be split, one more pass hands these rows to a task a tree, which goes on by the same steps to the tree's end.
Passes are many and short, so rows are kept in blocks of arrays, in an RDD that lives from one round to the next.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from panelyard.plans.rank_ic import monthly_rank_ic
from panelyard.sources.writers import cut_lineage, remove

#: The grid of rounds, learning rates and leaves.
GRID = [
    {"max_iter": 100, "learning_rate": 0.03, "max_leaf_nodes": 31}, {"max_iter": 100, "learning_rate": 0.1, "max_leaf_nodes": 31},
    {"max_iter": 300, "learning_rate": 0.03, "max_leaf_nodes": 31}, {"max_iter": 100, "learning_rate": 0.03, "max_leaf_nodes": 63},
]
BINS = 64  # the last one holds missing values
LEAST_ROWS = 20  # of a leaf
_LEAST_HESSIAN = 1e-3
_HANDED = 64  # histograms of a node that one task adds up
_AT_ONCE = 1 << 23  # bytes of histograms that are added up in one place; no more than these go to the driver
_ROWS = 50_000  # of a task at least, if there are more tasks than cores
_FEW = 1 << 16  # rows that one task may hold to finish a tree

#: Rows by column: bins by feature, labels, weights, and margins by candidate and output.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Gain, feature, bin, missing_left, and the sums (gradient, hessian, rows) of the left, the right and the whole node; gain 0 if there is no split.
Split = tuple[float, int, int, bool, list[float], list[float], list[float]]


@dataclass
class Tree:
    """Nodes by number, 0 the root. feature -1: a leaf with its value. Bins up to ``bin`` go left, missing values by ``missing_left``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, feature: int, at: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        """Makes the node a split; its two leaves."""
        first = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node] = feature, at, missing_left, first
        for v in values:
            for column, new in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.value, v)):
                column.append(new)
        return first, first + 1

    def grow(self, nodes: Iterable[int], splits: Iterable[Split], rate: float, most: int) -> dict[int, float]:
        """Splits the nodes, those of highest gain first while there are fewer than ``most`` leaves; the new ones that may be split in turn, with their rows."""
        value = lambda s: -rate * s[0] / max(s[1], 1e-12)
        new = {}
        for node, (gain, feature, at, missing_left, left, right, whole) in sorted(zip(nodes, splits, strict=True), key=lambda x: -x[1][0]):
            if node == 0:
                self.value[0] = value(whole)
            if gain > 0 and len(self.feature) < 2 * most - 1:
                new |= zip(self.split(node, feature, at, missing_left, (value(left), value(right))), (left[2], right[2]), strict=True)
        self.depth += bool(new)
        return {node: rows for node, rows in new.items() if rows >= 2 * LEAST_ROWS and len(self.feature) < 2 * most - 1}

    def histograms(self, nodes: list[int], bins: np.ndarray, *weights: np.ndarray | None) -> np.ndarray:
        """Sums of the weights (rows, if None) by node, feature and bin; all nodes together, one after the other in the bins of one count."""
        place = np.full(len(self.feature), -1)
        place[nodes] = np.arange(len(nodes)) * BINS
        at = place[self.leaves(bins)]
        own = slice(None) if (at >= 0).all() else np.flatnonzero(at >= 0)
        at, weights, size = at[own], [w if w is None else np.ascontiguousarray(w[own]) for w in weights], len(nodes) * BINS
        made = [np.stack([np.bincount(at + x, w, size) for w in weights], axis=1).reshape(len(nodes), BINS, -1) for x in bins.T[:, own]]
        return np.stack(made, axis=1)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, at, missing, left = (np.array(c)[:, None] for c in (self.feature, self.bin, self.missing_left, self.left))
        goes_left = np.where(np.arange(BINS) == BINS - 1, missing, np.arange(BINS) <= at)
        following = np.where(feature >= 0, left + ~goes_left, np.arange(len(feature))[:, None]).ravel()  # by node and bin
        cells, first = bins.T.ravel(), np.maximum(feature[:, 0], 0) * len(bins)  # a feature after the other
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            node = following[node * BINS + cells[first[node] + rows]]
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Boosted:
    """edges: by feature. base: by class (one for a number). trees: by round and class."""

    features: list[str]
    edges: list[list[float]]
    base: list[float]
    params: dict
    trees: list[list[Tree]] = field(default_factory=list)

    def bins_of(self, batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
        return _binned(batch, self.edges, at)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.base) + _margins(self.trees, bins, len(self.base))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, or one column with the number."""
        m = self.margins(bins)
        return _softmax(m) if m.shape[1] > 1 else m

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "trees": [[t.__dict__ for t in r] for r in self.trees]})

    @staticmethod
    def from_json(text: str) -> Boosted:
        d = json.loads(text)
        return Boosted(**{**d, "trees": [[Tree(**t) for t in r] for r in d["trees"]]})


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _binned(batch: pa.RecordBatch, edges: list[list[float]], at: int = 0) -> np.ndarray:
    """Bins of the feature columns from column ``at`` on; nulls and NaN go to the last one."""
    out = np.empty((batch.num_rows, len(edges)), np.uint8)
    for i, e in enumerate(edges):
        x = batch.column(at + i).to_numpy(zero_copy_only=False).astype(np.float64)
        out[:, i] = np.where(np.isnan(x), BINS - 1, np.searchsorted(np.array(e), x, "left"))
    return out


def _margins(trees: list[list[Tree]], bins: np.ndarray, outputs: int) -> np.ndarray:
    m = np.zeros((len(bins), outputs))
    for of_round in trees:
        for k, tree in enumerate(of_round):
            m[:, k] += tree.values(bins)
    return m


def bin_edges(train: DataFrame, features: list[str]) -> list[list[float]]:
    """Distinct inner quantiles of each feature, BINS - 2 at most; from Spark's sketch, whose size is bounded."""
    at = [i / (BINS - 1) for i in range(1, BINS - 1)]
    return [sorted(set(q)) for q in train.approxQuantile(features, at, 1 / (8 * BINS))] if features else []


def _gradients(margins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivative of the loss by row and output: log loss of classes, or half the squared error."""
    if margins.shape[1] == 1:
        return (margins - y[:, None]) * w[:, None], np.repeat(w[:, None], 1, 1)
    p = _softmax(margins)
    return (p - (y[:, None] == np.arange(margins.shape[1]))) * w[:, None], p * (1 - p) * w[:, None]


def best_splits(h: np.ndarray) -> list[Split]:
    """The best split of each histogram; h: (node, feature, bin, (gradient, hessian, rows))."""
    whole = h[:, 0].sum(axis=1)
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-12)
    best: list[Split] = [(0.0, 0, 0, False, [0.0] * 3, [0.0] * 3, w) for w in whole.tolist()]
    below = np.cumsum(h[:, :, :-1], axis=2)[:, :, :-1]
    for missing_left in (False, True):
        left = below + h[:, :, -1:] if missing_left else below
        right = whole[:, None, None] - left
        fine = (left[..., 2] >= LEAST_ROWS) & (right[..., 2] >= LEAST_ROWS) & (left[..., 1] >= _LEAST_HESSIAN) & (right[..., 1] >= _LEAST_HESSIAN)
        gain = np.where(fine, score(left) + score(right) - score(whole)[:, None, None], 0.0).reshape(len(h), -1)
        for i, at in enumerate(gain.argmax(axis=1).tolist()):
            if gain[i, at] > best[i][0] + 1e-12:
                f, b = divmod(at, below.shape[2])
                best[i] = (float(gain[i, at]), f, b, missing_left, left[i, f, b].tolist(), right[i, f, b].tolist(), best[i][-1])
    return best


def _splits(blocks: RDD, p: int, growing: list[list[Tree]], opened: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], list[Split]]:
    """The best splits of the open nodes of trees (candidate, class). p: the count of features."""
    n, tasks = sum(map(len, opened.values())), blocks.getNumPartitions()
    shares = -(-tasks // _HANDED)
    ends = min(n, -(-n * min(tasks, _HANDED) * p * BINS * 24 // _AT_ONCE))  # places that add up, each its nodes

    def run(part: int, blocks: Iterator[Block]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        sums = np.zeros((n, p, BINS, 3))
        for bins, y, w, margins in blocks:
            gradients = {c: _gradients(margins[c].T, y, w) for c in {c for c, _ in opened}}
            sums += np.concatenate([growing[c][k].histograms(nodes, bins.T, *(x[:, k] for x in gradients[c]), None) for (c, k), nodes in opened.items()])
        for end in range(ends):
            yield part % shares * ends + end, (part, sums[end::ends])

    def added(parts: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple[int, np.ndarray]]:
        """In the order of the parts, so that each run has the same sums."""
        total = None
        for key, (_, sums) in sorted(parts, key=lambda x: x[1][0]):
            total = sums if total is None else total + sums
        if total is not None:
            yield key, total

    def decide(parts: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple[int, Split]]:
        for end, sums in added(parts):
            yield from zip(range(end, n, ends), best_splits(sums), strict=True)

    parts = blocks.mapPartitionsWithIndex(run)
    if shares == ends == 1:
        found = decide(parts.collect())  # _AT_ONCE at most
    else:
        if shares > 1:
            parts = parts.partitionBy(shares * ends, int).mapPartitions(added).map(lambda x: (x[0] % ends, (x[0] // ends, x[1])))
        found = parts.partitionBy(ends, int).mapPartitions(decide).collect()  # a row for each open node
    inorder = iter([split for _, split in sorted(found, key=lambda x: x[0])])
    return {place: [next(inorder) for _ in nodes] for place, nodes in opened.items()}


def _finished(blocks: RDD, growing: list[list[Tree]], opened: dict[tuple[int, int], list[int]], points: list[dict]) -> list[tuple[int, Tree]]:
    """The trees with open nodes, grown to their end in a task each, by their number. The rows of a tree's open nodes are few."""
    places = list(opened)

    def run(part: int, blocks: Iterator[Block]) -> Iterator[tuple[int, tuple[int, tuple]]]:
        for bins, y, w, margins in blocks:
            gradients = {c: _gradients(margins[c].T, y, w) for c in {c for c, _ in opened}}
            for i, (c, k) in enumerate(places):
                own = np.isin(growing[c][k].leaves(bins.T), opened[c, k])
                yield i, (part, (bins[:, own], *(x[own, k] for x in gradients[c])))

    def finish(parts: Iterator[tuple[int, tuple[int, tuple]]]) -> Iterator[tuple[int, Tree]]:
        rows = sorted(parts, key=lambda x: x[1][0])
        if rows:
            i = rows[0][0]
            (c, k), nodes = places[i], opened[places[i]]
            bins, g, h = (np.concatenate(x, axis=-1) for x in zip(*(block for _, (_, block) in rows), strict=True))
            while nodes:
                nodes = list(growing[c][k].grow(nodes, best_splits(growing[c][k].histograms(nodes, bins.T, g, h, None)), points[c]["learning_rate"], points[c]["max_leaf_nodes"]))
            yield i, growing[c][k]

    return blocks.mapPartitionsWithIndex(run).partitionBy(len(places), int).mapPartitions(finish).collect()  # a row for each tree


def fit(train: DataFrame, features: list[str], label: str, grid: list[dict], classes: int | None = 3, weight: str | None = None, edges: list[list[float]] | None = None, every: int = 10) -> list[Boosted]:
    """A model for each point of the grid (max_iter, learning_rate, max_leaf_nodes), all fitted in the same passes.

    classes: labels are 0 to classes - 1; None: the label is a number and the loss the squared error. Rows without a
    label are left out; missing features are a bin of their own. edges: of the bins, if not found here. Trees grow by levels, the splits of highest gain
    first while there are leaves left. Points that differ in their rounds alone have the same trees, so the longest is
    fitted and the others are its first rounds. The margins are kept beside the bins by the executors, and written to
    the shared folder every ``every`` rounds.
    """
    rows = train.filter(F.col(label).isNotNull())
    edges = bin_edges(rows, features) if edges is None else edges
    w = F.col(weight) if weight else F.lit(1.0)
    outputs, p = classes or 1, len(features)
    if classes:
        count = rows.groupBy(F.col(label).cast("int").alias("k")).agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")).collect()  # a row a class
        share = {r["k"]: r["w"] for r in count}
        total = sum(share.values()) or 1.0
        base = [float(np.log(max(share.get(k, 0.0), 1e-9) / total)) for k in range(classes)]
        n = sum(r["n"] for r in count)
    else:
        mean, n = rows.agg(F.sum(w * F.col(label)) / F.sum(w), F.count(F.lit(1))).first()
        base = [float(mean or 0.0)]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = [_binned(batch, edges, 2).T.tobytes(), *(batch.column(i).to_numpy().tobytes() for i in range(2))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names=["bins", "y", "w"])

    point = lambda params: (params["learning_rate"], params["max_leaf_nodes"])
    longest = {}
    for params in grid:
        if point(params) not in longest or params["max_iter"] > longest[point(params)].params["max_iter"]:
            longest[point(params)] = Boosted(features, edges, base, dict(params))
    live = list(longest.values())

    def start(row) -> Block:
        y = np.frombuffer(row["y"])
        return np.frombuffer(row["bins"], np.uint8).reshape(p, len(y)), y, np.frombuffer(row["w"]), np.tile(np.array(base)[:, None], (len(live), 1, len(y)))

    table = rows.select(F.col(label).cast("double").alias("y"), w.cast("double").alias("w"), *[F.col(f).cast("double") for f in features])
    binned = cut_lineage(table.mapInArrow(prepare, "bins binary, y binary, w binary")).rdd
    binned = binned.coalesce(max(binned.context.defaultParallelism, -(-n // _ROWS)))
    blocks, last, written = binned.map(start).persist(StorageLevel.MEMORY_AND_DISK), None, None
    for at in range(max(m.params["max_iter"] for m in live)):
        if at:
            still = [c for c, m in enumerate(live) if at < m.params["max_iter"]]
            last, blocks = blocks, _with_margins(blocks, [live[c].trees[-1] for c in still], still).persist(StorageLevel.MEMORY_AND_DISK)
            live = [live[c] for c in still]
            if at % every == 0:
                blocks.checkpoint()
        growing = [[Tree() for _ in range(outputs)] for _ in live]
        opened = {(c, k): {0: n} for c in range(len(live)) for k in range(outputs)}
        while opened:
            following, nodes = {}, {place: list(of) for place, of in opened.items()}
            if max(sum(of.values()) for of in opened.values()) <= _FEW:
                for i, tree in _finished(blocks, growing, nodes, [m.params for m in live]):
                    c, k = list(nodes)[i]
                    growing[c][k] = tree
            else:
                for (c, k), splits in _splits(blocks, p, growing, nodes).items():
                    following[c, k] = growing[c][k].grow(nodes[c, k], splits, live[c].params["learning_rate"], live[c].params["max_leaf_nodes"])
            if last:
                last.unpersist()
                last = None
                if at % every == 0:
                    if written:
                        remove(train.sparkSession, written)
                    written = blocks.getCheckpointFile()
            opened = {place: of for place, of in following.items() if of}
        for m, trees in zip(live, growing, strict=True):
            m.trees.append(trees)
    blocks.unpersist()
    if written:
        remove(train.sparkSession, written)
    return [Boosted(features, edges, base, dict(params), longest[point(params)].trees[: params["max_iter"]]) for params in grid]


def _with_margins(blocks: RDD, trees: list[list[Tree]], still: list[int]) -> RDD:
    """Blocks with the margins after a round, of those candidates that go on. trees: of the round."""

    def run(block: Block) -> Block:
        bins, y, w, margins = block
        return bins, y, w, margins[still] + np.stack([_margins([t], bins.T, margins.shape[1]).T for t in trees])

    return blocks.map(run)


def score(df: DataFrame, models: dict[str, Boosted], keep: list[str]) -> DataFrame:
    """keep, model, probability (array; null for a number) and score (p of the last class less p of the first, or the number), a row for each model."""
    features = next(iter(models.values())).features
    if any(m.features != features for m in models.values()):
        raise ValueError("the models were fitted on different features")
    shared = df.sparkSession.sparkContext.broadcast(models)
    kept = df.select(*keep).schema
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, model in shared.value.items():
                out = model.predict(model.bins_of(batch, k))
                several = out.shape[1] > 1
                p = pa.array(list(out), pa.list_(pa.float64())) if several else pa.nulls(len(out), pa.list_(pa.float64()))
                value = out[:, -1] - out[:, 0] if several else out[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array([name] * len(out), pa.string()), p, pa.array(value)], names=[*batch.schema.names[:k], "model", "probability", "score"])

    # keys may bear a feature's name, so the features are renamed
    rows = df.select(*keep, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)])
    return rows.mapInArrow(run, kept.add("model", "string").add("probability", ArrayType(DoubleType())).add("score", "double"))


def choose(validation: DataFrame, models: list[Boosted], target: str, month: str = "month_id") -> tuple[int, list[float | None]]:
    """The model of highest mean monthly rank IC on the validation rows, the first of equals; and all means."""
    scored = score(validation.filter(F.col(target).isNotNull()), {str(i): m for i, m in enumerate(models)}, [month, target])
    means = monthly_rank_ic(scored, "score", target, keys=["model", month]).groupBy("model").agg(F.avg("rank_ic").alias("ic")).collect()
    ic = {int(r["model"]): r["ic"] for r in means}
    found = [ic.get(i) for i in range(len(models))]
    return max(range(len(models)), key=lambda i: (found[i] if found[i] is not None else -2.0, -i)), found


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, features: list[str]) -> Boosted:
    """The saved model; raises if it was fitted on other features or in another order."""
    model = Boosted.from_json(spark.read.parquet(path).first()["model"])
    if model.features != list(features):
        raise ValueError(f"fitted on {model.features}, not on {features}")
    return model
