"""Networks over the features of a row and the history before it: perceptron, feature tokens, and two gated branches.

A network names its parameters, draws them, and maps a batch of rows to logits (three classes) or to one number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from panelyard.operators import tape
from panelyard.operators.tape import Node

Params = dict[str, np.ndarray]
Draws = np.random.Generator | None


def _linear(rng: np.random.Generator, name: str, inputs: int, outputs: int) -> Params:
    most = 1 / math.sqrt(inputs)
    return {f"{name}.w": rng.uniform(-most, most, (inputs, outputs)), f"{name}.b": rng.uniform(-most, most, outputs)}


def _norm(name: str, dims: int) -> Params:
    return {f"{name}.scale": np.ones(dims), f"{name}.shift": np.zeros(dims)}


def linear(p: dict[str, Node], name: str, x: Node) -> Node:
    return x @ p[f"{name}.w"] + p[f"{name}.b"]


def norm(p: dict[str, Node], name: str, x: Node) -> Node:
    return tape.layer_norm(x, p[f"{name}.scale"], p[f"{name}.shift"])


@dataclass
class Perceptron:
    """inputs -> 128 -> 64 -> 32 -> outputs with ReLU, dropout after the first two layers."""

    features: int
    outputs: int = 3
    rate: float = 0.25
    hidden: tuple[int, ...] = (128, 64, 32)

    def draw(self, rng: np.random.Generator) -> Params:
        sizes = [self.features, *self.hidden, self.outputs]
        return {k: v for i, (a, b) in enumerate(zip(sizes, sizes[1:])) for k, v in _linear(rng, f"layer{i}", a, b).items()}

    def __call__(self, p: dict[str, Node], batch: dict[str, np.ndarray], rng: Draws) -> Node:
        x = tape.constant(batch["tabular"])
        for i in range(len(self.hidden)):
            x = tape.relu(linear(p, f"layer{i}", x))
            x = tape.dropout(x, self.rate, rng) if i < 2 else x
        return linear(p, f"layer{len(self.hidden)}", x)


def _block(rng: np.random.Generator, name: str, dims: int) -> Params:
    out = _norm(f"{name}.norm1", dims) | _norm(f"{name}.norm2", dims)
    for part in ("query", "key", "value", "out"):
        out |= _linear(rng, f"{name}.{part}", dims, dims)
    return out | _linear(rng, f"{name}.up", dims, 4 * dims) | _linear(rng, f"{name}.down", 4 * dims, dims)


def block(p: dict[str, Node], name: str, x: Node, heads: int, hidden: np.ndarray | None, rate: float, residual_rate: float, rng: Draws, last: bool = False) -> Node:
    """Attention over the places of x (rows, places, dims) and a layer for each, both after a norm and added to x.

    hidden: true for (row, place) that nobody may attend to. last: only the first place is read after this block, so
    only that is made, with the draws that it would have among the others.
    """
    n, places, dims = x.value.shape
    y = norm(p, f"{name}.norm1", x)
    read = (lambda t: tape.reshape(tape.first(t), (n, 1, dims))) if last else (lambda t: t)
    parted = lambda part, t: tape.transpose(tape.reshape(linear(p, f"{name}.{part}", t), (n, t.value.shape[1], heads, dims // heads)), (0, 2, 1, 3))
    root = tape.constant(np.asarray(1 / math.sqrt(dims // heads), x.value.dtype))
    scores = parted("query", read(y)) @ tape.transpose(parted("key", y), (0, 1, 3, 2)) * root
    weights = tape.dropout(tape.softmax(scores, None if hidden is None else hidden[:, None, None, :]), rate, rng, (n, heads, places, places))
    x = read(x)
    seen = tape.reshape(tape.transpose(weights @ parted("value", y), (0, 2, 1, 3)), x.value.shape)
    x = x + tape.dropout(linear(p, f"{name}.out", seen), residual_rate, rng, (n, places, dims))
    inner = tape.dropout(tape.gelu(linear(p, f"{name}.up", norm(p, f"{name}.norm2", x))), rate, rng, (n, places, 4 * dims))
    return x + tape.dropout(linear(p, f"{name}.down", inner), residual_rate, rng, (n, places, dims))


def _with_class(p: dict[str, Node], name: str, tokens: Node) -> Node:
    ones = tape.constant(np.ones((tokens.value.shape[0], 1, 1), tokens.value.dtype))
    return tape.concat([ones * p[f"{name}.class"], tokens], 1)


@dataclass
class FeatureTokens:
    """Each feature is a token, its value times a vector plus another; a class token attends to all of them."""

    features: int
    dims: int = 32
    layers: int = 2
    heads: int = 4
    rate: float = 0.1
    residual_rate: float = 0.0
    outputs: int = 3
    name: str = "tabular"
    head: bool = True

    def draw(self, rng: np.random.Generator) -> Params:
        small = lambda *shape: rng.normal(0, 0.02, shape)
        out = {f"{self.name}.weight": small(self.features, self.dims), f"{self.name}.bias": small(self.features, self.dims), f"{self.name}.class": small(1, 1, self.dims)}
        for i in range(self.layers):
            out |= _block(rng, f"{self.name}.block{i}", self.dims)
        out |= _norm(f"{self.name}.norm", self.dims)
        return out | _linear(rng, "head.one", self.dims, self.dims) | _linear(rng, "head.two", self.dims, self.outputs) if self.head else out

    def encode(self, p: dict[str, Node], x: np.ndarray, rng: Draws) -> Node:
        tokens = tape.constant(x[:, :, None]) * p[f"{self.name}.weight"] + p[f"{self.name}.bias"]
        tokens = _with_class(p, self.name, tokens)
        for i in range(self.layers):
            tokens = block(p, f"{self.name}.block{i}", tokens, self.heads, None, self.rate, self.residual_rate, rng, i == self.layers - 1)
        return norm(p, f"{self.name}.norm", tape.first(tokens))

    def __call__(self, p: dict[str, Node], batch: dict[str, np.ndarray], rng: Draws) -> Node:
        x = tape.relu(linear(p, "head.one", self.encode(p, batch["tabular"], rng)))
        return linear(p, "head.two", tape.dropout(x, self.rate, rng))


@dataclass
class TwoBranches:
    """History and features in a branch each, joined by a gate.

    The history's steps are projected, get a place, and a class token attends to those that are there. The features
    go through feature tokens or, with ``perceptron``, through layers after a norm. The gate weighs the two branches'
    projections; both branches and their mixture go to the classifier.
    """

    features: int
    sequence_features: int
    steps: int = 24
    dims: int = 32
    layers: int = 1
    heads: int = 4
    rate: float = 0.1
    tabular_dims: int = 32
    tabular_layers: int = 1
    tabular_heads: int = 4
    perceptron: bool = False
    fusion: int = 32
    outputs: int = 3

    def _tokens(self) -> FeatureTokens:
        return FeatureTokens(self.features, self.tabular_dims, self.tabular_layers, self.tabular_heads, self.rate, outputs=self.outputs, head=False)

    def draw(self, rng: np.random.Generator) -> Params:
        small = lambda *shape: rng.normal(0, 0.02, shape)
        out = _linear(rng, "temporal.step", self.sequence_features, self.dims) | {"temporal.class": small(1, 1, self.dims), "temporal.place": small(1, self.steps + 1, self.dims)}
        for i in range(self.layers):
            out |= _block(rng, f"temporal.block{i}", self.dims)
        out |= _norm("temporal.norm", self.dims)
        if self.perceptron:
            out |= _norm("tabular.input", self.features)
            for i, (a, b) in enumerate(zip((self.features, 128, 64, 32), (128, 64, 32, self.tabular_dims))):
                out |= _linear(rng, f"tabular.layer{i}", a, b)
        else:
            out |= self._tokens().draw(rng)
        both = self.dims + self.tabular_dims
        out |= _linear(rng, "fusion.temporal", self.dims, self.fusion) | _linear(rng, "fusion.tabular", self.tabular_dims, self.fusion) | _linear(rng, "fusion.gate", both, self.fusion)
        out |= _norm("classifier.norm", both + self.fusion) | _linear(rng, "classifier.one", both + self.fusion, self.fusion)
        return out | _linear(rng, "classifier.two", self.fusion, self.fusion // 2) | _linear(rng, "classifier.three", self.fusion // 2, self.outputs)

    def _history(self, p: dict[str, Node], batch: dict[str, np.ndarray], rng: Draws) -> Node:
        tokens = _with_class(p, "temporal", linear(p, "temporal.step", tape.constant(batch["sequence"]))) + p["temporal.place"]
        hidden = np.concatenate((np.zeros((len(batch["masked"]), 1), bool), batch["masked"]), axis=1)
        for i in range(self.layers):
            tokens = block(p, f"temporal.block{i}", tokens, self.heads, hidden, self.rate, self.rate, rng, i == self.layers - 1)
        return norm(p, "temporal.norm", tape.first(tokens))

    def _row(self, p: dict[str, Node], batch: dict[str, np.ndarray], rng: Draws) -> Node:
        if not self.perceptron:
            return self._tokens().encode(p, batch["tabular"], rng)
        x = norm(p, "tabular.input", tape.constant(batch["tabular"]))
        for i in range(3):
            x = tape.relu(linear(p, f"tabular.layer{i}", x))
            x = tape.dropout(x, self.rate, rng) if i < 2 else x
        return linear(p, "tabular.layer3", x)

    def __call__(self, p: dict[str, Node], batch: dict[str, np.ndarray], rng: Draws) -> Node:
        past, row = self._history(p, batch, rng), self._row(p, batch, rng)
        gate = tape.sigmoid(linear(p, "fusion.gate", tape.concat([past, row], 1)))
        minus, one = (tape.constant(np.asarray(v, gate.value.dtype)) for v in (-1.0, 1.0))
        fused = gate * linear(p, "fusion.temporal", past) + (gate * minus + one) * linear(p, "fusion.tabular", row)
        x = norm(p, "classifier.norm", tape.concat([past, row, fused], 1))
        for name in ("classifier.one", "classifier.two"):
            x = tape.dropout(tape.gelu(linear(p, name, x)), self.rate, rng)
        return linear(p, "classifier.three", x)


Network = Perceptron | FeatureTokens | TwoBranches
NETWORKS: dict[str, type] = {c.__name__: c for c in (Perceptron, FeatureTokens, TwoBranches)}


def loss_and_gradients(network: Network, params: Params, batch: dict[str, np.ndarray], y: np.ndarray, weights: np.ndarray, rng: Draws = None, frozen: tuple[str, ...] = ()) -> tuple[float, Params]:
    """Weighted mean loss of a batch (log loss of classes, or squared error of a number) and its gradients, 0 for names that begin with one of frozen."""
    p = {k: Node(v, needs=not k.startswith(frozen)) for k, v in params.items()}
    out = network(p, batch, rng)
    loss = tape.cross_entropy(out, y.astype(np.int64), weights) if network.outputs > 1 else tape.squared_error(out, y, weights)
    loss.backward()
    return float(loss.value), {k: v.grad if v.grad is not None else np.zeros_like(v.value) for k, v in p.items()}


def predict(network: Network, params: Params, batch: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities of the classes, or the number."""
    out = network({k: tape.constant(v) for k, v in params.items()}, batch, None)
    return tape.softmax(out).value if network.outputs > 1 else out.value


def warm_start(params: Params, other: Params, prefixes: tuple[str, ...]) -> tuple[Params, list[str]]:
    """params with those of another network whose names begin with a prefix and whose shapes agree; and their names."""
    loaded = [k for k, v in params.items() if k.startswith(prefixes) and k in other and other[k].shape == v.shape]
    if not loaded:
        raise ValueError(f"nothing to load for {prefixes}")
    return params | {k: other[k].copy() for k in loaded}, loaded
