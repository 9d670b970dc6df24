"""Arrays that remember how they were made, so that gradients can be taken back to the parameters of a network."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Parents = tuple[tuple["Node", Callable[[np.ndarray], np.ndarray]], ...]


class Node:
    """A value, and for each parent what its gradient gets from this one's.

    needs: whether a gradient is asked for. A node that is made of none that need one remembers nothing.
    """

    __slots__ = ("value", "grad", "parents", "needs")

    def __init__(self, value: np.ndarray, parents: Parents = (), needs: bool | None = None):
        self.value, self.grad, self.parents = value, None, tuple(p for p in parents if p[0].needs)
        self.needs = not parents or bool(self.parents) if needs is None else needs

    def __add__(self, other: Node) -> Node:
        return Node(self.value + other.value, ((self, lambda g: _fold(g, self.value.shape)), (other, lambda g: _fold(g, other.value.shape))))

    def __mul__(self, other: Node) -> Node:
        return Node(self.value * other.value, ((self, lambda g: _fold(g * other.value, self.value.shape)), (other, lambda g: _fold(g * self.value, other.value.shape))))

    def __matmul__(self, other: Node) -> Node:
        turned = lambda a: np.swapaxes(a, -1, -2)
        if other.value.ndim == 2:  # a table of weights for any number of rows
            flat = lambda a: a.reshape(-1, a.shape[-1])
            return Node(self.value @ other.value, ((self, lambda g: g @ other.value.T), (other, lambda g: flat(self.value).T @ flat(g))))
        return Node(self.value @ other.value, ((self, lambda g: g @ turned(other.value)), (other, lambda g: turned(self.value) @ g)))

    def backward(self) -> None:
        """Gradients of this scalar into ``grad`` of all nodes that it depends on."""
        order: list[Node] = []
        seen: set[int] = set()
        stack: list[tuple[Node, bool]] = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack.extend((p, False) for p, _ in node.parents)
        self.grad = np.ones_like(self.value)
        for node in reversed(order):
            for parent, back in node.parents:
                g = back(node.grad)
                parent.grad = g if parent.grad is None else parent.grad + g


def _fold(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which a value of that shape was repeated."""
    if g.shape == shape:
        return g
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    return g.sum(axis=tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1), keepdims=True) if g.shape != shape else g


def constant(value: np.ndarray) -> Node:
    return Node(value, needs=False)


def relu(x: Node) -> Node:
    return Node(np.maximum(x.value, 0), ((x, lambda g: g * (x.value > 0)),))


def gelu(x: Node) -> Node:
    """By the hyperbolic tangent, which is within 0.0005 of the normal distribution's."""
    c, v = math.sqrt(2 / math.pi), x.value
    t = np.tanh(c * (v + 0.044715 * (v * v * v)))
    return Node(0.5 * v * (1 + t), ((x, lambda g: g * (0.5 * (1 + t) + 0.5 * v * (1 - t * t) * c * (1 + 3 * 0.044715 * v * v))),))


def sigmoid(x: Node) -> Node:
    s = 1 / (1 + np.exp(-np.clip(x.value, -500, 500)))
    return Node(s, ((x, lambda g: g * s * (1 - s)),))


def softmax(x: Node, hidden: np.ndarray | None = None) -> Node:
    """Over the last axis; places where hidden is true get nothing. One place at least must be open."""
    v = x.value if hidden is None else np.where(hidden, -np.inf, x.value)
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    p = e / e.sum(axis=-1, keepdims=True)
    return Node(p, ((x, lambda g: p * (g - (g * p).sum(axis=-1, keepdims=True))),))


def layer_norm(x: Node, scale: Node, shift: Node, eps: float = 1e-5) -> Node:
    centred = x.value - x.value.mean(axis=-1, keepdims=True)
    inverse = 1 / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + eps)
    unit = centred * inverse

    def back(g: np.ndarray) -> np.ndarray:
        return inverse * (g - g.mean(axis=-1, keepdims=True) - unit * (g * unit).mean(axis=-1, keepdims=True))

    return Node(unit, ((x, back),)) * scale + shift


def dropout(x: Node, rate: float, rng: np.random.Generator | None, shape: tuple[int, ...] | None = None) -> Node:
    """Without a generator, as in scoring, x itself. shape: of the array whose first places x is, so that it gets that array's draws."""
    if rng is None or not rate:
        return x
    drawn = rng.random(shape or x.value.shape, dtype=np.float32)[tuple(slice(k) for k in x.value.shape)]
    keep = (drawn >= rate).astype(x.value.dtype) / x.value.dtype.type(1 - rate)
    return Node(x.value * keep, ((x, lambda g: g * keep),))


def reshape(x: Node, shape: tuple[int, ...]) -> Node:
    return Node(x.value.reshape(shape), ((x, lambda g: g.reshape(x.value.shape)),))


def transpose(x: Node, axes: tuple[int, ...]) -> Node:
    return Node(x.value.transpose(axes), ((x, lambda g: g.transpose(np.argsort(axes))),))


def concat(parts: list[Node], axis: int) -> Node:
    ends = np.cumsum([p.value.shape[axis] for p in parts])
    cut = lambda i: lambda g: np.take(g, range(ends[i] - parts[i].value.shape[axis], ends[i]), axis)
    return Node(np.concatenate([p.value for p in parts], axis), tuple((p, cut(i)) for i, p in enumerate(parts)))


def first(x: Node) -> Node:
    """The first place along axis 1."""

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x.value)
        out[:, 0] = g
        return out

    return Node(x.value[:, 0], ((x, back),))


def cross_entropy(logits: Node, labels: np.ndarray, weights: np.ndarray) -> Node:
    """Mean over the rows by their weights."""
    v = logits.value - logits.value.max(axis=1, keepdims=True)
    logs = v - np.log(np.exp(v).sum(axis=1, keepdims=True))
    rows = np.arange(len(labels))
    share = (weights / weights.sum()).astype(v.dtype)

    def back(g: np.ndarray) -> np.ndarray:
        d = np.exp(logs)
        d[rows, labels] -= 1
        return g * d * share[:, None]

    return Node(np.asarray(-(logs[rows, labels] * share).sum()), ((logits, back),))


def squared_error(out: Node, targets: np.ndarray, weights: np.ndarray) -> Node:
    share = (weights / weights.sum()).astype(out.value.dtype)
    error = out.value[:, 0] - targets
    return Node(np.asarray((error**2 * share).sum()), ((out, lambda g: (g * 2 * error * share)[:, None]),))
