"""Models given as a graph of array operations, run in order; what no later step needs is let go."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from .inference import softmax


@dataclass(frozen=True)
class Step:
    op: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    attributes: dict[str, Any] = field(default_factory=dict)


_erf = np.vectorize(math.erf, otypes=[float])


def _like(x: np.ndarray, value: np.ndarray) -> np.ndarray:
    return value.astype(x.dtype, copy=False)


def _softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def _slice(x: np.ndarray, starts, ends, axes=None, steps=None) -> np.ndarray:
    n = len(starts)
    at = [slice(None)] * x.ndim
    for s, e, a, step in zip(starts, ends, range(n) if axes is None else axes, [1] * n if steps is None else steps, strict=True):
        at[int(a)] = slice(int(s), int(e) if abs(int(e)) < 2**62 else None, int(step))
    return x[tuple(at)]


def _reshape(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return x.reshape([x.shape[i] if s == 0 else int(s) for i, s in enumerate(shape)])


def _gemm(a, b, c=0.0, alpha=1.0, beta=1.0, trans_a=0, trans_b=0):
    return alpha * ((a.T if trans_a else a) @ (b.T if trans_b else b)) + beta * c


def _axes(axes) -> tuple[int, ...] | None:
    return None if axes is None else tuple(int(a) for a in np.atleast_1d(axes))


#: Every operation that a graph may use; another name is refused when the graph is checked.
OPS: dict[str, Callable] = {
    "Add": np.add, "Sub": np.subtract, "Mul": np.multiply, "Div": lambda a, b: a // b if np.issubdtype(np.result_type(a, b), np.integer) else a / b,
    "Sqrt": np.sqrt, "Reciprocal": lambda x: _like(x, 1 / x), "Sigmoid": lambda x: _like(x, 1 / (1 + np.exp(-x))), "Sin": np.sin, "Cos": np.cos,
    "Cast": lambda x, to: x.astype(to), "Erf": lambda x: _like(x, _erf(x)), "Relu": lambda x: np.maximum(x, 0),
    "Less": np.less, "Greater": np.greater, "GreaterOrEqual": np.greater_equal, "Equal": np.equal, "And": np.logical_and, "Where": np.where,
    "MatMul": np.matmul, "Gemm": _gemm, "Shape": lambda x: np.array(x.shape, np.int64), "Reshape": _reshape, "Concat": lambda *xs, axis: np.concatenate(xs, axis),
    "Squeeze": lambda x, axes=None: np.squeeze(x, _axes(axes)), "Unsqueeze": lambda x, axes: np.expand_dims(x, _axes(axes)), "Expand": lambda x, shape: np.broadcast_to(x, np.broadcast_shapes(x.shape, tuple(int(s) for s in shape))),
    "Transpose": lambda x, perm=None: np.transpose(x, perm), "Gather": lambda x, i, axis=0: np.take(x, i, axis), "GatherElements": lambda x, i, axis=0: np.take_along_axis(x, i, axis),
    "Slice": _slice, "Split": lambda x, sizes, axis=0: tuple(np.split(x, np.cumsum(sizes)[:-1].tolist(), axis)), "Range": lambda a, b, step: np.arange(a, b, step),
    "CumSum": lambda x, axis: np.cumsum(x, int(axis)), "OneHot": lambda i, depth, values: np.where(np.arange(int(depth)) == i[..., None], values[1], values[0]),
    "ReduceMean": lambda x, axes=None, keepdims=1: x.mean(_axes(axes), keepdims=bool(keepdims)), "ReduceSum": lambda x, axes=None, keepdims=1: x.sum(_axes(axes), keepdims=bool(keepdims)),
    "Softmax": _softmax, "LogSoftmax": lambda x, axis=-1: x - x.max(axis, keepdims=True) - np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis, keepdims=True)),
}


@dataclass(frozen=True)
class GraphModel:
    """A scorer: ids go in under `entry` as one row, logits in label order come out under `exit`."""

    labels: list[str]
    steps: tuple[Step, ...]
    weights: dict[str, np.ndarray]
    entry: str = "ids"
    exit: str = "logits"
    most_bytes: int = 1 << 30

    def unsupported(self) -> list[str]:
        return sorted({s.op for s in self.steps} - OPS.keys())

    def run(self, ids: np.ndarray) -> np.ndarray:
        if unknown := self.unsupported():
            raise ValueError(f"unsupported operations: {', '.join(unknown[:16])}")
        last = {name: k for k, step in enumerate(self.steps) for name in step.inputs}
        live: dict[str, np.ndarray] = {self.entry: np.asarray(ids)[None, :]}
        for k, step in enumerate(self.steps):
            found = [live[name] if name in live else self.weights[name] for name in step.inputs]
            out = OPS[step.op](*found, **step.attributes)
            live.update(zip(step.outputs, out if isinstance(out, tuple) else (out,), strict=True))
            for name in step.inputs:
                if last[name] == k and name != self.exit:
                    live.pop(name, None)
            if sum(x.nbytes for x in live.values()) > self.most_bytes:
                raise ValueError("the graph needs more memory than it may")
        return live[self.exit]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return softmax(np.ravel(self.run(ids)))
