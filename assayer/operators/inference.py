"""Row-wise scoring: text to ids to scores to a judgement. A row's result never depends on the rows it comes with."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise

TOLERANCE = 1e-6


class Model(Protocol):
    """What scores one row's ids, in label order. Models are plain data that reaches the workers once."""

    labels: list[str]

    def scores(self, ids: np.ndarray) -> np.ndarray: ...


def softmax(logits: np.ndarray) -> np.ndarray:
    x = np.asarray(logits, np.float64)
    if not np.isfinite(x).all():
        raise ValueError("a logit is not finite")
    e = np.exp(x - x.max())
    return e / e.sum()


def bytes_of(text: str, most: int) -> np.ndarray:
    """Byte ids of the normalised text; [0] if nothing is left."""
    raw = np.frombuffer(normalise(text).encode()[:most], np.uint8).astype(np.int64) + 1
    return raw if len(raw) else np.zeros(1, np.int64)


@dataclass(frozen=True)
class NgramModel:
    """Sublinear term frequency times idf of byte n-grams, unit length, one linear layer, softmax."""

    labels: list[str]
    tables: dict[int, dict[int, int]]  # order -> key in base 257 -> column
    idf: np.ndarray
    weight: np.ndarray  # (columns, labels)
    bias: np.ndarray
    eps: float = 1e-12

    def scores(self, ids: np.ndarray) -> np.ndarray:
        counts: dict[int, int] = {}
        for n, table in self.tables.items():
            if len(ids) < n:
                continue
            runs = np.lib.stride_tricks.sliding_window_view(ids, n)
            keys = runs[(runs > 0).all(1)] @ (257 ** np.arange(n - 1, -1, -1, dtype=np.int64))
            for key, k in zip(*np.unique(keys, return_counts=True), strict=True):
                column = table.get(int(key))
                if column is not None:
                    counts[column] = counts.get(column, 0) + int(k)
        if not counts:
            return softmax(self.bias)
        columns = np.array(sorted(counts))
        x = (np.log([counts[c] for c in columns.tolist()]).astype(np.float32) + 1) * self.idf[columns]
        x /= max(float(np.sqrt((x * x).sum(dtype=np.float32))), self.eps)
        return softmax(x @ self.weight[columns] + self.bias)


@dataclass(frozen=True)
class ConvolutionModel:
    """Embedding, convolutions of several widths, the largest activation of each filter over real positions, one linear layer, softmax."""

    labels: list[str]
    embedding: np.ndarray  # (ids, channels)
    branches: list[tuple[np.ndarray, np.ndarray]]  # (filters, channels, width), (filters,)
    weight: np.ndarray
    bias: np.ndarray
    masked: float = -1e9

    def scores(self, ids: np.ndarray) -> np.ndarray:
        x, real = self.embedding[ids], ids > 0
        pooled = []
        for kernel, bias in self.branches:
            width = kernel.shape[2]
            padded = np.pad(x, ((width // 2, width - 1 - width // 2), (0, 0)))
            views = np.lib.stride_tricks.sliding_window_view(padded, width, axis=0)  # (positions, channels, width)
            active = np.maximum(np.einsum("tcw,fcw->tf", views, kernel) + bias, 0) + np.where(real, 0.0, self.masked)[:, None]
            pooled.append(active.max(0))
        return softmax(np.concatenate(pooled) @ self.weight + self.bias)


SCHEMA = "id string, scores array<double>, predicted_label string, error string"


def infer(rows: DataFrame, model: Model, preprocess: Callable[[str], np.ndarray], id_col: str = "id", input_col: str = "input") -> DataFrame:
    """(id, scores, predicted_label, error): scores in label order, the first of the largest, or why a row has none."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def one(text: str | None) -> tuple:
        if text is None:
            return None, None, "missing_input"
        try:
            scores = shared.value.scores(preprocess(text))
        except (ValueError, IndexError):
            return None, None, "scoring_failed"
        if len(scores) != len(shared.value.labels) or not np.isfinite(scores).all() or (scores < 0).any() or abs(scores.sum() - 1) > TOLERANCE:
            return None, None, "invalid_scores"
        return scores.tolist(), shared.value.labels[int(scores.argmax())], None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(i, *one(t)) for i, t in zip(part["id"], part["input"], strict=True)], columns=["id", "scores", "predicted_label", "error"])

    return rows.select(F.col(id_col).alias("id"), F.col(input_col).alias("input")).mapInPandas(run, SCHEMA)


def judged(results: DataFrame, labels: list[str], tau: float | None = None, out_of_scope: str | None = None) -> DataFrame:
    """results with status: error, out_of_scope (before the threshold is asked), abstain, or ok."""
    top = F.array_max("scores")
    status = F.when(F.col("error").isNotNull(), "error")
    if out_of_scope is not None:
        status = status.when(F.col("predicted_label") == out_of_scope, "out_of_scope")
    if tau is not None:
        status = status.when(top < tau, "abstain")
    named = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("id"), F.col("scores").alias("score"))
    return results.select("id", status.otherwise("ok").alias("status"), "predicted_label", F.when(F.col("scores").isNotNull(), named).alias("scores"))


def all_or_nothing(results: DataFrame) -> DataFrame:
    """results, after making sure that no row failed and that there is one."""
    found = results.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
    if not found["n"]:
        raise ValueError("there is no record")
    if found["bad"]:
        raise ValueError(f"{found['bad']} records cannot be scored")
    return results


def input_digests(rows: DataFrame, ordinal_col: str = "ordinal", input_col: str = "input") -> DataFrame:
    return rows.select(ordinal_col, F.octet_length(input_col).alias("n_bytes"), F.sha2(input_col, 256).alias("sha256"))


def input_only_violations(rows: DataFrame, seen: DataFrame, ordinal_col: str = "ordinal") -> DataFrame:
    """Ordinals at which the model was not given exactly the record's input; both sides in full."""
    given = seen.select(ordinal_col, F.col("n_bytes").alias("seen_bytes"), F.col("sha256").alias("seen_sha256"))
    both = input_digests(rows, ordinal_col).join(given, ordinal_col, "full")
    return both.where(~F.col("sha256").eqNullSafe(F.col("seen_sha256")) | ~F.col("n_bytes").eqNullSafe(F.col("seen_bytes"))).select(ordinal_col)
