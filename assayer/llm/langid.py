"""Language identification in two steps: the family, then the language within it.

Features are shares of byte n-grams of the lower-cased letters, hashed. Families are
not given: languages whose mean vectors lie close together are clustered. Linear
support vector machines, one for each pair, tell the families apart, and within a
family its languages.

Learning reads a sample of at most `per_language` distinct texts of each language (those
with the smallest hashes within a share of the hash range, so that the same rows are
drawn whatever the partitions); every language that has a row with letters is learned.
Prediction is one map over Arrow batches: since the machines are
linear, a document's margins are means of its n-grams' weights, and no vector is
built.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices

BITS = 16
ORDERS = (1, 2, 3, 4)
SCALE = 30.0
UNKNOWN = "und"
#: Bytes that are no letters count as one blank; those of longer characters stay.
LETTER = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams (by order) at each byte of all texts, whether the byte counts, and where each text starts."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    if isinstance(lower, pa.ChunkedArray):
        lower = lower.combine_chunks()
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    raw = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    b = LETTER[raw].astype(np.uint32)
    before, out, key = b, [], b.copy()
    starts = bounds[:-1][np.diff(bounds) > 0]
    for n in ORDERS:
        if n > 1:
            before = np.concatenate([np.full(1, 32, np.uint32), before[:-1]]) if len(before) else before
            before[starts] = 32
            key = key | (before << np.uint32(8 * (n - 1)))
        out.append(((key * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out, b != 32, bounds


def vectors(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: places and values."""
    grams, counts, bounds = _grams(texts)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        use = counts[low:high]
        ids, n = np.unique(np.concatenate([g[low:high][use] for g in grams]), return_counts=True)
        yield ids.astype(np.int32), (n * (SCALE / max(1, use.sum()))).astype(np.float32)


def support_vector_machine(rows: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear machine with the squared hinge loss, by dual coordinate descent; sides are +1 and -1."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(1 << BITS), 0.0
    square = np.array([float((v.astype(float) ** 2).sum()) + 1.0 for _, v in rows])
    n = np.array([(sides == s).sum() for s in (-1, 1)], float)
    costs = np.where(sides > 0, cost * n.sum() / (2 * n[1]), cost * n.sum() / (2 * n[0]))
    alpha = np.zeros(len(rows))
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            ids, values = rows[i]
            margin = sides[i] * (float(w[ids] @ values) + bias)
            slope = margin - 1 + alpha[i] / (2 * costs[i])
            new = max(0.0, alpha[i] - slope / (square[i] + 1 / (2 * costs[i])))
            if new != alpha[i]:
                step = (new - alpha[i]) * sides[i]
                w[ids] += step * values
                bias += step
                alpha[i] = new
    return w, bias


def families(centres: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages by average linkage of cosines; merged while closer than the mean over all pairs."""
    names = sorted(centres)
    unit = {k: v / (np.linalg.norm(v) or 1) for k, v in centres.items()}
    close = {(a, b): float(unit[a] @ unit[b]) for a in names for b in names}
    groups = [[k] for k in names]
    pairs = [close[a, b] for a, b in itertools.combinations(names, 2)]
    least = float(np.mean(pairs)) if pairs else 1.0
    while len(groups) > 1:
        linked = {(i, j): float(np.mean([close[a, b] for a in groups[i] for b in groups[j]])) for i, j in itertools.combinations(range(len(groups)), 2)}
        (i, j), best = max(linked.items(), key=lambda x: (x[1], x[0]))
        if best <= least:
            break
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
    return groups


@dataclass
class Model:
    """Machines: (group of classes, class if positive, class if negative), a column of weights and a bias each."""

    groups: list[list[str]]
    machines: list[tuple[int, int, int]]  # (-1 for families, else the family), positive, negative
    weights: np.ndarray
    biases: np.ndarray

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
        centres: dict[str, np.ndarray] = {}
        for (ids, values), lang in zip(rows, langs, strict=True):
            np.add.at(centres.setdefault(lang, np.zeros(1 << BITS)), ids, values)
        groups = families(centres)
        of = {lang: (g, k) for g, group in enumerate(groups) for k, lang in enumerate(group)}
        machines, weights, biases = [], [], []

        def add(kind: int, positive: int, negative: int, side: np.ndarray) -> None:
            use = np.flatnonzero(side)
            w, bias = support_vector_machine([rows[i] for i in use], side[use])
            machines.append((kind, positive, negative))
            weights.append(w)
            biases.append(bias)

        family = np.array([of[x][0] for x in langs])
        place = np.array([of[x][1] for x in langs])
        for a, b in itertools.combinations(range(len(groups)), 2):
            add(-1, a, b, (family == a) * 1 - (family == b) * 1)
        for g, group in enumerate(groups):
            for a, b in itertools.combinations(range(len(group)), 2):
                add(g, a, b, (family == g) * ((place == a) * 1 - (place == b) * 1))
        return Model(groups, machines, np.stack(weights, 1).astype(np.float32) if weights else np.zeros((1 << BITS, 0), np.float32), np.array(biases))

    def margins(self, texts: pa.Array) -> np.ndarray:
        grams, counts, bounds = _grams(texts)
        total = np.zeros((len(bounds) - 1, self.weights.shape[1]))
        n = np.diff(np.concatenate([[0], np.cumsum(counts)])[bounds])
        for g in grams:
            for m in range(self.weights.shape[1]):
                got = np.where(counts, self.weights[:, m][g], np.float32(0))
                total[:, m] += np.diff(np.concatenate([[0.0], np.cumsum(got, dtype=float)])[bounds])
        return total * (SCALE / np.maximum(1, n))[:, None] + self.biases

    def _vote(self, margins: np.ndarray, kind: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """The class with most duels won (ties: the larger sum of margins), and its least margin in them."""
        votes, least = np.zeros((len(margins), classes)), np.full((len(margins), classes), 20.0)
        for m, (of, a, b) in enumerate(self.machines):
            if of == kind:
                x = margins[:, m]
                votes[:, a] += (x >= 0) + 1e-3 * np.tanh(x)
                votes[:, b] += (x < 0) - 1e-3 * np.tanh(x)
                least[:, a], least[:, b] = np.minimum(least[:, a], x), np.minimum(least[:, b], -x)
        best = votes.argmax(1)
        return best, least[np.arange(len(best)), best]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        margins = self.margins(texts)
        family, sure = self._vote(margins, -1, len(self.groups))
        langs = np.empty(len(margins), object)
        for g, group in enumerate(self.groups):
            best, own = self._vote(margins, g, len(group))
            mine = family == g
            langs[mine] = np.array(group, object)[best[mine]]
            sure[mine] = np.minimum(sure[mine], own[mine])
        return langs.tolist(), 1 / (1 + np.exp(-2 * np.clip(sure, -20, 20)))


def learn(df: DataFrame, id_col: str, text_col: str = "text", lang_col: str = "lang", per_language: int = 1_000) -> Model | None:
    """A model from the rows of df that have a language and a letter; None if there are none.

    The sample takes at most `per_language` rows of each language, by hash of the id and
    the text; of rows that repeat it takes one. (A language whose rows are all drawn
    late in the hash range still has some: the share is twice what is needed.)
    """
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col, F.lit(17)).alias("hash")).where(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * per_language / max(1, r["n"]))))])
    place = F.pmod("hash", F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(place < share[F.col("lang")]).dropDuplicates(["lang", "hash"])
    first = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash")
    sample = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                found = list(vectors(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["lang", "ids", "values"])

    got = sample.mapInArrow(run, "lang string, ids binary, values binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], r["ids"]))
    if not got:
        return None
    return Model.fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["values"], np.float32)) for r in got], [r["lang"] for r in got])


def predict(df: DataFrame, model: Model | None, keys: list[str | Column], text_col: str = "text") -> DataFrame:
    """The key columns, lang_pred and score (0 to 1) of every row's whole text.

    Null texts, and texts without a letter, are `und` with score 0, as are all without a
    model. Very long texts are read whole. Of languages with equally many duels and equal
    margins the first in its family wins. Rows are neither dropped nor merged; an empty table gives no rows. Other
    columns of df are not read.
    """
    own = df.select(*keys, F.col(text_col).cast("string").alias("__text"))
    names = own.columns[:-1]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names), 4 << 20):
                texts = part.column(len(names))
                known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
                langs, sure = shared.value.predict(texts) if shared.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                langs = [x if k else UNKNOWN for x, k in zip(langs, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(langs, pa.string()), pa.array(np.where(known, sure, 0.0), pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*[f"`{n}` {t}" for n, t in own.dtypes[:-1]], "lang_pred string, score double"])
    return own.mapInArrow(run, schema)
