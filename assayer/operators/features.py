"""TF-IDF of byte n-grams and linear scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ids that a worker takes up at once (of n-grams and features, one row at least), and distinct n-grams of an order that a task holds before it passes them on.
SLICE_IDS, MOST_HELD = 1 << 19, 1 << 20


def _opened(column: pa.Array) -> tuple[np.ndarray, Callable[[int, int], np.ndarray]]:
    """The bounds of the rows, and what gives the ids from one place to another. Of texts, the ids are the bytes plus one."""
    if isinstance(column, (pa.ListArray, pa.LargeListArray)):
        bounds, values, step = column.offsets.to_numpy().astype(np.int64), column.values, 0
    else:
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        values, step = pa.array(np.frombuffer(data or b"", np.uint8)), 1

    def ids(low: int, high: int) -> np.ndarray:
        own = values.slice(low, high - low).to_numpy(zero_copy_only=False).astype(np.int64)
        return own + step if step else own

    return bounds, ids


def _cuts(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of neighbouring rows with at most SLICE_IDS ids, or of one row."""
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SLICE_IDS, "right")) - 1)
        yield low, high
        pa.default_memory_pool().release_unused()
        low = high


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds) of each of _cuts."""
    bounds, ids = _opened(column)
    for low, high in _cuts(bounds):
        yield low, ids(bounds[low], bounds[high]), bounds[low : high + 1] - bounds[low]


def _keys(ids: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each run of n ids within a row; runs that hold padding (0) are left out."""
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    size = max(0, len(ids) - n + 1)
    keys, full = np.zeros(size, np.int64), row_of[:size] == row_of[n - 1 : n - 1 + size]
    for j in range(n):
        keys = keys * 257 + ids[j : j + size]
        full &= ids[j : j + size] != 0
    return row_of[:size][full], keys[full]


def _distinct(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and how often each occurs; low is under `most`."""
    bits = (most - 1).bit_length()
    packed = np.sort(high << bits | low)
    starts = np.flatnonzero(np.diff(packed, prepend=packed[:1] - 1))
    own = packed[starts]
    return own >> bits, own & ((1 << bits) - 1), np.diff(starts, append=len(packed))


def _counted(ids: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, tf) of the distinct n-grams of each row, in order."""
    row, key = _keys(ids, bounds, n)
    if len(bounds).bit_length() + (257**n - 1).bit_length() <= 63:
        return _distinct(row, key, 257**n)
    names, code = np.unique(key, return_inverse=True)
    row, code, tf = _distinct(row, code, max(1, len(names)))
    return row, names[code], tf


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of what each has in the parts."""
    keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[starts], np.add.reduceat(values, starts) if len(starts) else values


def _of_long_row(ids: Callable[[int, int], np.ndarray], first: int, after: int, n: int) -> Iterator[np.ndarray]:
    """The distinct keys of one row, each once, in order and in parts; the row is read in pieces of SLICE_IDS ids.

    Where a row has more than MOST_HELD distinct keys, the largest are left to a further reading.
    """
    least, top, part = 0, 257**n, max(1, MOST_HELD // 4)
    while least < top:
        below, held = top, np.zeros(0, np.int64)
        for at in range(first, after, SLICE_IDS):
            # a run that begins in this piece may end in the next
            own = ids(at, min(after, at + SLICE_IDS + n - 1))
            key = _keys(own, np.array([0, len(own)]), n)[1]
            held = np.sort(np.concatenate([held, np.sort(key[(key >= least) & (key < below)])]), kind="stable")
            held = held[np.flatnonzero(np.diff(held, prepend=-1))]
            if len(held) > MOST_HELD:
                below, held = int(held[MOST_HELD]), held[:MOST_HELD].copy()
        for at in range(0, len(held), part):
            yield held[at : at + part]
        least = below


def _checked(rows: DataFrame, orders: tuple[int, ...], ids_col: str) -> DataFrame:
    if any(not 1 <= n <= 7 for n in orders):
        raise ValueError("keys in base 257 hold 1 to 7 ids")
    return rows.where(F.col(ids_col).isNotNull())


def ngrams(ids: DataFrame, orders: tuple[int, ...] = (1, 2, 3, 4), id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, n, key, tf): the n-grams of each row (as ngram_keys has them) and how often it has them; counted in the scan, a row for each distinct one.

    ids_col: ids (0 to 256), or texts, which stand for their byte ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, own, bounds in _slices(batch.column(1)):
                for n in orders:
                    row, key, tf = _counted(own, bounds, n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(np.full(len(row), n, np.int32)), pa.array(key), pa.array(tf)], names=["id", "n", "key", "tf"])

    kind = dict(ids.dtypes)[id_col]
    return _checked(ids, orders, ids_col).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, n int, key long, tf long")


def document_frequencies(ids: DataFrame, orders: tuple[int, ...] = (1, 2, 3, 4), ids_col: str = "ids") -> DataFrame:
    """(n, key, df): in how many rows each n-gram occurs; ids_col as in ngrams. Each task adds up its own rows before anything is shuffled, and reads long rows in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in orders}

        def passed(n: int) -> pa.RecordBatch:
            (found, df), held[n] = _added(held[n]), []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int32)), pa.array(found), pa.array(df)], names=["n", "key", "df"])

        def counted(rows: np.ndarray, ids: Callable[[int, int], np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if rows[-1] - rows[0] > SLICE_IDS:
                for found in _of_long_row(ids, rows[0], rows[-1], n):
                    yield found, np.ones(len(found), np.int64)
                return
            row, key = _keys(ids(rows[0], rows[-1]), rows - rows[0], n)
            names, code = (None, key) if len(rows).bit_length() + (257**n - 1).bit_length() <= 63 else np.unique(key, return_inverse=True)
            # a row counts once for each of its keys
            key, _, _ = _distinct(code, row, len(rows))
            found, df = np.unique(key, return_counts=True)
            yield found if names is None else names[found], df.astype(np.int64)

        for batch in batches:
            bounds, ids = _opened(batch.column(0))
            for low, high in _cuts(bounds):
                for n in orders:
                    for part in counted(bounds[low : high + 1], ids, n):
                        held[n].append(part)
                        if sum(len(k) for k, _ in held[n]) > MOST_HELD:
                            held[n] = [_added(held[n])]
                            if len(held[n][0][0]) > MOST_HELD // 2:
                                yield passed(n)
        for n in orders:
            if held[n]:
                yield passed(n)

    own = _checked(ids, orders, ids_col).select(F.col(ids_col).alias("ids"))
    return own.mapInArrow(run, "n int, key long, df long").groupBy("n", "key").agg(F.sum("df").alias("df"))


def vocabulary(grams: DataFrame, documents: int, min_df: int = 2, most: int = 200_000, kind: str = "float") -> DataFrame:
    """(n, key, df, idf, col): the `most` n-grams with the highest document frequency, numbered by (n, key). grams: of ngrams, or of document_frequencies; kind: the type of idf."""
    df = grams if "df" in grams.columns else grams.groupBy("n", "key").agg(F.count("*").alias("df"))
    kept = df.where(F.col("df") >= min_df).orderBy(F.desc("df"), "n", "key").limit(most)
    idf = (F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1).cast(kind)
    return kept.select("n", "key", "df", idf.alias("idf"), (F.row_number().over(Window.orderBy("n", "key")) - 1).alias("col"))


def tfidf(grams: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, col, val): sublinear term frequency times idf, with unit length by row. The vocabulary is bounded by its own `most`."""
    raw = grams.join(vocab.select("n", "key", "idf", "col"), ["n", "key"]).select("id", "col", ((1 + F.log("tf")) * F.col("idf")).alias("x"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, "id").select("id", "col", (F.col("x") / F.col("norm")).cast("float").alias("val"))


def tfidf_rows(rows: DataFrame, vocab: DataFrame, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, col, val) as tfidf(ngrams(rows), vocab) has them where each id has one row; nothing is shuffled, each worker holds the vocabulary.

    val has the type of the vocabulary's idf. The driver collects the vocabulary, which is bounded by its own `most`.
    """
    table = vocab.select("n", "key", "idf", "col").toArrow()
    of, key, idf, col = (table.column(c).to_numpy() for c in ("n", "key", "idf", "col"))
    orders = tuple(np.unique(of).tolist())
    parts = {}
    for n in orders:
        order = np.flatnonzero(of == n)
        order = order[np.argsort(key[order])]
        parts[n] = key[order], idf[order], col[order].astype(np.int32)
    shared = rows.sparkSession.sparkContext.broadcast(parts)
    kind, number = dict(rows.dtypes)[id_col], dict(vocab.dtypes)["idf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, own, bounds in _slices(batch.column(1)):
                found = []
                for n, (names, idfs, cols) in shared.value.items():
                    row, key, tf = _counted(own, bounds, n)
                    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                    known = names[at] == key
                    at = at[known]
                    found.append((row[known], cols[at], (1 + np.log(tf[known])) * idfs[at].astype(np.float64)))
                if found:
                    row, col, x = (np.concatenate(c) for c in zip(*found, strict=True))
                    order = np.argsort(row.astype(np.uint16) if len(bounds) <= 1 << 16 else row, kind="stable")
                    row, col, x = row[order], col[order], x[order]
                    val = x / np.sqrt(np.bincount(row, x * x, len(bounds) - 1))[row]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(col), pa.array(val.astype(np.float32) if number == "float" else val)], names=["id", "col", "val"])

    return _checked(rows, orders, ids_col).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, col int, val {number}")


def linear_scores(features: DataFrame, weights: DataFrame, biases: DataFrame) -> DataFrame:
    """(id, label, score): softmax over labels of the linear scores. weights: (col, label, w); biases: (label, pos, b)."""
    dots = features.join(weights, "col").groupBy("id", "label").agg(F.sum(F.col("val") * F.col("w")).alias("dot"))
    full = features.select("id").distinct().join(F.broadcast(biases)).join(dots, ["id", "label"], "left").select("id", "label", "pos", (F.coalesce("dot", F.lit(0.0)) + F.col("b")).alias("logit"))
    own = Window.partitionBy("id")
    shifted = full.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(own)))
    return shifted.select("id", "label", "pos", (F.col("e") / F.sum("e").over(own)).alias("score"))


def predictions(scores: DataFrame) -> DataFrame:
    """(id, predicted_label, score): the largest score, the first declared of equals."""
    return scores.groupBy("id").agg(F.min_by(F.struct("label", "score"), F.struct((-F.col("score")).alias("s"), "pos")).alias("x")).select("id", F.col("x.label").alias("predicted_label"), "x.score")


def train_linear(features: DataFrame, gold: DataFrame, labels: DataFrame, columns: int, l2: float = 1e-3, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(weights, biases) for linear_scores by multinomial logistic regression. features: (id, col, val); gold: (id, label); labels: (pos, label).

    Rows are sparse vectors; weights of zero are left out, and are written where the
    columns are, from the model that each worker holds (labels x columns numbers).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    spark = features.sparkSession
    sparse = F.udf(lambda x: Vectors.sparse(columns, [e["col"] for e in x], [e["val"] for e in x]), VectorUDT())
    rows = features.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("val").cast("double").alias("val")))).alias("x"))
    data = rows.join(gold, "id").join(labels, "label").select(sparse("x").alias("features"), F.col("pos").cast("double").alias("label"))
    model = LogisticRegression(family="multinomial", regParam=l2, maxIter=rounds, standardization=False).fit(data)
    order = {r["pos"]: r["label"] for r in labels.collect()}
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    known = [p for p in sorted(order) if p < matrix.shape[0]]
    shared = spark.sparkContext.broadcast((matrix, [order[p] for p in known]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, names = shared.value
        for batch in batches:
            cols = batch.column(0).to_numpy()
            part = weights[: len(names), cols]
            label, at = np.nonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(cols[at].astype(np.int32)), pa.array([names[k] for k in label.tolist()], pa.string()), pa.array(part[label, at])], names=["col", "label", "w"])

    weights = spark.range(columns).mapInArrow(spread, "col int, label string, w double")
    biases = spark.createDataFrame([(order[p], p, float(bias[p])) for p in known], "label string, pos int, b double")
    return weights, biases
