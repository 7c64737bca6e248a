"""Language-model scores by deleted interpolation.

The chance of a token after another mixes maximum-likelihood estimates: of the
pair, of the word, a uniform one over the vocabulary, and one that stands for a word
outside of the vocabulary (all such words are one event, as in the base score). The
mixture weights depend on how often the context was seen (buckets of its frequency)
and are learned by expectation-maximisation on counts held out of the estimates, a
share of the training documents; the final estimates use all training documents.

Data flow. One scan turns each slice of documents into a block: its distinct words,
and its token places. The counts of words and of pairs of words, all of them, are
added up in the block first and travel packed: a row for each block and range of the
hashes, sorted, is answered by a row with the sums in the same order. A block asks
for a word or a pair once, however often it has it, so a frequent one costs a number
for each block, and ranges are even. Texts are not shuffled, and no table of words
or pairs is collected or broadcast. What reaches the driver is a histogram of the
held-out tokens: by bucket, and by the two estimates in steps of 1/40 of a decade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import expand, expand_hashes, slices, squeeze, squeeze_hashes, sums
from .common import release, settle, sweep

BUCKETS = 32
SLICE = 12 << 20
#: Tokens that are turned into floating-point numbers at a time.
STEP = 1 << 19
#: The end of a text, in the vocabulary of each block; no token holds a line feed.
END = b"\n"
#: What a pair's or a word's estimate of zero is binned as.
NONE = -999

BLOCK = "block long, doc array<long>, role array<int>, n array<int>, at binary, words binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice. Input: key, text, role (0 training, 1 training but held out of the estimates, 2 not training).

    `at` holds the word of each token, an end after each text; `words` the distinct words, each before a blank, the end last.
    """
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for part in slices(batch, 1, SLICE):
            texts = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(part.column(1), "")), "[\t-\r]", " ")
            texts = pc.binary_join_element_wise(texts, "\n", " ")
            split = pc.split_pattern(texts, " ")
            coded = split.values.dictionary_encode()
            words = coded.dictionary.to_pylist()
            places = coded.indices.to_numpy(zero_copy_only=False)
            # words are numbered by frequency, which keeps the numbers small; the end comes last
            times = np.bincount(places, minlength=len(words))
            by_times = [i for i in np.argsort(-times, kind="stable").tolist() if words[i] and words[i] != "\n"]
            number_of = np.full(len(words), len(by_times))
            number_of[by_times] = np.arange(len(by_times))
            keep = np.array([bool(w) for w in words], bool)[places]
            n = sums(keep.astype(np.int64), split.offsets.to_numpy().astype(np.int64))
            at = number_of[places[keep]].astype("<i4")
            role = part.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([role.tolist()], pa.list_(pa.int32())),
                    pa.array([n.tolist()], pa.list_(pa.int32())),
                    pa.array([squeeze(at)], pa.binary()),
                    pa.array(["".join(words[i] + " " for i in by_times).encode() + END], pa.binary()),
                ],
                names=["block", "doc", "role", "n", "at", "words"],
            )
            number += 1
            pa.default_memory_pool().release_unused()


def _hashes(words: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.split(b" ")], np.uint64)


def _contexts(at: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate([[end], at[:-1]])


def _pair_keys(hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A hash for each pair of words, numbered as before * len(hashes) + word."""
    h, w = hashes[found // len(hashes)], hashes[found % len(hashes)]
    return (h * np.uint64(0x9E3779B97F4A7C15)) ^ ((w << np.uint64(29)) | (w >> np.uint64(35)))


WORD, PAIR = 0, 1
ASKED = "block long, kind int, part int, keys binary, main binary, left binary"
ANSWER = "block long, kind int, part int, m binary, c binary, n long, n_main long, vocabulary long"


def asked_by(ranges: int):
    """Maps blocks to their distinct words and pairs with counts, a row for each of so many ranges of the hashes."""

    def cut(block: int, kind: int, keys: np.ndarray, main: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys)
        keys, main, left = keys[order], main[order], left[order]
        of = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        asked, starts = np.unique(of, return_index=True)
        cuts = [*zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)]
        columns = [[squeeze_hashes(keys[a:b]) for a, b in cuts], *([squeeze(x[a:b]) for a, b in cuts] for x in (main, left))]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(asked), block)), pa.array(np.full(len(asked), kind, np.int32)), pa.array(asked.astype(np.int32)), *(pa.array(x, pa.binary()) for x in columns)],
            names=["block", "kind", "part", "keys", "main", "left"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, role, n, at, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = _hashes(words)
                at = expand(at).astype(np.int64)
                role = np.repeat(np.array(role, np.int8), np.array(n, np.int64))
                yield cut(block, WORD, hashes, *(np.bincount(at[role == r], minlength=len(hashes)) for r in (0, 1)))
                found, inverse = np.unique(_contexts(at, len(hashes) - 1) * len(hashes) + at, return_inverse=True)
                yield cut(block, PAIR, _pair_keys(hashes, found), *(np.bincount(inverse[role == r], minlength=len(found)) for r in (0, 1)))

    return run


def _added(rows: pa.Table) -> pa.Table:
    """Answers the blocks' questions about one range: m and c of each word or pair that a block asked for, in its order; totals of the range's words come as the answer to a block of their own."""
    kind, part = rows["kind"][0].as_py(), rows["part"][0].as_py()
    asked = [expand_hashes(x) for x in rows["keys"].to_pylist()]
    found, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    main, left = (np.bincount(inverse, np.concatenate([expand(x) for x in rows[k].to_pylist()]), len(found)).astype(np.int64) for k in ("main", "left"))
    ends = np.cumsum([len(x) for x in asked]).tolist()
    which = [inverse[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    m, c = ([squeeze(x[i]) for i in which] for x in (main, main + left))
    block, none = rows["block"].to_pylist(), [None] * len(m)
    totals = [none, none, none]
    if kind == WORD:
        block, m, c = [*block, -1 - part], [*m, None], [*c, None]
        totals = [[*none, int(x)] for x in ((main + left).sum(), main.sum(), np.count_nonzero(main + left))]
    columns = [pa.array(block, pa.int64()), pa.array([kind] * len(block), pa.int32()), pa.array([part] * len(block), pa.int32()), pa.array(m, pa.binary()), pa.array(c, pa.binary()), *(pa.array(x, pa.int64()) for x in totals)]
    return pa.Table.from_arrays(columns, names=["block", "kind", "part", "m", "c", "n", "n_main", "vocabulary"])


MET = "doc array<long>, role array<int>, n array<int>, c binary, p binary, end long, cm binary, pm binary, end_m long, total long, n_main long, vocabulary long"


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block with the counts at its tokens: c of the word, p of the pair, end of the end; for held-out documents also cm, pm, end_m, without what is held out. A row of totals is handed on."""
    schema = pa.schema([*(("doc", pa.list_(pa.int64())), ("role", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))), *((k, pa.binary()) for k in ("c", "p")), ("end", pa.int64()), *((k, pa.binary()) for k in ("cm", "pm")), *((k, pa.int64()) for k in ("end_m", "total", "n_main", "vocabulary"))])
    if not left.num_rows:
        return pa.Table.from_pylist([{"total": r["n"], "n_main": r["n_main"], "vocabulary": r["vocabulary"]} for r in right.select(["n", "n_main", "vocabulary"]).to_pylist()], schema)
    answers = sorted(zip(*(right[k].to_pylist() for k in ("kind", "part", "m", "c")), strict=True), key=lambda x: x[:2])
    word_m, word_c, pair_m, pair_c = (np.concatenate([expand(x[k]) for x in answers if x[0] == kind]).astype(np.int64) for kind in (WORD, PAIR) for k in (2, 3))
    row = {k: left[k][0].as_py() for k in ("doc", "role", "n", "at", "words")}
    hashes, at = _hashes(row["words"]), expand(row["at"]).astype(np.int64)
    size, order = len(hashes), np.argsort(hashes)
    by_word = np.empty((2, size), np.int64)
    by_word[:, order] = word_m, word_c
    word_m, word_c = by_word
    found, inverse = np.unique(_contexts(at, size - 1) * size + at, return_inverse=True)
    rank = np.empty(len(found), np.int64)
    rank[np.argsort(_pair_keys(hashes, found))] = np.arange(len(found))
    place = rank[inverse]
    held = np.repeat(np.array(row["role"]) == 1, np.array(row["n"], np.int64))
    c, p, cm, pm = (squeeze(a) for a in (word_c[at], pair_c[place], word_m[at[held]], pair_m[place[held]]))
    out = {"doc": row["doc"], "role": row["role"], "n": row["n"], "c": c, "p": p, "end": int(word_c[size - 1]), "cm": cm, "pm": pm, "end_m": int(word_m[size - 1])}
    return pa.Table.from_pylist([out], schema)


def _bucket(h: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(h.astype(float) + 1).astype(np.int64), BUCKETS - 1)


def _bins(total: int):
    """Histogram of held-out tokens by context bucket, binned log10 estimate of the pair and of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, p, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                c, p = expand(c).astype(float), expand(p).astype(float)
                if not len(c):
                    continue
                h = _contexts_of(c, end)
                with np.errstate(divide="ignore", invalid="ignore"):
                    pair = np.where(p > 0, np.round(40 * np.log10(p / h)), NONE).astype(np.int64)
                    one = np.where(c > 0, np.round(40 * np.log10(c / total)), NONE).astype(np.int64)
                found, n = np.unique((_bucket(h) << 40) + ((pair + 1000) << 20) + (one + 1000), return_counts=True)
                parts = (found >> 40, ((found >> 20) & 0xFFFFF) - 1000, (found & 0xFFFFF) - 1000, n)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in parts], names=["bucket", "pair", "word", "n"])

    return run


def _contexts_of(c: np.ndarray, end: float) -> np.ndarray:
    """Count of the word before each token; an end stands before the first token of a block, as after each text."""
    return np.concatenate([[float(end)], c[:-1]])


def learn_weights(rows: list, vocabulary: int, rounds: int = 80) -> np.ndarray:
    """Weights (pair, word, uniform, new word) by context bucket, by expectation-maximisation over the binned held-out tokens."""
    weights = np.tile([0.3, 0.6, 0.05, 0.05], (BUCKETS, 1))
    if not rows:
        return weights
    bucket, pair, word, n = np.array([[r["bucket"], r["pair"], r["word"], r["n"]] for r in rows]).T
    chances = np.stack([np.where(pair > NONE, 10.0 ** (pair / 40), 0), np.where(word > NONE, 10.0 ** (word / 40), 0), np.full(len(n), 1 / (vocabulary + 1)), (word == NONE).astype(float)], 1)
    prior = np.array([0.3, 0.6, 0.05, 0.05])
    for _ in range(rounds):
        parts = weights[bucket] * chances
        parts *= (n / parts.sum(1))[:, None]
        sums_ = np.stack([np.bincount(bucket, parts[:, k], BUCKETS) for k in range(4)], 1)
        overall = sums_.sum(0) + prior
        prior = overall / overall.sum()
        weights = sums_ + 5 * prior  # a bucket with few tokens leans on all buckets
        weights /= weights.sum(1, keepdims=True)
    return weights


def score(df: DataFrame, train: Column, left_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row's whole text with a model of the rows where `train` holds.

    `left_out` names the training rows whose counts are held out of the estimates
    while the weights are learned. Returns doc_id, held_out (not a training row),
    n_tokens, n_known, train_tokens, base_score, score. Tokens are the runs between
    ASCII white space, A-Z in lower case, and one end per text. A null text is empty;
    a null id is a null doc_id; where train is null the row is no training row. Repeated
    rows are scored and counted as often as they occur. Without training rows each token
    is a new word, and its scores are those of the empty model. A very long text is a
    block of its own and is scored whole. An empty table gives no rows. Other columns of
    df are not read.
    """
    role = F.when(~F.coalesce(train, F.lit(False)), 2).when(F.coalesce(left_out, F.lit(False)), 1).otherwise(0)
    spark = df.sparkSession
    blocks = settle(df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), role.cast("int").alias("role")).mapInArrow(_blocks, BLOCK))
    # a range has some two million words or pairs, however many blocks ask
    tokens = blocks.agg(F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)")).alias("n")).first()["n"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens >> 21)
    asked = blocks.select("block", "role", "n", "at", "words").mapInArrow(asked_by(ranges), ASKED)
    answers = settle(asked.groupBy("kind", "part").applyInArrow(_added, ANSWER))
    sweep(spark)
    met = settle(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_meet, MET))
    release(blocks, answers)
    sweep(spark)
    total = met.where("total is not null").agg(F.sum("total").alias("n"), F.sum("n_main").alias("m"), F.sum("vocabulary").alias("v")).first()
    n_train, n_main, vocabulary = int(total["n"] or 0), int(total["m"] or 0), int(total["v"] or 0)
    met = met.where("total is null")
    left = met.select("cm", "pm", "end_m").mapInArrow(_bins(max(1, n_main)), "bucket long, pair long, word long, n long")
    weights = learn_weights(left.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect() if n_main else [], vocabulary)
    base_of, unknown = n_train + 0.5 * (vocabulary + 1), 1 / (vocabulary + 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, roles, n, c, p, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                c, p = expand(c), expand(p)
                before = np.concatenate([[end], c[:-1]])
                base, chance = np.empty(len(c)), np.empty(len(c))
                for low in range(0, len(c), STEP):
                    part = slice(low, low + STEP)
                    here, h = c[part].astype(float), before[part].astype(float)
                    w = weights[_bucket(h)]
                    base[part] = np.log10((here + 0.5) / base_of)
                    chance[part] = np.log10(w[:, 0] * p[part] / np.maximum(h, 1) + w[:, 1] * here / max(1, n_train) + w[:, 2] * unknown + w[:, 3] * (here == 0))
                bounds = np.concatenate([[0], np.cumsum(np.array(n, np.int64))])
                values = (docs, [r == 2 for r in roles], n, sums((c > 0).astype(np.int64), bounds), _sums_of(base, bounds), _sums_of(chance, bounds))
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    done = met.select("doc", "role", "n", "c", "p", "end").mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between neighbouring bounds, none of them empty, each added up by itself."""
    return np.add.reduceat(values, bounds[:-1]) if len(values) else np.zeros(len(bounds) - 1)
