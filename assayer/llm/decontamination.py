"""Benchmark passages in documents by SimHash of item-sized windows.

A window of a document is as long as the item it may hold. Windows and items have
128-bit SimHash fingerprints of their word shingles, weighted by how often they occur.
The items' fingerprints are indexed by eight blocks of 16 bits; a window looks up each
of its blocks with up to four bits flipped, which by the pigeonhole principle finds
every item within a Hamming distance of 39. What is found is verified exactly, by the
cosine similarity of the shingles, weighted by their frequency and, if the item has
them, their inverse frequency among all texts of the benchmark (what the item does not
have weighs as what one text has). So neither a similarity nor a fingerprint depends on
which items are looked up together.

Only windows that are lined up with an item by a shingle of it are fingerprinted, since
without a shared shingle the similarity is zero; from the best of them the window moves
on to where the similarity is largest. Equal texts of the benchmark are one. They are
taken in blocks of a bounded number and size, each broadcast; documents are read where
they lie, whole, without a shuffle, once a block.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .common import release, settle
from .shingles import mixed, shingles, windows, word_hashes

BLOCKS, FLIPS = 8, 4
RADIUS = BLOCKS * (FLIPS + 1) - 1
MASKS = np.array([sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in itertools.combinations(range(16), n)], np.uint16)
#: How far below the threshold the similarity of a lined-up window may be for it to be moved, and bytes of a block's texts.
NEAR, BLOCK_BYTES = 0.25, 64 << 20


def signs(found: np.ndarray) -> np.ndarray:
    """(shingles, 128) of +1 and -1, from the shingles' hashes."""
    both = np.stack([mixed(found), mixed(found ^ np.uint64(0x9E3779B97F4A7C15))], 1)
    bits = np.unpackbits(np.ascontiguousarray(both).view(np.uint8).reshape(len(found), 16), axis=1)
    return bits.astype(np.float32) * 2 - 1


def fingerprint(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SimHash as eight blocks of 16 bits."""
    return np.packbits(weight @ signs(found) > 0).view(np.uint16)


class HammingIndex:
    """All fingerprints within RADIUS of one."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        for k in range(BLOCKS):
            order = np.argsort(prints[:, k], kind="stable")
            bounds = np.searchsorted(prints[order, k], np.arange((1 << 16) + 1))
            self.tables.append((order, bounds[:-1], bounds[1:], np.diff(bounds) > 0))

    def near(self, one: np.ndarray) -> np.ndarray:
        found = []
        for k, (order, low, high, filled) in enumerate(self.tables):
            probes = MASKS ^ one[k]
            for p in probes[filled[probes]].tolist():
                found.append(order[low[p] : high[p]])
        if not found:
            return np.zeros(0, np.int64)
        which = np.unique(np.concatenate(found))
        distance = np.bitwise_count(self.prints[which] ^ one).sum(1)
        return which[distance <= RADIUS]


class Benchmark:
    """Texts with words: shingles, weights, fingerprints, and where each shingle stands in them.

    total is the number of texts in the whole benchmark, and frequencies says how many of
    them have a shingle, where more than one has it; both are those of these texts if
    nothing else is known.
    """

    def __init__(self, ids: list, texts: list[str | None], size: int, total: int | None = None, frequencies: dict[int, int] | None = None):
        words, bounds = word_hashes(pa.array(texts, pa.string()))
        own = [words[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        use = [i for i, w in enumerate(own) if len(w)]
        self.size, self.ids = size, [ids[i] for i in use]
        self.lengths = [len(own[i]) for i in use]
        runs = [shingles(own[i], size) for i in use]
        distinct = [np.unique(r, return_counts=True) for r in runs]
        self.every, df = np.unique(np.concatenate([d for d, _ in distinct]) if use else np.zeros(0, np.uint64), return_counts=True)
        if frequencies is not None:
            df = np.array([frequencies.get(int(np.int64(h.view(np.int64))), 1) for h in self.every], np.int64)
        total = len(use) if total is None else total
        idf, self.rare = 1 + np.log((1 + total) / (1 + df)), 1 + math.log((1 + total) / 2)
        self.bags = [(d, n, idf[np.searchsorted(self.every, d)]) for d, n in distinct]
        self.norms = [float(np.sqrt(((n * w) ** 2).sum())) for _, n, w in self.bags]
        self.index = HammingIndex(np.stack([fingerprint(d, n) for d, n, _ in self.bags]) if use else np.zeros((0, BLOCKS), np.uint16))
        #: For a shingle, the places it has in texts and the lengths of these.
        self.places: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for length, run in zip(self.lengths, runs, strict=True):
            for j, h in enumerate(run.tolist()):
                self.places[h].add((j, length))
        #: Lengths of shingles: shorter items are one shingle of all their words.
        self.sizes = sorted({min(size, n) for n in self.lengths})
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.every >> np.uint64(44)).astype(np.int64)] = True

    def similarity(self, bag: tuple[np.ndarray, np.ndarray], item: int) -> float:
        """Cosine of a window's shingles (and how often it has them) and an item's."""
        own, n, idf = self.bags[item]
        _, ia, ib = np.intersect1d(bag[0], own, assume_unique=True, return_indices=True)
        shared = bag[1][ia] * idf[ib]
        rest = float((bag[1].astype(float) ** 2).sum() - (bag[1][ia].astype(float) ** 2).sum()) * self.rare**2
        norm = math.sqrt(float((shared**2).sum()) + rest) * self.norms[item]
        return float((shared * n[ib] * idf[ib]).sum()) / norm if norm else 0.0

    def hits(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each shingle length: places in words whose shingle an item has, and the shingles there."""
        out = []
        for n in self.sizes:
            runs = windows(words, n)
            at = np.flatnonzero(self.filter[(runs >> np.uint64(44)).astype(np.int64)])
            found = np.searchsorted(self.every, runs[at])
            at = at[self.every[np.minimum(found, len(self.every) - 1)] == runs[at]]
            out.append((n, at, runs[at]))
        return out

    def matches(self, words: np.ndarray, hits: list[tuple[int, np.ndarray, np.ndarray]], threshold: float) -> dict[int, tuple[float, int, int]]:
        """Best (similarity, first word, words) of each item in one text, for items at or above the threshold. hits: places within words."""
        wanted = set()
        for n, at, found in hits:
            for i, h in zip(at.tolist(), found.tolist(), strict=True):
                for j, length in self.places[h]:
                    if min(self.size, length) == n and length <= len(words) + length // 2:
                        wanted.add((max(0, min(i - j, len(words) - length)), min(length, len(words))))

        def bag(start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
            return np.unique(shingles(words[start : start + length], self.size), return_counts=True)

        best: dict[int, tuple[float, int, int]] = {}
        for start, length in sorted(wanted):
            own = bag(start, length)
            for item in self.index.near(fingerprint(*own)).tolist():
                like = self.similarity(own, item)
                if like >= threshold - NEAR and like > best.get(item, (0.0, 0, 0))[0]:
                    best[item] = (like, start, length)
        for item, (like, start, length) in best.items():
            last, moved = len(words) - length, like < 1 - 1e-9
            while moved:
                moved = False
                for s in range(max(0, start - self.size), min(last, start + self.size) + 1):
                    other = self.similarity(bag(s, length), item)
                    if other > like + 1e-12:
                        like, start, moved = other, s, True
            best[item] = (like, start, length)
        return {item: x for item, x in best.items() if x[0] >= threshold}


def _key(text: str) -> Column:
    return F.md5(F.col(text).cast("binary"))


def _blocks(benchmark: DataFrame, text_col: str, size: int, block_items: int) -> Iterator:
    """Broadcast benchmarks of about block_items texts each, and at least one; a text goes by its key."""
    texts = settle(benchmark.select(F.col(text_col).cast("string").alias("text")).where("text is not null").distinct().withColumn("key", _key("text")))

    def distinct_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = word_hashes(batch.column(0))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.unique(shingles(words[a:b], size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), b > a))], names=["hash", "some"])

    counted = settle(texts.select("text").mapInArrow(distinct_shingles, "hash long, some boolean").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    seen = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-seen["n"] // block_items), -(-(seen["bytes"] or 0) // BLOCK_BYTES))
    total = texts.where(F.col("text").rlike(r"[\p{L}\p{N}]")).count()
    for k in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k)
        rows = sorted(mine.collect(), key=lambda r: r["key"])
        own = mine.select("text").mapInArrow(distinct_shingles, "hash long, some boolean").select("hash").distinct()
        frequencies = {r["hash"]: r["n"] for r in counted.join(own, "hash").collect()}
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark([r["key"] for r in rows], [r["text"] for r in rows], size, total, frequencies))
    release(texts, counted)


def _found(bench: Benchmark, texts: pa.Array, threshold: float) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    """(row, best window of each item that it holds) for the rows that hold one."""
    if not bench.ids:
        return
    words, bounds = word_hashes(texts)
    hits = bench.hits(words)
    for r in sorted({int(r) for _, at, _ in hits for r in np.unique(np.searchsorted(bounds, at, "right") - 1)}):
        low, high = int(bounds[r]), int(bounds[r + 1])
        mine = []
        for n, at, found in hits:
            a, b = np.searchsorted(at, [low, max(low, high - n + 1)])
            mine.append((n, at[a:b] - low, found[a:b]))
        if best := bench.matches(words[low:high], mine, threshold):
            yield r, best


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, threshold: float = 0.8, block_items: int = 20_000) -> DataFrame:
    """One row for each row of df and item that it holds: doc_id, item_id, similarity, start_word, n_words (of the best window; of equally good ones the first found).

    Items without words, and texts without words, match nothing; an item shorter than
    `size` words matches a run of the same words; very long texts and items are read
    whole. Repeated rows give repeated results, null ids stay null; items with the same
    text are each reported. Empty tables give no rows. Other columns are not read. The
    benchmark is read in blocks of `block_items` distinct texts, of which each is broadcast.
    """
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _blocks(benchmark, item_text_col, size, block_items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    rows = [(part.column(0)[r].as_py(), shared.value.ids[item], *best) for r, found in _found(shared.value, part.column(1), threshold) for item, best in sorted(found.items())]
                    types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "key", "similarity", "start_word", "n_words"])

        more = own.mapInArrow(run, "doc_id long, key string, similarity double, start_word long, n_words long")
        out = more if out is None else out.unionByName(more)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    return out.join(items.select("item_id", _key("text").alias("key")), "key").select("doc_id", "item_id", "similarity", "start_word", "n_words")


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", size: int = 5, threshold: float = 0.8, block_items: int = 20_000) -> DataFrame:
    """The rows of df, with all their columns, that hold no item of the benchmark; null and empty texts stay, and so do all rows if the benchmark is empty."""
    at = df.columns.index(text_col)
    for shared in _blocks(benchmark, item_text_col, size, block_items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at):
                    keep = np.ones(part.num_rows, bool)
                    for r, _ in _found(shared.value, part.column(at), threshold):
                        keep[r] = False
                    yield part.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df
