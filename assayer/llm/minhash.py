"""Near-duplicate documents by consistent weighted sampling.

Texts are sets of word shingles weighted by term frequency times a damped inverse
document frequency. Improved consistent weighted sampling draws `bands` x `rows`
samples of a text, such that two texts share a sample with the chance of their
weighted Jaccard similarity. Texts that agree on all samples of a band are
candidates; each candidate pair is verified on the whole texts.

Exact copies (the same words in the same order) are one class from the start. In a
band, a class is paired with its bucket's leader only. Verified pairs give
components, and only then are groups that still hold several components looked at
again, with each member outside of the group's largest component against the
members of other components. The members are dealt into parts of a bounded size, a
part meets a part in a task of its own, and what comes out is a link for each two
components that it joins: so no link between different texts of a bucket is lost, a
bucket of very many copies costs a row for each, and no list of pairs is made.

Document frequencies are exact, by shingle: each block of documents adds up its own
and asks for the others' by ranges of the shingles' hashes, sorted and packed; a row
with the sums in the same order answers it. Documents are written once, in blocks
that hold their words as numbers, too, and only candidates' texts are fetched again;
every scratch table goes as soon as nothing reads it. Nothing that grows with the
documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import expand, expand_hashes, slices, squeeze, squeeze_hashes
from .common import release, settle, sweep
from .graph import components
from .shingles import by_text, mixed, word_codes, word_hashes

#: Most that an inverse document frequency adds to a shingle's weight of one.
DAMPING = 0.25
#: Bytes of text in a block, and how many shingles a range of hashes has at most, about.
BLOCK_BYTES, RANGE = 12 << 20, 1 << 21
#: Bits of a row's number for its place in its block.
PLACE = 20
#: Members of a group, and their weight, in a part, about.
SHARE, PART = 512, 1 << 18


def blocks_of(df: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """One row per block of documents: block, and arrays of doc_id, node, n (words), words (the text, see packed), and rest (the other columns of df) if whole.

    at holds which word stands where, as places in hashes. A node is a 128-bit hash of
    the words in order, null for a text without words.
    """
    others = [c for c in df.columns if c != text_col]
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    own = df.select(*columns, *[F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("rest")] * whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        block, codec = TaskContext.get().partitionId() << 16, pa.Codec("zstd", 1)
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                hashes, codes, bounds = word_codes(part.column(1))
                words = hashes[codes]
                nodes = [xxhash.xxh3_128_digest(words[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                texts = [None if t is None else packed(t, codec) for t in part.column(1).to_pylist()]
                lists = [part.column(0), pa.array(nodes, pa.binary()), pa.array(np.diff(bounds).astype(np.int32)), pa.array(texts, pa.binary()), *part.columns[2:]]
                one = pa.array([0, part.num_rows], pa.int32())
                coded = [pa.array([squeeze(codes)], pa.binary()), pa.array([hashes.astype("<u8").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), *coded, *(pa.ListArray.from_arrays(one, x) for x in lists)],
                    names=["block", "at", "hashes", "doc_id", "node", "n", "words", *["rest"] * whole],
                )
                block += 1

    rest = f", rest array<{dict(own.dtypes)['rest']}>" if whole else ""
    return own.mapInArrow(run, f"block long, at binary, hashes binary, doc_id array<long>, node array<binary>, n array<int>, words array<binary>{rest}")


def packed(text: str, codec: pa.Codec) -> bytes:
    """A text compressed, its length behind it."""
    raw = text.encode()
    return codec.compress(raw, asbytes=True) + len(raw).to_bytes(8, "little")


def rows_of(blocks: DataFrame, *columns: str) -> DataFrame:
    """(row, ...): a row for each document, with those of its block's lists; row is its number."""
    zipped = blocks.select("block", F.posexplode(F.arrays_zip(*columns)).alias("place", "x"))
    return zipped.select((F.shiftleft("block", PLACE) + F.col("place")).alias("row"), *[F.col("x")[c].alias(c) for c in columns])


def _own_bags(n: list[int], at: bytes, hashes: bytes, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and counts of the texts of a block that have words."""
    words = np.frombuffer(hashes, "<u8")[expand(at)]
    bounds = np.concatenate([[0], np.cumsum([x for x in n if x])]).astype(np.int64)
    return list(by_text(words, bounds, size))


def _bags(packed: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    codec = pa.Codec("zstd")
    words, bounds = word_hashes(pa.array([_text(x, codec) for x in packed], pa.binary()).cast(pa.string()))
    return list(by_text(words, bounds, size))


def _asked(ranges: int, size: int):
    """Maps blocks to their distinct shingles and how many of their documents have them, a row for each range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(found for found, _ in _own_bags(*words, size))]), return_counts=True)
                of = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                asked, starts = np.unique(of, return_index=True)
                cuts = [*zip(starts.tolist(), np.append(starts, len(keys))[1:].tolist(), strict=True)]
                packed = [pa.array([squeeze_hashes(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([squeeze(n[a:b]) for a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), block)), pa.array(asked.astype(np.int32)), *packed], names=["block", "part", "keys", "n"])

    return run


def _answered(rows: pa.Table) -> pa.Table:
    """Adds up the document frequencies of one range, and gives each block those that it asked for."""
    asked = [expand_hashes(x) for x in rows["keys"].to_pylist()]
    found, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([expand(x) for x in rows["n"].to_pylist()]), len(found)).astype(np.int64)
    ends = np.cumsum([len(x) for x in asked]).tolist()
    n = [squeeze(total[inverse[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.Table.from_arrays([rows["block"], rows["part"], pa.array(n, pa.binary())], names=["block", "part", "n"])


def idf_table(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Weights by document frequency: 1 for a shingle that all documents have, up to 1 + DAMPING."""
    n = max(2, documents)
    return (1 + DAMPING * np.log(n / np.clip(frequencies, 1, n)) / np.log(n)).astype(np.float32)


def exact_weights(counts: np.ndarray, frequencies: np.ndarray, documents: int) -> np.ndarray:
    return counts.astype(np.float32) * idf_table(frequencies, documents)


class Sampler:
    """Improved consistent weighted sampling: for each sample, a shingle's r and c (gamma with shape 2) and beta (uniform) come from its hash."""

    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = 1 << 16
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.odd = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, found: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, samples): the sample of each text; starts: where the texts, none of them empty, begin in found."""
        out = np.empty((len(starts), len(self.odd)), np.uint32)
        log_weight, place = np.log(weight), np.arange(len(found), dtype=np.uint64)
        low = np.uint64(0xFFFF)
        for k, odd in enumerate(self.odd):
            z = found * odd
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            i = (z >> np.uint64(48)).astype(np.int64)
            beta = ((z >> np.uint64(32)) & low).astype(np.float32) * np.float32(2**-16)
            r = self.r[i]
            t = np.floor(log_weight * self.inverse[i] + beta)
            value = self.log_c[((z >> np.uint64(16)) & low).astype(np.int64)] - r * (t - beta + 1)
            bits = value.view(np.uint32)
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))  # ordered as the numbers are
            best = (np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | place, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out[:, k] = (mixed(z[best] + t[best].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        return out


SKETCH = "row long, doc_id long, node binary, bands array<long>, mass double, df binary"


def _sketched(size: int, bands: int, rows: int, documents: int):
    """Maps a block and the document frequencies of its shingles to (row, doc_id, node, bands, mass, df)."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        sampler = Sampler(bands * rows)
        block, doc_ids, nodes, n, *words = (texts[k][0].as_py() for k in ("block", "doc_id", "node", "n", "at", "hashes"))
        own = _own_bags(n, *words, size)
        usable = [i for i, x in enumerate(n) if x]
        parts = sorted(zip(answers["part"].to_pylist(), answers["n"].to_pylist(), strict=True))
        frequencies = np.concatenate([np.zeros(0, np.int64), *(expand(x) for _, x in parts)])
        # most shingles have one document: the others are looked up
        repeated = np.flatnonzero(frequencies > 1)
        keys = np.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *(found for found, _ in own)]))[repeated], np.uint64(2**64 - 1))
        frequencies = np.append(frequencies[repeated], 1)
        samples, mass, dfs, pending, waiting = [], [], [], [], 0
        for i, (found, counts) in enumerate(own):
            at = np.searchsorted(keys, found)
            df = np.where(keys[at] == found, frequencies[at], 1)
            dfs.append(squeeze(df))
            pending.append((found, exact_weights(counts, df, documents)))
            mass.append(float(pending[-1][1].sum(dtype=float)))
            waiting += len(found)
            if waiting > 1 << 15 or i == len(own) - 1:
                lengths = np.array([len(f) for f, _ in pending])
                samples.append(sampler(np.concatenate([f for f, _ in pending]), np.concatenate([w for _, w in pending]), np.cumsum(lengths) - lengths))
                pending, waiting = [], 0
        drawn = np.concatenate(samples) if samples else np.zeros((0, bands * rows), np.uint32)
        banded = np.stack([mixed(_folded(drawn[:, b * rows : (b + 1) * rows]) + np.uint64(b)) for b in range(bands)], 1).view(np.int64)
        row = (block << PLACE) + np.array(usable, np.int64)
        columns = [pa.array(row), pa.array([doc_ids[i] for i in usable], pa.int64()), pa.array([nodes[i] for i in usable], pa.binary()), pa.array(list(banded), pa.list_(pa.int64())), pa.array(mass, pa.float64()), pa.array(dfs, pa.binary())]
        return pa.Table.from_arrays(columns, names=["row", "doc_id", "node", "bands", "mass", "df"])

    return run


def sketch_table(blocks: DataFrame, size: int, bands: int, rows: int) -> tuple[DataFrame, int]:
    """(row, doc_id, node, bands, mass, df) of each row with words, settled, and the number of all rows; df are the document frequencies of its distinct shingles, packed."""
    total = F.expr("aggregate(n, 0L, (a, x) -> a + x)")
    seen = blocks.agg(F.sum(F.size("n")).alias("n"), F.sum(total).alias("words")).first()
    documents = seen["n"] or 0
    ranges = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), (seen["words"] or 0) // RANGE)
    asked = blocks.select("block", "n", "at", "hashes").mapInArrow(_asked(ranges, size), "block long, part int, keys binary, n binary")
    answers = settle(asked.groupBy("part").applyInArrow(_answered, "block long, part int, n binary"))
    sweep(blocks.sparkSession)
    own = blocks.where(total > 0).select("block", "doc_id", "node", "n", "at", "hashes")
    table = settle(own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sketched(size, bands, rows, documents), SKETCH))
    release(answers)
    sweep(blocks.sparkSession)
    return table, documents


def _folded(samples: np.ndarray) -> np.ndarray:
    total = np.zeros(len(samples), np.uint64)
    for k in range(samples.shape[1]):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + samples[:, k].astype(np.uint64))
    return total


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted distinct shingles, weights)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][ia], b[1][ib]).sum(dtype=float))
    union = float(a[1].sum(dtype=float)) + float(b[1].sum(dtype=float)) - shared
    return shared / union if union else 0.0


def _unpacked(batch: pa.RecordBatch | pa.Table, *columns: int, most: int = 12 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose packed texts in the columns have at most `most` bytes together when unpacked, or of one row; repetitive texts pack very small."""
    sizes = sum(np.array([int.from_bytes(x[-8:], "little") for x in batch.column(c).to_pylist()], np.int64) for c in columns)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low : low + 4096]), most, "right")))
        yield low, high
        low = high


def _text(packed: bytes, codec: pa.Codec) -> bytes:
    return codec.decompress(packed[:-8], int.from_bytes(packed[-8:], "little"), asbytes=True)


def _dealt(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with the `part` of their leader a that they fall to; settled."""
    sizes = settle(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SHARE))).cast("int").alias("parts")).where("parts > 1"))
    dealt = settle(pairs.join(sizes, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"))
    release(sizes)
    return dealt


def _verified(pairs: DataFrame, texts: DataFrame, size: int, documents: int, threshold: float) -> DataFrame:
    """The pairs (a, part, b) of nodes with `alike`, the similarity of their whole texts, where it is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _unpacked(batch, 3, 4):
                part = batch.slice(low, high - low)
                nodes = part.column(0).to_pylist()
                first = [i for i, a in enumerate(nodes) if not i or a != nodes[i - 1]]  # rows come by a
                packed = part.column(3).take(pa.array(first)).to_pylist() + part.column(4).to_pylist()
                dfs = part.column(5).take(pa.array(first)).to_pylist() + part.column(6).to_pylist()
                bags = [(f, exact_weights(n, expand(df), documents)) for (f, n), df in zip(_bags(packed, size), dfs, strict=True)]
                of = np.searchsorted(first, np.arange(len(nodes)), "right") - 1
                alike = pa.array([similarity(bags[of[i]], bags[len(first) + i]) for i in range(len(nodes))], pa.float64())
                whole_part = pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), alike], names=["a", "part", "b", "alike"])
                yield whole_part.filter(pc.greater_equal(alike, threshold))

    def of(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("words").alias(f"words_{name}"), F.col("df").alias(f"df_{name}"))

    leaders = pairs.select("a", "part").distinct().join(of("a"), "a")
    both = pairs.join(of("b"), "b").join(leaders, ["a", "part"])
    return both.select("a", "part", "b", "words_a", "words_b", "df_a", "df_b").mapInArrow(run, "a binary, part int, b binary, alike double")


def _weighed(texts: DataFrame, size: int, documents: int) -> DataFrame:
    """(node, keys, weights): the shingles of a text and their weights, as plain numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _unpacked(batch, 1):
                part = batch.slice(low, high - low)
                bags = [(f, exact_weights(n, expand(df), documents)) for (f, n), df in zip(_bags(part.column(1).to_pylist(), size), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array([x[k].tobytes() for x in bags], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["node", "keys", "weights"])

    return texts.select("node", "words", "df").mapInArrow(run, "node binary, keys binary, weights binary")


def _compared(threshold: float):
    """Members of one part (x) against those of another (y): a link (a, b) for each two components that a similar pair joins."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, comps, is_x = rows["node"].to_pylist(), rows["comp"].to_pylist(), rows["x"].to_pylist()
        bags = [(np.frombuffer(k, np.uint64), np.frombuffer(w, np.float32)) for k, w in zip(rows["keys"].to_pylist(), rows["weights"].to_pylist(), strict=True)]
        label = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)[1]
        xs, ys = [i for i, x in enumerate(is_x) if x], np.array([i for i, x in enumerate(is_x) if not x], np.int64)
        links: list[tuple[bytes, bytes]] = []
        if xs and len(ys):
            key = np.concatenate([bags[i][0] for i in ys])
            weight = np.concatenate([bags[i][1] for i in ys])
            order = np.argsort(key, kind="stable")
            key, weight, of = key[order], weight[order], np.repeat(np.arange(len(ys)), [len(bags[i][0]) for i in ys])[order]
            mass = np.array([float(bags[i][1].sum(dtype=float)) for i in ys])
            for i in xs:
                own, has = bags[i]
                low, high = np.searchsorted(key, own), np.searchsorted(key, own, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(of[at], np.minimum(np.repeat(has, n), weight[at]), len(ys))
                like = shared / (float(has.sum(dtype=float)) + mass - shared)
                for j in ys[(like >= threshold) & (label[ys] != label[i])].tolist():
                    if label[j] != label[i]:
                        links.append((nodes[i], nodes[j]))
                        label[label == label[j]] = label[i]
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _classes(blocks: DataFrame, size: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, node) of each row with words, and (node, comp) of each node with links: comp is the smallest node that they reach. Both are settled."""
    spark = blocks.sparkSession
    docs, total = sketch_table(blocks, size, bands, rows)
    # of each class, the row with the smallest number stands for all
    classes = settle(docs.join(docs.groupBy("node").agg(F.min("row").alias("row")).select("row"), "row", "left_semi"))
    named = settle(docs.select("row", "doc_id", "node"))
    release(docs)

    # a bucket's leader is the member that shares most buckets with others: in a group of copies, one near its middle.
    # Counts and leaders are written before they are joined back, so that a large bucket can be split.
    slots = settle(classes.select("node", F.explode("bands").alias("band")))
    shared = settle(slots.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    filled = settle(slots.join(shared, "band"))
    popular = settle(filled.groupBy("node").agg(F.sum("n").alias("popularity")))
    leaders = settle(filled.select("band", "node").join(popular, "node").groupBy("band").agg(F.max_by("node", F.struct("popularity", "node")).alias("a")))
    stars = settle(filled.select("band", "node").join(leaders, "band").select("a", F.col("node").alias("b")).distinct())
    release(slots, shared, filled, leaders)
    touched = classes.join(popular.select("node"), "node").select("row", "node", "df")

    texts_of = settle(rows_of(blocks, "words").join(touched, "row").select("node", "words", "df"))
    masses = settle(classes.join(popular.select("node"), "node").select("node", "mass"))
    release(classes, popular)
    sweep(spark)
    dealt = _dealt(stars.where("a <> b"))
    with_b = dealt.join(masses.select(F.col("node").alias("b"), F.col("mass").alias("mb")), "b")
    with_a = dealt.select("a", "part").distinct().join(masses.select(F.col("node").alias("a"), F.col("mass").alias("ma")), "a")
    # the similarity is at most the smaller sum of weights by the larger
    candidates = with_b.join(with_a, ["a", "part"]).where(F.least("ma", "mb") >= (threshold - 1e-6) * F.greatest("ma", "mb")).select("a", "part", "b")
    links = settle(_verified(candidates, texts_of, size, total, threshold).select("a", "b"))
    labels = components(links)
    release(dealt)
    sweep(spark)

    # then, in the groups of a leader that these links leave apart, each member outside of the largest component against
    # the others. The leader itself has met them all.
    placed = settle(stars.join(labels.select(F.col("node").alias("b"), "comp"), "b", "left").select("a", F.col("b").alias("node"), F.coalesce("comp", "b").alias("comp")))
    counted = placed.groupBy("a", "comp").agg(F.count("*").alias("n"))
    apart = settle(counted.groupBy("a").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1 and n > 2").select("a", "main"))
    rest = settle(placed.where("a <> node").join(apart, "a").select("a", "node", "comp", (F.col("comp") == F.col("main")).alias("in_main")).join(masses, "node"))
    release(stars, placed, apart, masses)
    share = F.greatest(F.col("mass") / F.lit(float(PART)), F.lit(1.0 / SHARE))
    parts = rest.groupBy("a").agg(*[F.ceil(F.sum(m)).cast("int").alias(k) for k, m in (("parts_x", F.when(~F.col("in_main"), share)), ("parts_y", share))])
    parts = settle(parts.where("parts_x is not null"))
    bags = settle(_weighed(texts_of.join(rest.select("node").distinct(), "node", "left_semi"), size, total))
    release(texts_of)

    def side(members: DataFrame, own: str, other: str) -> DataFrame:
        placed = members.join(parts, "a").withColumn("own", F.pmod(F.xxhash64("node", F.lit(own)), F.col(f"parts_{own}")).cast("int"))
        spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)))
        return spread.select("a", F.col("own").alias(f"part_{own}"), F.col("other").alias(f"part_{other}"), F.lit(own == "x").alias("x"), "node", "comp")

    both = side(rest.where("not in_main"), "x", "y").unionByName(side(rest, "y", "x"))
    more = settle(both.join(bags, "node").groupBy("a", "part_x", "part_y").applyInArrow(_compared(threshold), "a binary, b binary").distinct())
    release(rest, parts, bags)
    sweep(spark)

    # the components of the first links, joined by what came later
    of = labels.select("node", "comp")
    ends = more.join(of.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    last = settle(of.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("last")), "comp", "left").select("node", F.coalesce("last", "comp").alias("comp")).union(joined.join(of.select("node"), "node", "left_anti")))
    release(labels, links, more, joined)
    sweep(spark)
    return named, last


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 10, rows: int = 3) -> DataFrame:
    """One row per row of df: doc_id, class_id (the smallest doc_id that links reach), kept (doc_id is class_id).

    Two rows are linked if their texts have the same words, or if the weighted Jaccard
    similarity of their shingles is at least `threshold`. A text of fewer than `size`
    words is one shingle; a very long text is compared whole. A null or empty text, or
    one without letters and digits, links with nothing. Repeated rows have the same class
    and are all `kept` if their id is the class's. A null id is never the smallest unless
    its class has no other; its class_id is then null and kept is false. An empty table
    gives no rows. Other columns of df are not read.
    """
    blocks = settle(blocks_of(df, id_col, text_col))
    named, comps = _classes(blocks, size, threshold, bands, rows)
    classes = named.groupBy("node").agg(F.min("doc_id").alias("rep")).join(comps, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    smallest = classes.groupBy("comp").agg(F.min("rep").alias("class_id"))
    found = named.join(classes.join(smallest, "comp").select("node", "class_id"), "node").select("doc_id", "class_id")
    every = found.union(rows_of(blocks, "node", "doc_id").where("node is null").select("doc_id", F.col("doc_id").alias("class_id")))
    done = settle(every.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept")))
    release(blocks, named, comps)
    return done


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 10, rows: int = 3) -> DataFrame:
    """The rows of df, with all their columns, of which one of each class of near-duplicates stays.

    That is the row with the smallest id, a null one last; of several such rows, any
    one. Rows are told apart by their place, not by their ids: rows of one id with
    different texts are different rows. Rows whose text is null or has no words stay. An
    empty table gives no rows.
    """
    blocks = settle(blocks_of(df, id_col, text_col, whole=True))
    named, comps = _classes(blocks, size, threshold, bands, rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    best = named.groupBy("node").agg(first).join(comps, "node", "left").groupBy(F.coalesce("comp", "node")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    gone = settle(named.select("row").join(best, "row", "left_anti"))
    release(named, comps)
    others = [c for c in df.columns if c != text_col]
    kept = rows_of(blocks, "rest", "words").join(gone, "row", "left_anti").select("words", *[F.col(f"rest.c{i}").alias(f"c{i}") for i in range(len(others))])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            sized = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(0), bytes(8))], names=["words"])
            for low, high in _unpacked(sized, 0):
                part = batch.slice(low, high - low)
                texts = [None if x is None else _text(x, codec).decode() for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *part.columns[1:]], names=["text", *part.schema.names[1:]])

    types = dict(kept.dtypes)
    named = kept.mapInArrow(unpacked, ", ".join(["text string", *[f"c{i} {types[f'c{i}']}" for i in range(len(others))]]))
    names = {c: f"c{i}" for i, c in enumerate(others)} | {text_col: "text"}
    return named.select(*[F.col(names[c]).cast(df.schema[c].dataType).alias(c) for c in df.columns])
