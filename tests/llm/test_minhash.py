import collections
import random

import numpy as np
import pyarrow as pa

from assayer.llm import arrow, graph, minhash, queries
from assayer.llm.common import settle, shared_dir
from assayer.llm.shingles import by_text, word_hashes

SF = "/root/testdata/sf0.01"


def brute(texts, size=5, threshold=0.8):
    """Smallest id that links reach, by all pairs that share a shingle; document frequencies are counted here."""
    ids = sorted(texts)
    words, bounds = word_hashes(pa.array([texts[i] for i in ids], pa.string()))
    found = list(by_text(words, bounds, size))
    df = collections.Counter(h for f, _ in found for h in f.tolist())
    n = max(2, len(ids))
    bags = {i: (f, times * np.array([1 + 0.25 * np.log(n / df[h]) / np.log(n) for h in f.tolist()])) for i, (f, times) in zip(ids, found, strict=True)}
    holders = collections.defaultdict(list)
    for i in ids:
        for s in bags[i][0].tolist():
            holders[s].append(i)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                if (a, b) not in seen and find(a) != find(b):
                    seen.add((a, b))
                    if minhash.similarity(bags[a], bags[b]) >= threshold:
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in queries.op6_weighted_minhash(spark, SF).collect()}
    assert got == brute(texts)


def test_chains_and_large_groups_match_brute_force(spark):
    rng = random.Random(8)
    texts = {}
    for g in range(12):
        text = [f"w{rng.randrange(10_000)}" for _ in range(120)]
        for k in range(30):
            texts[100 * g + k] = " ".join(text)
            text[rng.randrange(len(text))] = f"v{g}_{k}"  # each differs a little from the one before
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    want = brute(texts)
    assert np.mean([got[i] == want[i] for i in want]) > 0.95
    pairs = collections.Counter(want.values())
    assert max(pairs.values()) > 5


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(6)
    sampler = minhash.Sampler(2000)
    for share in (0.2, 0.5, 0.8):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 2**63, int((1 - share) * len(a)), dtype=np.uint64)]))
        wa, wb = rng.uniform(0.5, 3, len(a)).astype(np.float32), rng.uniform(0.5, 3, len(b)).astype(np.float32)
        wb[np.isin(b, a)] = wa[np.isin(a, b)] * rng.choice([1.0, 1.0, 2.0], np.isin(a, b).sum()).astype(np.float32)
        drawn = sampler(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a)]))
        assert abs((drawn[0] == drawn[1]).mean() - minhash.similarity((a, wa), (b, wb))) < 0.05


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "short text"), (9, "Short, TEXT"), (5, "word " * 30_000), (6, "word " * 30_000), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "alone in its class")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, node int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(False, 1, 1, True), (False, 2, 2, True), (False, 3, 3, True), (False, 4, 4, True), (False, 5, 5, True), (False, 6, 5, False), (False, 7, 7, True), (False, 7, 7, True), (False, 9, 4, False), (True, 0, 0, False), (True, 0, 7, False)]
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.deduplicated(df.limit(0)).count() == 0


def test_one_id_over_different_texts_and_classes_without_ids(spark):
    x, y, z = ("one two three four five six", "alpha beta gamma delta epsilon zeta", "only rows without an id hold this text")
    df = spark.createDataFrame([(1, x, "a"), (2, y, "b"), (1, y, "c"), (1, x, "d"), (3, x, "e"), (None, z, "f"), (None, z, "g")], "doc_id long, text string, row string")
    kept = minhash.deduplicated(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, x), (1, y), (0, z)])
    long = [f"w{k}" for k in range(200)]
    near = spark.createDataFrame([(None, " ".join(long)), (7, " ".join(long[:199])), (5, " ".join(long[1:]))], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in minhash.near_duplicates(near).collect()) == [(0, 5), (5, 5), (7, 5)]


def test_scratch_tables_go(spark):
    import os

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([(i, f"text number {i % 5} of a few words") for i in range(20)], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 20
    assert len(set(os.listdir(folder)) - before) == 1


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (200, 200)] + [(300, 300 + k) for k in range(1, 500)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100, **dict.fromkeys(range(300, 800), 300)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact(texts, size=5):
    """Bags by id, weighted with the true document frequency of each shingle."""
    words, bounds = word_hashes(pa.array(list(texts.values()), pa.string()))
    found = list(by_text(words, bounds, size))
    df = collections.Counter(h for f, _ in found for h in f.tolist())
    return {i: (f, minhash.exact_weights(n, np.array([df[h] for h in f.tolist()]), len(texts))) for i, (f, n) in zip(texts, found, strict=True)}


def test_frequencies_are_those_of_each_shingle(spark):
    # some 600,000 shingles, more than buckets of 18 bits can tell apart
    rng = random.Random(3)
    texts = {i: " ".join(f"w{rng.randrange(1_000_000)}" for _ in range(1500)) for i in range(400)}
    common = " ".join(f"c{k}" for k in range(60))
    texts |= {400 + i: f"{common} " + " ".join(f"x{i}y{k}" for k in range(40)) for i in range(200)}
    texts[600] = texts[0] + " tail"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    table, total = minhash.sketch_table(settle(minhash.blocks_of(df, "doc_id", "text")), 5, 10, 3)
    bags = exact(texts)
    assert total == len(texts)
    for r in table.select("doc_id", "df").collect():
        ((found, n),) = by_text(*word_hashes(pa.array([texts[r["doc_id"]]])), 5)
        assert (found == bags[r["doc_id"]][0]).all() and np.allclose(minhash.exact_weights(n, arrow.expand(bytes(r["df"])), total), bags[r["doc_id"]][1])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {i: 0 if i == 600 else i for i in texts}


def test_pairs_that_share_a_band_are_verified_however_few_samples_agree(spark):
    # similar pairs of which fewer than 18 of the 30 samples agree, though a band does
    rng = random.Random(5)
    texts = {}
    for k in range(3000):
        own = [f"w{rng.randrange(10_000_000)}" for _ in range(70)]
        texts[2 * k], texts[2 * k + 1] = " ".join(own), " ".join(own[:63] + [f"v{k}_{j}" for j in range(7)])
    bags = exact(texts)
    sampler, few = minhash.Sampler(30), []
    for k in range(3000):
        a, b = bags[2 * k], bags[2 * k + 1]
        drawn = sampler(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, len(a[0])]))
        same = drawn[0] == drawn[1]
        if minhash.similarity(a, b) >= 0.8 and same.sum() < 18 and same.reshape(10, 3).all(1).any():
            few.append(k)
    assert few
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in few)
