import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from assayer.llm import lm, queries

SF = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + ["\n"]


def check(rows, texts, trains):
    counts = collections.Counter(t for k, text in texts for t in tokens(text) if trains(k))
    n, v = sum(counts.values()), len(counts)
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    for k, text in texts:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        for r in got[k]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(t in counts for t in own), n, not trains(k))
            assert abs(r["base_score"] - base) <= 1e-9 * abs(base) and r["score"] <= 0
    assert len(rows) == len(texts)


def test_query_matches_brute_force_and_beats_the_base_on_held_out_text(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op3_deleted_interpolation(spark, SF).collect()
    check(rows, texts, lambda k: zlib.crc32(str(k).encode()) % 5 != 1)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_rows_outside_of_training_change_no_other_score(spark):
    texts = [(i, t) for i, t in enumerate(["a b a b c", "a b", "b a a c", "a a b"] * 6)]
    probes = [(1000 + i, f"a {w}") for i, w in enumerate(["a", "b", "zzz", ""])]
    more = spark.createDataFrame([(2000, "a a a"), (2001, "zzz yyy")], "doc_id long, text string")
    df = spark.createDataFrame(texts + probes, "doc_id long, text string")
    train, left = F.col("doc_id") < 1000, F.col("doc_id") % 4 == 0
    rows = {r["doc_id"]: r["score"] for r in lm.score(df, train, left).collect()}
    with_more = {r["doc_id"]: r["score"] for r in lm.score(df.unionByName(more), train, left).collect()}
    assert all(abs(with_more[k] - rows[k]) < 1e-9 and rows[k] < 0 for k in rows)


def test_weights_make_distributions():
    rows = [{"bucket": b, "pair": p, "word": w, "n": n} for b, p, w, n in [(3, -20, -60, 50), (3, lm.NONE, -80, 20), (5, lm.NONE, lm.NONE, 9), (0, lm.NONE, -100, 4)]]
    weights = lm.learn_weights(rows, 100)
    assert abs(weights.sum(1) - 1).max() < 1e-9 and (weights >= 0).all()
    assert weights[3, 0] > weights[0, 0] and weights[5, 3] > weights[3, 3]


def test_scores_are_close_to_those_of_weights_learned_from_unbinned_estimates(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    place = {k: zlib.crc32(str(k).encode()) % 5 for k, _ in texts}

    def counts(some):
        words, pairs = collections.Counter(), collections.Counter()
        for text in some:
            own = tokens(text)
            words.update(own)
            pairs.update(zip(["\n", *own], own, strict=False))
        return words, pairs

    def parts(h, w, words, pairs, v):
        return [pairs[h, w] / max(1, words[h]), words[w] / sum_of[id(words)], 1 / (v + 1), float(words[w] == 0)]

    words, pairs = counts(t for k, t in texts if place[k] != 1)
    main, main_pairs = counts(t for k, t in texts if place[k] not in (1, 4))
    sum_of = {id(words): sum(words.values()), id(main): sum(main.values())}
    bucket, chances = [], []
    for k, text in texts:
        if place[k] == 4:
            own = tokens(text)
            for h, w in zip(["\n", *own], own, strict=False):
                bucket.append(min(int(math.log2(main[h] + 1)), lm.BUCKETS - 1))
                chances.append(parts(h, w, main, main_pairs, len(words)))
    bucket, chances = np.array(bucket), np.array(chances)
    weights, prior = np.tile([0.3, 0.6, 0.05, 0.05], (lm.BUCKETS, 1)), np.array([0.3, 0.6, 0.05, 0.05])
    for _ in range(80):
        share = weights[bucket] * chances
        share /= share.sum(1, keepdims=True)
        sums = np.stack([np.bincount(bucket, share[:, k], lm.BUCKETS) for k in range(4)], 1)
        prior = (sums.sum(0) + prior) / (sums.sum() + 1)
        weights = sums + 5 * prior
        weights /= weights.sum(1, keepdims=True)
    got = {r["doc_id"]: r["score"] for r in queries.op3_deleted_interpolation(spark, SF).collect()}
    for k, text in texts[::7]:
        own = tokens(text)
        want = sum(math.log10(weights[min(int(math.log2(words[h] + 1)), lm.BUCKETS - 1)] @ np.array(parts(h, w, words, pairs, len(words)))) for h, w in zip(["\n", *own], own, strict=False))
        assert abs(got[k] - want) < 2e-3 * abs(want)


def test_odd_rows(spark):
    texts = [(0, None), (1, ""), (2, "A a\tB\x0bb\xa0b"), (3, "x" * 100_000), (4, "the " * 30_000), (5, "the the"), (5, "the the")]
    df = spark.createDataFrame([(*t, 1.0) for t in texts], "doc_id long, text string, score double")
    check(lm.score(df, F.col("doc_id") != 3, F.col("doc_id") == 4).collect(), texts, lambda k: k != 3)
    assert lm.score(df.limit(0), F.lit(True), F.lit(False)).count() == 0
    none = lm.score(df, F.lit(None).cast("boolean"), F.lit(False)).collect()
    assert len(none) == 7 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["held_out"] for r in none)


def test_pairs_of_rare_words_are_estimated(spark):
    # 2,500 words stand before the rare ones by frequency; the rare ones have the same counts, so only pairs tell them apart
    common = " ".join(f"w{i}" for i in range(2500))
    rows = [(i, common) for i in range(8)] + [(100 + i, f"left{i % 3} right{i % 3}") for i in range(18)]
    probes = [(1000, "left0 right0"), (1001, "left0 right1")]
    texts = rows + probes
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") < 1000, F.col("doc_id") % 4 == 0).collect()}
    assert got[1000] > got[1001] + 0.5

    def counts(some):
        words, pairs = collections.Counter(), collections.Counter()
        for text in some:
            own = tokens(text)
            words.update(own)
            pairs.update(zip(["\n", *own], own, strict=False))
        return words, pairs

    words, pairs = counts(t for _, t in rows)
    main, main_pairs = counts(t for k, t in rows if k % 4)
    total, bins = sum(main.values()), collections.Counter()
    for k, text in rows:
        if k % 4 == 0:
            own = tokens(text)
            for h, w in zip(["\n", *own], own, strict=False):
                pair = round(40 * math.log10(main_pairs[h, w] / main[h])) if main_pairs[h, w] else lm.NONE
                bins[min(int(math.log2(main[h] + 1)), lm.BUCKETS - 1), pair, round(40 * math.log10(main[w] / total)) if main[w] else lm.NONE] += 1
    weights = lm.learn_weights([dict(zip(("bucket", "pair", "word", "n"), (*b, n), strict=True)) for b, n in bins.items()], len(words))
    for k, text in texts:
        own, want = tokens(text), 0.0
        for h, w in zip(["\n", *own], own, strict=False):
            x = weights[min(int(math.log2(words[h] + 1)), lm.BUCKETS - 1)]
            want += math.log10(x[0] * pairs[h, w] / max(1, words[h]) + x[1] * words[w] / sum(words.values()) + x[2] / (len(words) + 1) + x[3] * (words[w] == 0))
        assert abs(got[k] - want) < 1e-6 * abs(want)
