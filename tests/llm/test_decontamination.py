import collections
import math
import random

import numpy as np

from assayer.llm import decontamination as dc
from assayer.llm import queries

SF = "/root/testdata/sf0.01"


def words_of(text):
    return [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in (text or "").split()) if w]


def bag(words, size):
    return collections.Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else collections.Counter()


def brute(doc, items, size=5):
    """Best cosine with each item over all windows as long as the item; frequencies are counted over all distinct items."""
    texts = {" ".join(words_of(t)): words_of(t) for t in items.values() if words_of(t)}
    df = collections.Counter(s for w in texts.values() for s in bag(w, size))
    idf = lambda n: 1 + math.log((1 + len(texts)) / (1 + n))
    words, best = words_of(doc), {}
    for item, text in items.items():
        own = words_of(text)
        if not own:
            continue
        mine = {s: n * idf(df[s]) for s, n in bag(own, size).items()}
        norm = math.sqrt(sum(x * x for x in mine.values()))
        for start in range(max(1, len(words) - len(own) + 1)):
            there = {s: n * (idf(df[s]) if s in mine else idf(1)) for s, n in bag(words[start : start + len(own)], size).items()}
            shared = sum(x * mine[s] for s, x in there.items() if s in mine)
            if shared:
                best[item] = max(best.get(item, 0.0), shared / norm / math.sqrt(sum(x * x for x in there.values())))
    return best


def test_query_finds_all_planted_passages(spark):
    docs = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    text = {k: f" {' '.join(w)} " for k, w in docs.items()}
    want = {(d, i) for i, w in items.items() for d, t in text.items() if f" {' '.join(w)} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_simhash_windows(spark, SF).collect()}
    assert want <= got
    for d, i in got - want:
        own = {tuple(items[i][k : k + 5]) for k in range(len(items[i]) - 4)}
        assert sum(tuple(docs[d][k : k + 5]) in own for k in range(len(docs[d]) - 4)) >= 0.75 * len(own)


def test_edited_passages_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 12, 40]))) for _ in range(30)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        passage = rng.choice(items).split()
        for _ in range(i % 4):
            passage[rng.randrange(len(passage))] = "new"
        docs.append((i, " ".join([*words, *passage, *rng.choices(vocabulary, k=rng.randint(0, 30))])))
    want = {(d, i): x for d, t in docs for i, x in brute(t, dict(enumerate(items))).items()}
    tables = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")]
    for block_items in (1000, 7):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.contaminated(*tables, block_items=block_items).collect()}
        assert all(abs(want[k] - x) < 1e-9 for k, x in got.items()) and min(got.values()) >= 0.8
        assert set(got) == {k for k, x in want.items() if x >= 0.8}
        found = {d for d, _ in got}
        assert {r["doc_id"] for r in dc.clean(*tables, block_items=block_items).collect()} == {d for d, _ in docs} - found


def test_more_items_than_a_block_and_near_matches(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    items = {i: " ".join(common + [f"i{i}w{k}" for k in range(20)]) for i in range(40)} | {100 + i: f"twin text of two words more {i % 2}" for i in range(6)}
    docs = []
    for d in range(60):
        words = items[rng.randrange(40)].split()
        for _ in range(d % 4):
            words.insert(rng.randrange(len(words)), f"d{d}") if d % 2 else words.pop(rng.randrange(len(words)))
        docs.append((d, " ".join([f"x{d}y{k}" for k in range(d)] + words + ["end", "of", "it"] + (items[100].split() if d == 7 else []))))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(d, i): x for d, t in docs for i, x in brute(t, items).items() if x >= 0.8}
    results = [{(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in dc.contaminated(df, bench, block_items=n).collect()} for n in (1000, 9)]
    assert results[0] == results[1] == {k: round(x, 9) for k, x in want.items()}
    assert {i for d, i in want if d == 7} >= {100, 102, 104} and sum(0.8 <= x < 0.999 for x in want.values()) > 10


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 16, (300, dc.BLOCKS)).astype(np.uint16)
    index = dc.HammingIndex(prints)
    for i in range(40):
        one = prints[i].copy()
        for bit in rng.choice(128, rng.integers(0, 60), replace=False):
            one[bit // 16] ^= np.uint16(1 << (bit % 16))
        distance = np.bitwise_count(prints ^ one).sum(1)
        assert index.near(one).tolist() == np.flatnonzero(distance <= dc.RADIUS).tolist()


def test_odd_rows(spark):
    docs = [(1, None, 1.0), (2, "", 1.0), (3, "x One, TWO three! y", 1.0), (None, "one two three", 1.0), (None, "one two three", 1.0), (4, "one two " * 20_000, 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, similarity double")
    bench = spark.createDataFrame([(7, "one two three"), (8, "one  two THREE"), (9, None), (None, "")], "item_id long, text string")
    for block_items in (100, 1):
        got = sorted((r["doc_id"] or 0, r["item_id"], round(r["similarity"], 9)) for r in dc.contaminated(df, bench, block_items=block_items).collect())
        assert got == [(0, 7, 1.0), (0, 7, 1.0), (0, 8, 1.0), (0, 8, 1.0), (3, 7, 1.0), (3, 8, 1.0)]
    assert sorted(r["doc_id"] for r in dc.clean(df, bench).collect()) == [1, 2, 4]
    assert dc.clean(df, bench).columns == df.columns
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0
