import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import langid, queries

SF = "/root/testdata/sf0.01"
WORDS = {"aa": "kala mala tala pala lama", "ab": "kalo malo talo palo lamo", "xa": "ring thing wrung shrink", "xb": "rink think wrunk shring"}


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(lang, " ".join(rng.choice(words.split(), 30))) for lang, words in WORDS.items() for _ in range(n)]


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_language_families(spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_families_and_machines():
    rows = made(20)
    model = langid.Model.fit(list(langid.vectors(pa.array([t for _, t in rows]))), [x for x, _ in rows])
    assert sorted(model.groups) == [["aa", "ab"], ["xa", "xb"]]
    assert [k for k, _, _ in model.machines].count(-1) == 1 and len(model.machines) == 3
    new = made(5, seed=2)
    assert model.predict(pa.array([t for _, t in new]))[0] == [x for x, _ in new]


def test_margins_are_those_of_the_vectors():
    rows = made(10)
    texts = pa.array([t for _, t in rows] + ["", "Ünï €", "a" * 5000])
    found = list(langid.vectors(texts))
    model = langid.Model.fit(found[: len(rows)], [x for x, _ in rows])
    plain = np.array([[model.weights[ids, m] @ values for m in range(len(model.machines))] for ids, values in found]) + model.biases
    assert np.abs(model.margins(texts) - plain).max() < 1e-3
    assert np.abs(model.margins(texts.slice(3, 9)) - plain[3:12]).max() < 1e-3


def test_predictions_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.learn(docs.where(remainder != 2), "doc_id")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op4_language_families(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r in rows[::3]:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        # byte n-grams counted one by one, machines applied one by one
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
        grams, n = collections.Counter(), 0
        for i, b in enumerate(raw):
            if b != 32:
                n += 1
                key = 0
                for order in range(1, 5):
                    key |= (raw[i - order + 1] if i >= order - 1 else 32) << 8 * (order - 1)
                    grams[((key * 2654435761 + (order * 0x9E3779B1 & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 16] += 1
        margin = [sum(k * langid.SCALE / n * float(model.weights[g, m]) for g, k in grams.items()) + model.biases[m] for m in range(len(model.machines))]

        def duels(kind, names, margin=margin):
            wins, least = collections.Counter(), dict.fromkeys(range(names), 20.0)
            for (of, a, b), x in zip(model.machines, margin, strict=True):
                if of == kind:
                    wins[a if x >= 0 else b] += 1
                    least[a], least[b] = min(least[a], x), min(least[b], -x)
            best = max(range(names), key=lambda c: wins[c])
            return best, least[best]

        family, sure = duels(-1, len(model.groups))
        lang, own = duels(family, len(model.groups[family]))
        assert got[r["doc_id"]][0] == model.groups[family][lang]
        assert abs(got[r["doc_id"]][1] - 1 / (1 + math.exp(-2 * max(-20, min(20, sure, own))))) < 1e-3


def test_every_language_is_learned_and_repeated_rows_do_not_crowd_the_sample(spark):
    rows = [(i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}o " * 9 + f"q{i}", f"l{k}") for k in range(205) for i in range(2)]
    rows += [(5, "same text again", "aa")] * 500 + [(10_000 + i, f"other words {i} here", "aa") for i in range(40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", per_language=4)
    assert sum(map(len, model.groups)) == 206


def test_odd_rows(spark):
    docs = [(i, t, x, 0.5) for i, (x, t) in enumerate(made(20))]
    odd = [(900, None, "aa", 0.5), (901, "", None, 0.5), (902, "12 ... !", "xa", 0.5), (903, "ring " * 50_000, None, 0.5), (None, "kala mala", None, 0.5), (None, "kala mala", None, 0.5)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, score double")
    model = langid.learn(df, "doc_id")
    got = langid.predict(df, model, ["doc_id"]).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs) + 6
    assert [by_id[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and by_id[901]["score"] == 0
    assert by_id[903]["lang_pred"] == "xa" and by_id[None]["lang_pred"] == "aa"
    empty = df.limit(0)
    assert langid.learn(empty, "doc_id") is None and langid.predict(empty, None, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df, None, ["doc_id"]).collect()} == {"und"}
    one = langid.learn(df.where("lang = 'aa'"), "doc_id")
    assert {r["lang_pred"] for r in langid.predict(df.where("doc_id < 5"), one, ["doc_id"]).collect()} == {"aa"}
