import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from assayer.llm import packing, queries

SF = "/root/testdata/sf0.01"


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, window):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, got in pieces.items():
        ids, at = np.array(ids_of(tokenizer, texts[doc]), "<u4"), 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for got in sequences.values():
        at = 0
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return sum(r["length"] for r in rows) / (window * len(sequences))


def test_query_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(queries.op2_best_fit_packing(spark, SF).collect(), texts, 2048) > 0.98


def test_encoder_equals_the_tokenizer_on_random_text():
    rng = random.Random(7)
    letter = lambda: chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 127), rng.randrange(0x250, 0x3000), 32, 10, 39]))
    texts = ["".join(letter() for _ in range(40)) for _ in range(500)]
    texts += [None, "", "\n\n", "  a \x1c b\x85c  ", "<|endoftext|> x<|startoftext|>", "don't we'll 's ''s", "ΑΣ Σ", "日本 🙂 ﬁ ǅ"]
    encoder = packing.TextEncoder(packing.default_tokenizer())
    flat, lengths = encoder.encode(pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for text, low, high in zip(texts, ends[:-1], ends[1:], strict=True):
        assert flat[low:high].tolist() == ids_of(encoder.tokenizer, text)[:-1]


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.choice([1, 2, 7, 16, 100])
        lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(0, 40))), reverse=True)
        number, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), window)
        free: list[int] = []
        for n, w, o in zip(lengths, number.tolist(), offset.tolist(), strict=True):
            fits = [x for x in free if x >= n]
            if fits:
                assert free[w] == min(fits)
            else:
                assert w == len(free)
                free.append(window)
            assert o == window - free[w]
            free[w] -= n


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (4, "word " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    check(packing.pack(df, window=64, group_rows=2).collect(), {r[0]: r[1] for r in rows}, 64)
    assert packing.pack(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "one two", "x")] * 2, "doc_id long, text string, start string")
    got = packing.pack(twice, with_ids=True).collect()
    assert [(r["doc_id"], len(r["ids"])) for r in got] == [(None, r["length"]) for r in got] and len(got) == 2


def test_one_row_repeated_many_times_spreads_over_the_groups(spark):
    df = spark.createDataFrame([(7, "the same short text")] * 3000 + [(8, "word " * 300)] * 20, "doc_id long, text string").repartition(6)
    rows = packing.pack(df, window=64, group_rows=100).collect()
    assert len(rows) == 3000 + 20 * len({r["start"] for r in rows if r["doc_id"] == 8})
    groups = max(r["sequence_id"] for r in rows if r["sequence_id"] % 2 == 0)
    assert groups > 60  # many groups have rows of it
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert sum(r["length"] for r in rows) / (64 * len(sequences)) > 0.9
    assert all(len(own) == 1 and own[0]["length"] == 64 for k, own in sequences.items() if k % 2)
