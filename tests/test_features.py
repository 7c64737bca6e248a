"""N-grams of texts, features in the scan, and what a worker holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import features
from assayer.plans import registry

TEXTS = [("a", "abcabcab"), ("b", "é\u0000é — ü"), ("c", ""), ("d", None), ("e", "abcabcab"), ("f", "x"), ("g", "xyxyxy abc\n" * 30)]


def rows_of(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def both(spark):
    texts = spark.createDataFrame(TEXTS, "id string, ids string").coalesce(2)
    return texts, texts.select("id", text.byte_ids(1 << 30)(F.col("ids")).alias("ids"))


@pytest.mark.parametrize("orders", [(1, 2, 3, 4), (5, 7)])
def test_texts_stand_for_their_byte_ids(spark, orders):
    texts, ids = both(spark)
    assert rows_of(features.ngrams(texts, orders)) == rows_of(features.ngrams(ids, orders))
    df = features.document_frequencies(texts, orders)
    assert rows_of(df) == rows_of(features.ngrams(ids, orders).groupBy("n", "key").agg(F.count("*").alias("df")))
    by_hand = {}
    for _, t in TEXTS:
        b = [x + 1 for x in (t or "").encode()]
        for n in orders:
            for key in {sum(x * 257**j for j, x in enumerate(reversed(b[i : i + n]))) for i in range(len(b) - n + 1)}:
                by_hand[n, key] = by_hand.get((n, key), 0) + 1
    assert {(r["n"], r["key"]): r["df"] for r in df.collect()} == by_hand


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("most", [200_000, 25])
def test_features_in_the_scan_are_those_of_the_join(spark, kind, most):
    texts, ids = both(spark)
    vocab = features.vocabulary(features.document_frequencies(texts), len(TEXTS), most=most, kind=kind)
    found = features.tfidf_rows(texts, vocab)
    assert dict(found.dtypes) == {"id": "string", "col": "int", "val": kind}
    want = {(r["id"], r["col"]): r["val"] for r in features.tfidf(features.ngrams(ids), vocab).collect()}
    got = {(r["id"], r["col"]): r["val"] for r in found.collect()}
    assert len(got) == found.count() and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert rows_of(features.tfidf_rows(ids, vocab)) == rows_of(found)


def test_nothing_in_the_vocabulary(spark):
    texts, _ = both(spark)
    vocab = features.vocabulary(features.document_frequencies(texts), len(TEXTS), min_df=100)
    assert features.tfidf_rows(texts, vocab).count() == 0


def test_slices(monkeypatch):
    monkeypatch.setattr(features, "SLICE_IDS", 4)
    texts = ["zz", "ab", "c", "", "defghij", "", "kl", "m", "no"]
    for column, step in ((pa.array(texts), 1), (pa.array(texts, pa.large_string()), 1), (pa.array([list(t.encode()) for t in texts], pa.list_(pa.int32())), 0)):
        seen = list(features._slices(column.slice(1)))
        assert [x[0] for x in seen] == [0, 3, 4, 7] and [len(x[1]) for x in seen] == [3, 7, 3, 2]
        assert [bytes((own[low:high] - step).tolist()).decode() for _, own, b in seen for low, high in zip(b[:-1], b[1:], strict=True)] == texts[1:]


def test_what_a_task_holds_is_passed_on(monkeypatch, spark):
    """Frequencies do not depend on when a task adds up or passes on what it holds."""
    runs, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: runs.append(run) or plain(self, run, schema))
    features.document_frequencies(spark.createDataFrame(TEXTS, "id string, ids string"), (2, 5, 7))
    batches = [pa.RecordBatch.from_arrays([pa.array([t for _, t in TEXTS if t is not None])], names=["ids"])] * 3

    def sums():
        found = {}
        out = list(runs[0](iter(batches)))
        for b in out:
            for r in b.to_pylist():
                found[r["n"], r["key"]] = found.get((r["n"], r["key"]), 0) + r["df"]
        return found, len(out)

    whole, few = sums()
    monkeypatch.setattr(features, "SLICE_IDS", 10)
    monkeypatch.setattr(features, "MOST_HELD", 12)
    parts, many = sums()
    assert whole == parts and few == 3 < many


@pytest.mark.parametrize("name", ["ngram_tfidf", "byte_ngram_df", "ngram_vocabulary", "tfidf_features"])
def test_a_worker_holds_little_of_a_batch(monkeypatch, spark, name):
    """A batch of 12 MB of text, as its rows come to the worker, takes less than 150 MB beside it."""
    taken, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: taken.append((self, run)) or plain(self, run, schema))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert taken
    for rows, run in taken:
        table = rows.toArrow()
        own = table.column("ids").combine_chunks()
        n_ids = int(np.diff(own.offsets.to_numpy()).sum()) if pa.types.is_list(own.type) else sum(len(t.encode()) for t in own.to_pylist())
        (batch,) = pa.concat_tables([table] * (12_000_000 // n_ids + 1)).combine_chunks().to_batches()
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150e6, peak


@pytest.mark.parametrize("many", [False, True])
def test_a_long_row_is_read_in_pieces(monkeypatch, spark, many):
    """A text of 6 MB takes less than 150 MB beside it, and each of its n-grams counts once."""
    runs, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: runs.append(run) or plain(self, run, schema))
    features.document_frequencies(spark.createDataFrame(TEXTS, "id string, ids string"))
    own = np.random.default_rng(3).integers(0, 128 if many else 20, 6_000_000).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", own.tobytes().decode(), "abc"])], names=["ids"])
    total = dict.fromkeys((1, 2, 3, 4), 0)
    tracemalloc.start()
    for out in runs[0](iter([batch])):
        for n in total:
            total[n] += int(out.column("df").to_numpy()[out.column("n").to_numpy() == n].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
    ids = own.astype(np.int64) + 1
    for n in total:
        keys = np.sort(sum(ids[j : len(ids) - n + 1 + j] * 257 ** (n - 1 - j) for j in range(n)))
        assert total[n] == 1 + np.count_nonzero(np.diff(keys)) + 2 * max(0, 4 - n)


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_long_rows_with_many_ngrams(monkeypatch, most):
    monkeypatch.setattr(features, "SLICE_IDS", 5)
    monkeypatch.setattr(features, "MOST_HELD", most)
    text = "abcabcab — ü\u0000xyxyxy abc zz"
    padded = [x + 1 for x in text.encode()]
    padded[9] = 0
    for column in (pa.array(["q", text, "q"]), pa.array([[1], padded, [1]], pa.list_(pa.int32()))):
        bounds, ids = features._opened(column.slice(1))
        row = ids(bounds[0], bounds[1]).tolist()
        for n in (1, 2, 3, 4, 7):
            parts = list(features._of_long_row(ids, bounds[0], bounds[1], n))
            want = sorted({sum(x * 257**j for j, x in enumerate(reversed(row[i : i + n]))) for i in range(len(row) - n + 1) if 0 not in row[i : i + n]})
            assert np.concatenate(parts).tolist() == want and all(len(p) <= most for p in parts)
