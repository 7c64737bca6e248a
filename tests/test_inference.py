import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.functions import tokenize
from assayer.operators import inference, selection
from assayer.sources import requests
from assayer.sources.sides import BadInput

LABELS = ["A", "B", "C"]


def convolution(seed=1):
    rng = np.random.default_rng(seed)
    return inference.ConvolutionModel(LABELS, rng.normal(size=(257, 6)), [(rng.normal(size=(4, 6, w)), rng.normal(size=4)) for w in (2, 3)], rng.normal(size=(8, 3)), rng.normal(size=3))


def ngrams():
    table = {1: {98: 0, 99: 1}, 2: {98 * 257 + 99: 2}}
    return inference.NgramModel(LABELS, table, np.array([1.0, 2.0, 3.0], np.float32), np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1]], np.float32), np.zeros(3, np.float32))


def test_models_by_hand():
    scores = ngrams().scores(inference.bytes_of("ab", 10))  # a and b once, and the pair
    x = np.array([1.0, 2.0, 3.0]) / np.sqrt(14)
    assert np.allclose(scores, np.exp(x) / np.exp(x).sum(), atol=1e-6)
    assert np.allclose(ngrams().scores(inference.bytes_of("", 10)), 1 / 3)
    m, ids = convolution(), inference.bytes_of("hello", 10)
    pooled = []
    for kernel, bias in m.branches:
        width, best = kernel.shape[2], np.full(4, -np.inf)
        for t in range(len(ids)):
            acc = bias.copy()
            for j in range(width):
                if 0 <= t + j - width // 2 < len(ids):
                    acc = acc + kernel[:, :, j] @ m.embedding[ids[t + j - width // 2]]
            best = np.maximum(best, np.maximum(acc, 0))
        pooled.append(best)
    logits = np.concatenate(pooled) @ m.weight + m.bias
    assert np.allclose(m.scores(ids), np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum())


@pytest.mark.parametrize("model", [convolution(), ngrams()])
def test_batch_equals_single(spark, model):
    texts = [f"text {i} " * (i % 7) for i in range(120)] + ["ab", "", "日本"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("none", None)], "id string, input string")
    prepare = lambda t: inference.bytes_of(t, 64)
    for parts in (1, 5):
        got = {r["id"]: r for r in inference.infer(df.repartition(parts), model, prepare).collect()}
        assert got["none"]["error"] == "missing_input"
        for i, t in enumerate(texts):
            alone = model.scores(prepare(t))
            assert got[str(i)]["scores"] == alone.tolist() and got[str(i)]["predicted_label"] == LABELS[int(alone.argmax())]
    with pytest.raises(ValueError):
        inference.all_or_nothing(inference.infer(df, model, prepare))
    with pytest.raises(ValueError):
        inference.all_or_nothing(inference.infer(df.limit(0), model, prepare))
    judged = inference.judged(inference.infer(df, model, prepare), LABELS, tau=0.5, out_of_scope="B")
    assert {r["status"] for r in judged.collect()} <= {"ok", "abstain", "out_of_scope", "error"}
    assert selection.top_scores(judged.where("status = 'ok'"), 2).groupBy("id").count().where("count <> 2").count() == 0


def test_input_only(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal int, input string")
    seen = inference.input_digests(rows)
    assert inference.input_only_violations(rows, seen).count() == 0
    changed = inference.input_digests(rows.withColumn("input", F.when(F.col("ordinal") == 1, "b!").otherwise(F.col("input")))).where("ordinal < 2")
    assert sorted(r["ordinal"] for r in inference.input_only_violations(rows, changed).collect()) == [1, 2]


def test_requests(spark):
    lines = ['{"id":"1","input":"x"}', '{"id":"","input":"x"}', '{"id":"2"}', '{"id":"3","input":4}', '{"id":"4","input":"x","more":1}', "{", '{"id":"5","id":"6","input":"x"}', '{"id":"7777777","input":"x"}']
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line long, raw string")
    got = {r["line"]: r["error"] for r in requests.parse(df, requests.Limits(id_bytes=5)).collect()}
    assert got == {1: None, 2: "empty_id", 3: "missing_field", 4: "type_mismatch", 5: "unknown_field", 6: "malformed_json", 7: "duplicate_key", 8: "id_too_long"}
    assert requests.batch(df.where("line = 1")).count() == 1
    for bad, limits in ((df, requests.Limits()), (df.limit(0), requests.Limits()), (df.where("line = 1"), requests.Limits(records=0))):
        with pytest.raises(BadInput):
            requests.batch(bad, limits)
    assert requests.single(spark, "1", "x").count() == 1
    with pytest.raises(BadInput):
        requests.single(spark, "", "x")


def test_files_that_go_out(spark, tmp_path):
    out = spark.createDataFrame([(2, "b", "invalid", None), (1, "a", "label", "A"), (3, "c", "abstain", None)], "line int, id string, kind string, label string")
    lines = requests.prediction_lines(out, "line")
    assert [r["value"] for r in lines.collect()] == ['{"id":"a","status":"ok","predicted_label":"A"}', '{"id":"b","status":"ok","predicted_label":null}', '{"id":"c","status":"abstain","predicted_label":null}']
    requests.write_new(lines, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        requests.write_new(lines, str(tmp_path / "out"))
    assert requests.summary(lines).first() == requests.summary(spark.read.text(str(tmp_path / "out"))).first()


def test_selection_and_report(spark):
    gold = spark.createDataFrame([(str(i), "A") for i in range(40)], "id string, label string")
    rows = [(c, str(i), "ok", "A" if i < k else "B") for c, k in (("base", 20), ("one", 34), ("two", 34)) for i in range(40)]
    out = selection.candidate_outcomes(gold, spark.createDataFrame(rows, "candidate string, id string, status string, predicted_label string"), spark.createDataFrame([(0, "A"), (1, "B")], "pos int, label string"))
    report = {r["candidate"]: r for r in selection.report(out, "base").collect()}
    assert report["base"]["p_value"] is None and report["one"]["only_a"] == 14 and report["one"]["verdict"] == "better"
    assert report["one"]["adjusted_p"] == min(1, 2 * report["one"]["p_value"])
    best = selection.select_best(selection.report(out, "base"), ["two", "base", "one"])
    assert best == selection.Selection("two", 34, 40, ["two", "one"])
    assert selection.mistakes(out.where("candidate = 'base'"), gold.withColumn("input", F.lit("x"))).count() == 20
    assert selection.set_difference(gold, gold).count() == 0 and selection.set_difference(gold, gold.where("id <> '3'")).count() == 1


def test_package_rules(spark):
    assert selection.package_outcome(["size"], "pass") == (20, "limit_exceeded")
    assert [selection.package_outcome([], q)[0] for q in ("pass", "fail", "undeterminable", "not_defined")] == [0, 10, 12, 0]
    rows = spark.createDataFrame([("a", 50_000_000, True, ["Add"], 0), ("b", 50_000_000, False, ["Add"], 0), ("c", 1, False, ["Add", "Odd"], 0), ("d", 1, False, ["Add"], 2)], "candidate string, bytes long, has_vocabulary boolean, ops array<string>, mismatches int")
    assert {r["candidate"]: r["reason"] for r in selection.eligible(rows, ["Add"]).collect()} == {"a": "vocabulary_over_guideline", "b": None, "c": "unsupported_ops", "d": "prediction_mismatch"}
    runs = spark.createDataFrame([(1, 1, 100, 90, "x"), (2, 2, 100, 50, "x"), (3, 3, 100, 88, "x")], "i int, seed int, n long, n_correct long, data_sha256 string")
    assert sorted(map(tuple, selection.reproducibility(runs).collect())) == [(1, 2), (2, 3)]
    with pytest.raises(ValueError):
        selection.reproducibility(runs.limit(2))


def test_tokens_and_chats(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    df = spark.createDataFrame([("sys", "hello there", None), ("sys", "hello", "fine"), (None, "x", "y")], "s string, u string, a string")
    ids = [r["x"] for r in df.select(tokenize.encode(path)(F.col("u")).alias("x")).collect()]
    assert ids == [tokenizer.encode(t, add_special_tokens=False).ids for t in ("hello there", "hello", "x")]
    chats = [r["x"] for r in df.select(tokenize.chat_ids(path, "<|startoftext|>", "<|endoftext|>")(F.col("s"), F.col("u"), F.col("a")).alias("x")).collect()]
    start, end = 49406, 49407
    enc = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    assert chats[0] == [start, *enc("system\nsys"), end, start, *enc("user\nhello there"), end, start, *enc("assistant\n")]
    assert chats[1] == [start, *enc("system\nsys"), end, start, *enc("user\nhello"), end, start, *enc("assistant\nfine"), end]
    assert chats[2] is None
