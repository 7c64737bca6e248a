import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import jsontools
from assayer.operators import choices, inference
from assayer.operators.graph_model import OPS, GraphModel, Step
from assayer.sources import jsonl

LABELS = ["A", "B"]


def attention():
    """Embedding, one attention layer with a causal mask, mean over positions, a linear layer."""
    rng = np.random.default_rng(3)
    weights = {"E": rng.normal(size=(20, 4)), "Q": rng.normal(size=(4, 4)), "K": rng.normal(size=(4, 4)), "W": rng.normal(size=(4, 2)), "b": rng.normal(size=2), "zero": np.int64(0), "one": np.int64(1), "two": np.array(2), "low": np.array(-1e9), "none": np.array(0.0), "axis1": np.array([1]), "dim1": np.array([1])}
    steps = (
        Step("Gather", ("E", "ids"), ("x",)), Step("MatMul", ("x", "Q"), ("q",)), Step("MatMul", ("x", "K"), ("k",)), Step("Transpose", ("k",), ("kt",), {"perm": (0, 2, 1)}), Step("MatMul", ("q", "kt"), ("s",)),
        Step("Shape", ("ids",), ("shape",)), Step("Gather", ("shape", "one"), ("n",)), Step("Range", ("zero", "n", "one"), ("r",)), Step("Unsqueeze", ("r", "axis1"), ("rows",)), Step("Greater", ("r", "rows"), ("later",)),
        Step("Where", ("later", "low", "none"), ("mask",)), Step("Add", ("s", "mask"), ("sm",)), Step("Softmax", ("sm",), ("a",)), Step("MatMul", ("a", "x"), ("h",)), Step("Relu", ("h",), ("hr",)),
        Step("ReduceMean", ("hr",), ("m",), {"axes": (1,), "keepdims": 0}), Step("Gemm", ("m", "W", "b"), ("logits",)),
    )
    return GraphModel(LABELS, steps, weights)


def test_graph_equals_plain_numpy(spark):
    model, ids = attention(), np.array([3, 7, 7, 1, 19])
    w = model.weights
    x = w["E"][ids]
    s = (x @ w["Q"]) @ (x @ w["K"]).T + np.triu(np.full((5, 5), -1e9), 1)
    a = np.exp(s - s.max(1, keepdims=True))
    h = np.maximum(a / a.sum(1, keepdims=True) @ x, 0).mean(0)
    assert np.allclose(model.run(ids), h @ w["W"] + w["b"])
    df = spark.createDataFrame([(str(i), "abc"[: i % 3 + 1] * (i + 1)) for i in range(20)], "id string, input string")
    prepare = lambda t: np.array([ord(c) - 96 for c in t])
    got = {r["id"]: r["scores"] for r in inference.infer(df, model, prepare).collect()}
    assert all(got[r["id"]] == model.scores(prepare(r["input"])).tolist() for r in df.collect())


def test_operations():
    x = np.arange(12.0).reshape(3, 4)
    assert (OPS["Slice"](x, [1], [2**63 - 1], [0]) == x[1:]).all()
    assert [p.shape for p in OPS["Split"](x, np.array([1, 3]), axis=1)] == [(3, 1), (3, 3)]
    assert OPS["Reshape"](x, np.array([0, -1, 2])).shape == (3, 2, 2) and OPS["Expand"](np.ones((1, 4)), np.array([3, 1])).shape == (3, 4)
    assert np.allclose(np.exp(OPS["LogSoftmax"](x)).sum(-1), 1) and np.allclose(OPS["Erf"](np.array([0.5])), 0.5204998778)
    assert OPS["OneHot"](np.array([0, 2]), 3, np.array([0, 1])).tolist() == [[1, 0, 0], [0, 0, 1]]
    assert OPS["Div"](np.array([7]), np.array([2])).tolist() == [3] and OPS["CumSum"](x, 1)[0].tolist() == [0, 1, 3, 6]
    assert (OPS["GatherElements"](x, np.array([[3], [0], [1]]), axis=1) == [[3], [4], [9]]).all()
    with pytest.raises(ValueError, match="Loop"):
        GraphModel(LABELS, (Step("Loop", ("ids",), ("logits",)),), {}).run(np.array([1]))
    with pytest.raises(ValueError, match="memory"):
        GraphModel(LABELS, attention().steps, attention().weights, most_bytes=64).run(np.arange(8))


def test_choices(spark):
    df = spark.createDataFrame([("1", "aa"), ("2", "b"), ("3", "")], "id string, input string")
    loglik = lambda text, cs: [float(text.count(c)) if text else float("nan") for c in cs]
    scored = choices.score(df, ["a", "b", "zz"], loglik, chunk=2)
    found = {r["id"]: r for r in choices.mapped(scored, ["a"], ["a", "b", "zz"]).collect()}
    assert [found[k]["outcome"] for k in "123"] == ["mapped", "no_choice_match", "invalid_score"]
    assert abs(found["1"]["posterior"] - np.exp(2) / (np.exp(2) + 2)) < 1e-12
    assert tuple(choices.tally(choices.mapped(scored, ["a"], ["a", "b", "zz"])).first()) == (1, 1, 1)
    results = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, predicted_label string")
    reference = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "A")], "id string, label string")
    assert tuple(choices.parity(results, reference).first()) == (3, 2)
    raw = spark.createDataFrame([(bytearray(b"A"),), (bytearray(b"A "),), (bytearray(b"\xff"),)], "b binary")
    assert [r["x"] for r in raw.select(choices.resolve(F.col("b"), LABELS).alias("x")).collect()] == ["A", None, None]


def test_small_rules(spark):
    assert choices.empty_encoding([]) == "empty" and choices.empty_encoding([0, 0]) == "padding"
    assert choices.same_empty_encoding([0], [0]) and not choices.same_empty_encoding([], [0])
    with pytest.raises(ValueError):
        choices.empty_encoding([0, 3])
    assert (choices.allotted(100, 4), choices.allotted(100, 4, fixed=60), choices.allotted(10, 4, fixed=60), choices.allotted(1e9, 1), choices.allotted(0, 3)) == (25, 60, 10, 3600, 0)
    assert jsontools.renderings({"b": 1, "a": [2]}) == ['{"b":1,"a":[2]}', '{"b": 1, "a": [2]}', '{"a":[2],"b":1}', '{"a": [2], "b": 1}'] and jsontools.renderings({}) == []
    assert jsontools.shards_digest("w", [b"ab", b"c"]) != jsontools.shards_digest("w", [b"a", b"bc"])
    df = spark.createDataFrame([('{"a":1}',), ("plain",)], "x string")
    assert [r["y"] for r in df.select(F.to_json(jsontools.value_or_text(F.col("x"))).alias("y")).collect()] == ['{"a":1}', '{"text":"plain"}']
    assert df.select(jsontools.salted_digest("s", F.col("x")).alias("d")).distinct().count() == 2


def test_training_examples(spark):
    lines = ['{"input":"x","label":"A"}', '{"input":"x","label":"A","more":1}', '{"input":" \\u001c ","label":"A"}', '{"input":"x","label":"Z"}', '{"input":1,"label":"A"}', "[]", "{"]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line long, raw string")
    assert [r["error"] for r in jsonl.examples(df, LABELS).orderBy("line").collect()] == [None, "fields", "empty_value", "unknown_label", "type_mismatch", "malformed_record", "malformed_json"]
