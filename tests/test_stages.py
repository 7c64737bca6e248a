import json

import pytest

from assayer.operators import split
from assayer.plans import stages
from assayer.sources.sides import BadInput

LABELS = ["A", "B", "C"]


def write(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")
    return str(path)


def record(i, label, text=None, group=None):
    return {"id": str(i), "input": text or f"text number {i} here", "output": {"intent": label}, "group_id": group or f"g{i}"}


def test_inspect(spark, tmp_path):
    train = [record(i, LABELS[i % 3]) for i in range(90)]
    test = [record(1000 + i, LABELS[i % 3]) for i in range(12)]
    a, b = write(tmp_path / "train.jsonl", train), write(tmp_path / "test.jsonl", test)
    found = stages.inspect_dataset(spark, a, b, LABELS, seed=3)
    assert found.report["n_train"] == 90 and found.report["n_evaluation"] == 12 and set(found.report["splits"]) == set(split.SPLITS)
    assert sum(s["n"] for s in found.report["splits"].values()) == 90
    # one input, one number in the text: each record's id stands in its own input
    assert found.report["metadata_mixed"] == 90 and found.report["contradictions"] == 0
    assert stages.inspect_dataset(spark, a, b, LABELS, seed=3).report == found.report
    for change, reason in ((test + [record(2000, "A", train[0]["input"])], "input_leak"), (test + [record(2000, "A", group="g5")], "group_straddle"), (test + [record(2000, "Z")], "unknown_label")):
        with pytest.raises(BadInput) as caught:
            stages.inspect_dataset(spark, a, write(tmp_path / "bad.jsonl", change), LABELS)
        assert caught.value.reason == reason


def test_evaluate(spark, tmp_path):
    gold = [{"id": str(i), "label": LABELS[i % 2], "input": f"t{i}"} for i in range(40)] + [{"id": "x", "input": "t"}, {"id": "y", "label": "Z", "input": "u"}]
    pred = [{"id": str(i), "status": "ok", "predicted_label": LABELS[i % 2] if i >= 8 else "C"} for i in range(39)]
    got = stages.evaluate_predictions(spark, write(tmp_path / "g.jsonl", gold), write(tmp_path / "p.jsonl", pred), LABELS, min_accuracy=0.6)
    assert (got["totals"]["n"], got["totals"]["n_correct"], got["totals"]["n_error"]) == (40, 31, 1)
    assert got["warnings"] == {"missing_gold": 1, "unknown_gold_label": 1, "unseen_class": 1}
    assert got["confusable"] == [("A", "C", 4), ("B", "C", 4)] and got["acceptance"] == "pass"
    # right where the majority label is wrong: 16 of B; wrong where it is right: 4 of A
    assert got["baseline"]["label"] == "A" and (got["baseline"]["only_a"], got["baseline"]["only_b"], got["baseline"]["verdict"]) == (15, 4, "better")
    assert sum(got["quadrant"].values()) == 40
    with pytest.raises(BadInput):
        stages.evaluate_predictions(spark, write(tmp_path / "g.jsonl", [{"id": "1"}]), write(tmp_path / "p.jsonl", pred), LABELS)


def test_calibration_of_probabilities(spark):
    rows = [("A", [0.9, 0.1, 0.0])] * 6 + [("B", [0.9, 0.1, 0.0])] * 4
    c = stages.calibrate_on_validation(spark.createDataFrame(rows, "gold string, scores array<double>"), LABELS)
    assert c.best_temperature > 3 and c.adopted
