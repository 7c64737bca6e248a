import pytest
from pyspark.sql import functions as F

from assayer.functions import times
from assayer.operators import evaluation, ledger
from assayer.sources import sides


def rows(spark, lines):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line long, raw string")


def test_gold_codes(spark):
    lines = ['{"id":"1","label":"A"}', '{"id":"2","output":{"intent":"B"},"input":"x"}', '{"id":"3"}', '{"id":"4","label":7}', '{"id":"5","label":"Z"}', '{"id":"6","label":null,"output":{"intent":"A"}}']
    got = {r["id"]: (r["label"], r["code"]) for r in sides.gold(rows(spark, lines), ["A", "B"]).collect()}
    assert got == {"1": ("A", None), "2": ("B", None), "3": (None, "missing_gold"), "4": (None, "malformed_gold"), "5": (None, "unknown_gold_label"), "6": ("A", None)}


@pytest.mark.parametrize(("line", "reason"), [("{x", "malformed_json"), ('{"id":"1","id":"2"}', "duplicate_key"), ("[]", "malformed_record"), ('{"id":5}', "malformed_id"), ('{"id":"0"}', "duplicate_id")])
def test_bad_lines_stop(spark, line, reason):
    with pytest.raises(sides.BadInput) as caught:
        sides.gold(rows(spark, ['{"id":"0","label":"A"}', line]), ["A"])
    assert caught.value.reason == reason


def test_scores_decide_between_error_and_malformed(spark):
    lines = [
        '{"id":"1","status":"ok","predicted_label":"A","scores":{"A":0.7,"B":0.3}}',
        '{"id":"2","status":"ok","predicted_label":"A","scores":{"A":NaN,"B":0.3}}',
        '{"id":"3","status":"ok","predicted_label":"A","scores":{"A":0.7,"B":0.4}}',
        '{"id":"4","status":"ok","predicted_label":"A","scores":[1]}',
        '{"id":"5","status":"ok","predicted_label":"A","scores":{"A":-0.5,"B":1.5}}',
        '{"id":"6","status":"ok","predicted_label":5}',
        '{"id":"7","status":"ok","predicted_label":"A","scores":{"A":"1"}}',
        '{"id":"8","status":"ok","predicted_label":"A","scores":null}',
        '{"id":"9","status":"abstain"}',
    ]
    found = sides.predictions(rows(spark, lines))
    got = {r["id"]: (r["status"], r["predicted_label"], r["reason"]) for r in found.collect()}
    bad = ("error", None, "invalid_score")
    assert got == {"1": ("ok", "A", None), "2": bad, "3": bad, "4": bad, "5": bad, "6": ("ok", None, None), "7": bad, "8": ("ok", "A", None), "9": ("abstain", None, None)}
    with pytest.raises(sides.BadInput):
        sides.predictions(rows(spark, ['{"id":"1","status":"ok","weight":NaN,"scores":{"A":1.0}}']))
    gold = spark.createDataFrame([("1", "A"), ("6", "A"), ("9", "A"), ("none", "A")], "id string, label string")
    labels = spark.createDataFrame([(0, "A")], "pos int, label string")
    out = {r["id"]: (r["kind"], r["reason"]) for r in evaluation.align(gold, found, labels).collect()}
    assert out == {"1": ("label", None), "6": ("invalid", "not_string"), "9": ("abstain", None), "none": ("error", "missing_prediction")}


def test_times(spark):
    texts = ["2024-02-29T12:00:00Z", "2023-02-29T12:00:00Z", "2024-01-01T00:00:00.123456789Z", "2024-01-01T00:00:00+09:00", "2024-01-01T00:00:00+00:00", "2024-01-01", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["x"] for r in df.orderBy("i").select(times.rfc3339_utc(F.col("t")).cast("double").alias("x")).collect()]
    assert got == [1709208000.0, None, 1704067200.123456, None, 1704067200.0, None, None]
    log = spark.createDataFrame([("2024-01-01 09:00:00.250000+0900",), ("2024-01-01T09:00:00",)], "t string")
    assert [r["x"] for r in log.select(times.log_epoch(F.col("t")).alias("x")).collect()] == [1704067200.25, None]


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    book.record_version("model", 1, "aa")
    with pytest.raises(ValueError):
        book.record_version("model", 1, "bb")
    assert book.may_roll_back_to("model", 1, "aa") and not book.may_roll_back_to("model", 1, "bb") and not book.may_roll_back_to("model", 2, "aa")
    calls = []
    assert book.apply_once({"data": "x"}, lambda: calls.append(1) or {"n": 1}) == {"n": 1}
    with pytest.raises(ValueError):
        book.apply_once({"data": "x"}, lambda: calls.append(1) or {})
    assert calls == [1] and book.entries().count() == 3
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.jsonl").write_text("x")
    frozen = ledger.content_record(spark, str(data))
    assert ledger.gate(frozen, ledger.content_record(spark, str(data))) == "run" and ledger.gate(None, None) == "skip"
    with pytest.raises(ValueError):
        ledger.unchanged(spark, str(data), lambda: (data / "a.jsonl").write_text("y"))
    with pytest.raises(ValueError):
        ledger.gate(frozen, ledger.content_record(spark, str(data)))


def test_provenance():
    import json

    from assayer.sources import provenance

    good = {"model_requested": "m", "prompt_sha256": "a" * 64, "started_utc": "2024-02-29T01:02:03.5Z", "usage_observed": {"input_tokens": 3, "output_tokens": 4}, "source": "own", "more": 1}
    record = provenance.parse(json.dumps(good))
    assert (record.input_tokens, record.output_tokens, record.generated_at.microsecond, record.source) == (3, 4, 500000, "own")
    assert provenance.parse(json.dumps({**good, "usage_observed": None})).input_tokens is None
    for change in ({"prompt_sha256": "x"}, {"started_utc": "2024-02-30T00:00:00Z"}, {"started_utc": "2024-02-01T00:00:00+01:00"}, {"usage_observed": {"input_tokens": 1}}, {"source": None}, {"model_requested": ""}):
        with pytest.raises(ValueError):
            provenance.parse(json.dumps({**good, **change}))
    for text in ("[]", "{", '{"a":1,"a":2}', json.dumps({k: v for k, v in good.items() if k != "usage_observed"})):
        with pytest.raises(ValueError):
            provenance.parse(text)
    assert provenance.ingest(record, set(), lambda: "rows") == "rows"
    with pytest.raises(ValueError):
        provenance.ingest(record, {"own"}, lambda: 1 / 0)
