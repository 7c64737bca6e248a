import json
import math
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import jsontools, text
from assayer.operators import calibration, compare, definitions, evaluation, events, features, quality, split
from assayer.sources import jsonl

LABELS = ["A", "B", "C", "D"]


def labels_df(spark):
    return spark.createDataFrame(list(enumerate(LABELS)), "pos int, label string")


def test_known_answer_of_24_rows(spark):
    cells = {("A", "A"): 5, ("A", "B"): 1, ("B", "B"): 4, ("B", "C"): 2, ("C", "C"): 3, ("C", "A"): 3, ("D", "B"): 2, ("D", None): 1}
    gold, pred, k = [], [], 0
    for (g, p), n in cells.items():
        for _ in range(n):
            gold.append((str(k), g))
            pred.append((str(k), "abstain" if p is None else "ok", p))
            k += 1
    gold += [("x1", "A"), ("x2", "B"), ("x3", "C")]
    pred += [("x1", "ok", "zz"), ("x2", "error", None)]
    rows = evaluation.align(spark.createDataFrame(gold, "id string, label string"), spark.createDataFrame(pred, "id string, status string, predicted_label string"), labels_df(spark))
    total = evaluation.totals(rows).first()
    assert (total["n"], total["n_correct"], total["n_abstain"], total["n_invalid"], total["n_error"]) == (24, 12, 1, 1, 2)
    assert total["accuracy"] == 0.5 and abs(total["adopted_accuracy"] - 12 / 23) < 1e-12 and abs(total["coverage"] - 23 / 24) < 1e-12
    by = {r["label"]: r for r in evaluation.label_metrics(rows, labels_df(spark)).collect()}
    assert by["D"]["precision"] is None and by["D"]["recall"] == 0 and by["D"]["f1"] == 0
    assert by["A"]["support"] == 7 and abs(by["A"]["f1"] - 10 / 15) < 1e-12
    q = evaluation.quadrant(rows).first()
    assert sum(q) == 24
    top = evaluation.confusable_pairs(rows, labels_df(spark), 2).collect()
    assert [(r["gold"], r["predicted"], r["n"]) for r in top] == [("C", "A", 3), ("B", "C", 2)]
    assert evaluation.confusion_matrix(rows, labels_df(spark)).count() == 4 * 7


def test_inspection_codes(spark):
    lines = [
        '{"id":"1","input":"a","output":{"intent":"A"}}',
        "{bad",
        "[1]",
        '{"id":"2","id":"3","input":"a","output":{"intent":"A"}}',
        '{"input":"","output":{"intent":"Z"},"tags":["x",1,null],"group_id":""}',
        '{"id":"1","input":7,"output":"A"}',
        '{"id":"4","input":"b","output":{"intent":"B"},"tags":["x"],"group_id":"g"}',
        '{"id":"5","input":"c","output":{}}',
    ]
    rows = spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line long, raw string")
    found = jsonl.inspect(rows, LABELS)
    assert sorted((r["line"], r["id"], r["label_id"]) for r in found.records.collect()) == [(1, "1", "A"), (7, "4", "B")]
    got = sorted((r["line"], r["field"], r["code"], r["actual"] or "", r["first_line"] or 0) for r in found.anomalies.collect())
    assert got == sorted([
        (2, "<record>", "malformed_json", "", 0), (3, "<record>", "malformed_record", "", 0), (4, "<record>", "duplicate_key", "", 0),
        (5, "id", "missing_field", "", 0), (5, "input", "empty_value", "", 0), (5, "output.intent", "unknown_label", "", 0), (5, "tags", "type_mismatch", "number", 0), (5, "tags", "type_mismatch", "null", 0), (5, "group_id", "empty_value", "", 0),
        (6, "input", "type_mismatch", "number", 0), (6, "output", "type_mismatch", "string", 0), (6, "id", "duplicate_id", "", 1),
        (8, "output.intent", "missing_field", "", 0),
    ])


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"a":1}\r\n\n  \n{"a":2}\n')
    assert [(r["line"], r["raw"]) for r in jsonl.lines(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()] == [(1, '{"a":1}'), (4, '{"a":2}')]


def test_text_rules(spark):
    texts = ["  ｈｉ　there\x1c ok ", "", " \x1d\n", "é", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", text.normalised("t").alias("n"), text.collapsed(F.col("t")).alias("c"), text.is_empty_after_normalising(F.col("t")).alias("e")).collect()}
    assert got[0]["n"] == "hi there ok" and got[0]["c"] == "ｈｉ there\x1c ok"
    assert [got[i]["e"] for i in range(5)] == [False, True, True, False, None]
    ids = df.where("i in (1, 3)").orderBy("i").select(text.byte_ids(1)(F.col("t")).alias("ids")).collect()
    assert [r["ids"] for r in ids] == [[0], [0xC3 + 1]]


def test_ngram_keys_skip_padding(spark):
    df = spark.createDataFrame([([1, 2, 0, 3, 4],), ([5],)], "ids array<int>")
    assert [r["k"] for r in df.select(text.ngram_keys(F.col("ids"), 2).alias("k")).collect()] == [[1 * 257 + 2, 3 * 257 + 4], []]


@pytest.mark.parametrize("n", range(0, 40))
def test_allocation_rules(n):
    train, validation, test = split.allocate(n, split.Ratios())
    assert train + validation + test == n and min(train, validation, test) >= 0
    if n >= 3:
        assert validation >= 1 and test >= 1
    assert split.allocate(n, split.Ratios(1.0, 0.0, 0.0)) == (n, 0, 0)


def test_split_is_by_group_and_reproducible(spark):
    rows = [(str(i), f"text {i}", LABELS[i % 3], f"g{i // 4}") for i in range(400)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, input string, label string, group_id string")
    one = split.split_groups(df, 7)
    records = split.split_records(df, one).cache()
    assert records.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, split.split_groups(df.repartition(5), 7).collect()))
    assert sorted(map(tuple, one.collect())) != sorted(map(tuple, split.split_groups(df, 8).collect()))
    manifest = {r["split"]: (r["n"], r["digest"]) for r in split.digests(records).collect()}
    assert split.verify(records.repartition(3), manifest) == []
    changed = records.withColumn("input", F.when(F.col("id") == "5", "new").otherwise(F.col("input")))
    assert len(split.verify(changed, manifest)) == 1


def test_public_generators():
    assert split.fnv1a(b"") == 0xCBF29CE484222325 and split.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert split.SplitMix64(0).next() == 0xE220A8397B1DCDAF


def test_calibration_finds_the_temperature(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        d = rng.uniform(0, 4)
        p = 1 / (1 + 2.718281828 ** (-d / 2))  # right at temperature 2
        rows.append(("a" if rng.random() < p else "b", [d, 0.0]))
    df = calibration.prepared(spark.createDataFrame(rows, "gold string, logits array<double>"), ["a", "b"])
    c = calibration.calibrate(df)
    assert 1.6 < c.best_temperature < 2.5 and c.adopted and c.nll_after < c.nll_before and c.ece_after < c.ece_before
    conf = sorted(r["c"] for r in df.select(calibration.confidence(F.lit(1 / c.temperature)).alias("c")).collect())
    assert c.tau == conf[(len(conf) - 1) // 5]


def test_logits_out_of_contract(spark):
    rows = [("a", [1.0, float("nan")]), ("a", [1.0, float("inf")]), ("a", [1.0]), ("a", [float("-inf"), 2.0]), ("a", [float("-inf")] * 2)]
    got = calibration.prepared(spark.createDataFrame(rows, "gold string, logits array<double>"), ["a", "b"]).select("d", "top", calibration.nll(F.lit(1.0)).alias("nll")).collect()
    assert [r["d"] is None for r in got] == [True, True, True, False, True]
    assert got[3]["top"] == 2 and got[3]["nll"] == calibration.IMPOSSIBLE


def test_fold_matches_a_stack(spark):
    rng = random.Random(4)
    rows = [(k, seq, rng.choice([None, None, 1, 2, 5])) for seq, k in enumerate(rng.choices("abc", k=400))]
    df = spark.createDataFrame(rows, "k string, seq long, copies int")
    stacks, want = {}, {}
    for k, seq, copies in rows:
        waiting = stacks.setdefault(k, [])
        if copies is None:
            waiting.append(seq)
            want[seq] = (1, None)
        elif waiting:
            want[seq] = (copies, waiting.pop())
        else:
            want[seq] = (1 + copies, None)
    got = {r["seq"]: (r["occurrences"], r["origin"]["seq"] if r["origin"] else None) for r in events.fold_duplicates(df, ["k"], ["seq"], F.col("copies")).collect()}
    assert got == want


def test_leaks_and_contradictions_have_negative_controls(spark):
    rows = [("1", "x", "train", "g1", "A"), ("2", "x", "test", "g1", "B"), ("3", "y", "train", "g2", "A"), ("4", "z", "test", None, "A"), ("5", "y", "train", "g2", "A")]
    df = spark.createDataFrame(rows, "id string, input string, part string, group_id string, label string")
    assert [(r["part"], r["n_base"], r["n_other"]) for r in quality.input_leaks(df).collect()] == [("test", 1, 1)]
    assert [r["group_id"] for r in quality.group_straddles(df).collect()] == ["g1"]
    assert [(r["first_id"], r["n_gold"], r["n_groups"]) for r in quality.contradictions(df, F.col("input"), F.col("label")).collect()] == [("1", 2, 1)]
    clean = df.where("id in ('3', '4')")
    assert quality.input_leaks(clean).count() == quality.group_straddles(clean).count() == quality.contradictions(clean, F.col("input"), F.col("label")).count() == 0


def test_definitions():
    base = {"schema": "s", "name": "n", "version": 1, "judgment_type": "t", "options": [{"id": "a", "display_name": "A"}, {"id": "b", "display_name": "B"}], "io": {"input": "text"}}
    assert definitions.load(json.dumps(base)) == base
    assert definitions.rebuild(base, dict(base))["decision"] == "unchanged"
    named = {**base, "options": [{"id": "a", "display_name": "new"}, base["options"][1]]}
    assert definitions.rebuild(base, named) == {"decision": "cosmetic", "changed": ["a"]}
    fewer = {**base, "options": base["options"][:1]}
    assert definitions.rebuild(base, fewer) == {"decision": "required", "reasons": ["options"], "removed": ["b"], "added": []}
    for bad in ('{"schema":1,"schema":2}', json.dumps({**base, "options": []}), json.dumps({**base, "options": [{"id": "a"}, {"id": "a"}]})):
        with pytest.raises(ValueError):
            definitions.load(bad)
    with pytest.raises(ValueError):
        jsontools.canonical({"a": 1.5})


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([("1", [1, 2, 3, 1, 2]), ("2", [1, 2, 9]), ("3", [7])], "id string, ids array<int>")
    grams = features.ngrams(df, (1, 2))
    vocab = features.vocabulary(grams, 3)
    assert sorted((r["n"], r["key"], r["df"]) for r in vocab.collect()) == [(1, 1, 2), (1, 2, 2), (2, 259, 2)]
    norms = features.tfidf(grams, vocab).groupBy("id").agg(F.sum(F.col("val") * F.col("val")).alias("x")).collect()
    assert len(norms) == 2 and all(abs(r["x"] - 1) < 1e-5 for r in norms)


def test_regression_transitions(spark):
    pairs = spark.createDataFrame([("1", True, True), ("2", True, False), ("3", False, True), ("4", True, False)], "id string, previous boolean, current boolean")
    assert {r["transition"]: r["n"] for r in compare.transitions(pairs).collect()} == {"kept": 1, "lost": 2, "gained": 1, "missed": 0}


def test_abstention_raises_the_adopted_accuracy(spark):
    rows = [("a", [5.0, 0.0])] * 6 + [("b", [0.2, 0.0])] * 3 + [("b", [0.0, 3.0])]
    df = calibration.prepared(spark.createDataFrame(rows, "gold string, logits array<double>"), ["a", "b"])
    got = {r["abstention"]: r for r in calibration.compare_abstention(df, ["a", "b"], 1.0, 0.9).collect()}
    assert (got["without"]["n_correct"], got["without"]["coverage"]) == (7, 1.0)
    assert (got["with"]["n_abstain"], got["with"]["adopted_accuracy"], got["with"]["coverage"]) == (3, 1.0, 0.7)
    scoped = {r["abstention"]: r for r in calibration.compare_abstention(df, ["a", "b"], 1.0, 0.9, "a").collect()}
    assert scoped["with"]["n_abstain"] == 0


def test_a_trained_linear_model_separates(spark):
    rng = random.Random(3)
    rows = [(f"{label}{i}", [rng.choice([10, 11, 12, 5]) if label == "A" else rng.choice([20, 21, 22, 5]) for _ in range(12)], label) for label in "AB" for i in range(40)]
    df = spark.createDataFrame(rows, "id string, ids array<int>, label string")
    grams = features.ngrams(df, (1,))
    vocab = features.vocabulary(grams, len(rows))
    x = features.tfidf(grams, vocab).cache()
    labels = spark.createDataFrame([(0, "A"), (1, "B")], "pos int, label string")
    weights, biases = features.train_linear(x, df.select("id", "label"), labels, vocab.count())
    found = features.predictions(features.linear_scores(x, weights, biases))
    assert found.join(df, "id").where("predicted_label <> label").count() == 0


def test_vocabulary_and_tfidf_of_all_orders_match_brute_force(spark):
    rng = random.Random(7)
    texts = {str(i): [rng.randrange(1, 5) for _ in range(rng.randrange(3, 30))] for i in range(25)}
    tf = {i: {} for i in texts}
    for i, ids in texts.items():
        for n in (1, 2, 3, 4):
            for j in range(len(ids) - n + 1):
                key = 0
                for x in ids[j : j + n]:
                    key = key * 257 + x
                tf[i][n, key] = tf[i].get((n, key), 0) + 1
    df = {}
    for own in tf.values():
        for k in own:
            df[k] = df.get(k, 0) + 1
    kept = sorted(sorted((k for k in df if df[k] >= 2), key=lambda k: (-df[k], k))[:60])
    assert sum(n >= 2 for n in df.values()) > 60 and len({n for n, _ in kept}) > 1
    grams = features.ngrams(spark.createDataFrame(list(texts.items()), "id string, ids array<int>"))
    vocab = features.vocabulary(grams, 25, most=60)
    assert [(r["n"], r["key"], r["df"], r["col"]) for r in vocab.orderBy("col").collect()] == [(*k, df[k], c) for c, k in enumerate(kept)]
    got = {(r["id"], r["col"]): r["val"] for r in features.tfidf(grams, vocab).collect()}
    want = {}
    for i, own in tf.items():
        x = {c: (1 + math.log(own[k])) * (math.log(26 / (1 + df[k])) + 1) for c, k in enumerate(kept) if k in own}
        norm = math.sqrt(sum(y * y for y in x.values()))
        want |= {(i, c): y / norm for c, y in x.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_whole_ngram_queries_have_all_orders(spark):
    from assayer.plans import registry

    found = registry.QUERIES["ngram_vocabulary"](spark, "/root/testdata/sf0.001")
    assert {r["n"] for r in found.select("n").distinct().collect()} == {1, 2, 3, 4}
