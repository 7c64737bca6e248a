"""Digests, files of several parts, stored records, file checks, answers and log scans."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.functions import aggregates, bpe, digests, files, jsontools, stats, text
from assayer.operators import compare, definitions, events, features, ledger, quality, records, search, split
from assayer.sources import jsonl, requests
from assayer.streaming import streams


def test_equal_rows_do_not_cancel_out(spark):
    def digest(ids):
        return digests.rows_digest(spark.createDataFrame([(i, "x") for i in ids], "id string, v string").repartition(3), ["id", "v"]).first()

    a, b = digest("AAZ"), digest("BBZ")
    assert a["n"] == b["n"] == 3 and a["digest"] != b["digest"] != digest("AZ")["digest"]
    assert a == digest("ZAA") and digest(["ab", "c"])["digest"] != digest(["a", "bc"])["digest"]
    lines = spark.createDataFrame([("x",), ("x",), ("y",)], "value string")
    assert requests.summary(lines).first()["digest"] != requests.summary(lines.withColumn("value", F.when(F.col("value") == "x", "z").otherwise("y"))).first()["digest"]


def test_split_record(spark):
    rows = [(f"r{i}", f"text {i}", "AB"[i % 2], f"g{i // 4}") for i in range(80)]
    df = spark.createDataFrame(rows, "id string, input string, label string, group_id string")
    groups = split.split_groups(df, 3)
    parts = split.split_records(df, groups)
    stored = json.loads(json.dumps(split.record(parts, groups, 3)))
    assert split.verify_record(split.record(parts.repartition(5), groups, 3), stored) == []
    changed = split.record(parts.withColumn("input", F.when(F.col("id") == "r7", "other").otherwise(F.col("input"))), groups, 3)
    (wrong,) = split.verify_record(changed, stored)
    assert wrong.endswith(".content")
    assert "seed" in split.verify_record(split.record(parts, groups, 4), stored)
    with pytest.raises(ValueError):
        split.manifest(parts.unionByName(parts.limit(1)))


def test_ids_that_repeat_across_files(spark, tmp_path):
    good = lambda i: json.dumps({"id": i, "input": "x", "output": {"intent": "A"}})
    (tmp_path / "a.jsonl").write_text(good("p") + "\n\n" + good("q") + "\n")
    (tmp_path / "b.jsonl").write_text(good("q") + "\r\n" + good("r"))
    found = jsonl.inspect(jsonl.lines(spark, str(tmp_path)), ["A"])
    assert sorted(r["id"] for r in found.records.collect()) == ["p", "q", "r"]
    (again,) = found.anomalies.collect()
    assert (again["file"][-7:], again["line"], again["code"], again["first_file"][-7:], again["first_line"]) == ("b.jsonl", 1, "duplicate_id", "a.jsonl", 3)


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    wrote = [f"line {i} " + "x" * (i % 90) if i % 5 else "" for i in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(wrote))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r["line"]: r["raw"] for r in jsonl.lines(spark, str(tmp_path / "big.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i + 1: x for i, x in enumerate(wrote) if x}


def test_answers_in_inputs(spark):
    answer = '{"name":"f","arguments":{"b":1,"a":"x"}}'
    inputs = [answer, 'call {"name": "f", "arguments": {"b": 1, "a": "x"}}', '{"arguments":{"a":"x","b":1},"name":"f"}', 'with {"a": "x", "b": 1}', '{"a":"x"}', "f", ""]
    df = spark.createDataFrame([(str(i), t, answer) for i, t in enumerate(inputs)] + [("7", "see plain here", "plain"), ("8", "see {} here", "{}"), ("9", None, answer), ("10", "x", None)], "id string, input string, answer string")
    got = quality.metadata_mixed(df, {}, answers=jsontools.answer_needles("answer"))
    assert {r["id"]: list(r["reasons"]) for r in got.collect()} == dict.fromkeys(["0", "1", "2", "3", "7"], ["answer"])


def test_regressions_must_be_complete(spark):
    a = spark.createDataFrame([("1", True), ("2", False)], "id string, correct boolean")
    assert {r["transition"]: r["n"] for r in compare.regression_report(a, a).collect()} == {"kept": 1, "lost": 0, "gained": 0, "missed": 1}
    with pytest.raises(ValueError, match="missing_current: 1"):
        compare.regression_report(a, a.limit(1))
    with pytest.raises(ValueError, match="repeated: 2"):
        compare.regression_report(a, a.unionByName(a))


def test_definitions_refuse_what_they_do_not_know():
    base = {"schema": "s", "name": "n", "version": 1, "judgment_type": "t", "options": [{"id": "a", "display_name": "A", "description": ""}, {"id": "b"}], "io": {"input": "bytes"}}
    fine = {**base, "acceptance": {"min_accuracy_bp": 9000}, "limits": {"max_package_bytes": 5}, "out_of_scope_label": "b", "instruction": "x"}
    assert definitions.load(json.dumps(fine)) == fine
    for change in ({"more": 1}, {"acceptance": {"min_accuracy_bp": 10_001}}, {"acceptance": None}, {"acceptance": {}}, {"limits": {"max_infer_p95_us": 0}}, {"limits": {"other": 1}}, {"out_of_scope_label": "c"}, {"options": ["a"]}, {"options": [{"id": "a", "x": "y"}]}, {"io": "bytes"}, {"name": ""}):
        with pytest.raises(ValueError):
            definitions.load(json.dumps({**base, **change}))


def test_file_checks(spark, tmp_path):
    def tensors(header, data=b""):
        raw = json.dumps(header).encode()
        return len(raw).to_bytes(8, "little") + raw + data

    one = {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}
    assert files.check_tensors(tensors({"__metadata__": {"a": "b"}, "w": one}, bytes(8))) == ["w"]
    bad = [b"", tensors({}), tensors({"w": one}, bytes(7)), tensors({"w": one, "v": {**one, "data_offsets": [4, 12]}}, bytes(12)), tensors({"w": {**one, "data_offsets": [8, 0]}}, bytes(8)), tensors({"__metadata__": {"a": 1}, "w": one}, bytes(8)), b"\xff" * 20]
    for data in bad:
        with pytest.raises(ValueError):
            files.check_tensors(data)
    assert files.check_vocabulary(b'{"a": 0, "b": 7}') == 2 and files.check_tokenizer(b'{"model": {"type": "BPE"}}') == "BPE"
    for data in (b"[]", b"{}", b'{"a": -1}', b'{"a": 1.5}', b'{"a": true}', b'{"a": 1, "a": 2}', json.dumps({"x" * 5000: 1}).encode()):
        with pytest.raises(ValueError):
            files.check_vocabulary(data)
    (tmp_path / "f").write_bytes(b"12345")
    assert files.read_bounded(spark, str(tmp_path / "f"), 5) == b"12345"
    for path, most in ((tmp_path / "f", 4), (tmp_path, 100), (tmp_path / "none", 9)):
        with pytest.raises(ValueError):
            files.read_bounded(spark, str(path), most)


def test_stored_records(spark):
    bound = {"predictions_sha256": "a", "evaluation_sha256": "b", "evaluation_bytes": 3, "definition_sha256": "d"}
    assert records.unbound(bound, bound) == [] and records.unbound({**bound, "predictions_sha256": None}, bound) == ["predictions_sha256"]
    assert records.same_request({"a": 1, "b": [2]}, {"b": [2], "a": 1}) and not records.same_request({"a": 1}, {"a": 2})
    pairs = spark.createDataFrame([(True, False)] * 9 + [(False, True)] + [(True, True)] * 5, "candidate boolean, baseline boolean")
    kept = {"only_a": 9, "only_b": 1, "n": 15, "p_value": stats.mcnemar_exact(9, 1), "verdict": "better"}
    assert records.comparison_differs(kept, pairs) == [] and records.comparison_differs({**kept, "only_b": 2, "verdict": "not_better"}, pairs) == ["only_b", "verdict"]
    out = spark.createDataFrame([("1", "A", "label", "A", None), ("2", "A", "abstain", None, None)], "id string, gold string, kind string, label string, reason string")
    whole = {**bound, "n": 2, "n_correct": 1, "n_abstain": 1, "n_error": 0, "n_invalid": 0}
    assert records.evaluation_differs(whole, out, bound, True) == [] and records.evaluation_differs({**whole, "n_correct": 2}, out, bound, False) == ["n_correct", "not_applied"]
    gold = spark.createDataFrame([("1",), ("2",)], "id string")
    assert records.search_problems(["a", "b"], ["/x/a", "/x/b"], gold, "s", "s") == []
    assert records.search_problems(["a", "a"], ["/x", "/x/b"], gold.union(gold), "s", "t") == ["candidates", "outputs", "gold", "split"]


def test_ledger_tells_folders_apart(spark, tmp_path):
    for folder, data in (("one", "a"), ("two", "b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.jsonl").write_text(data)
    first = ledger.content_record(spark, str(tmp_path))
    assert first["n_files"] == 2 and first["bytes"] == 2
    (tmp_path / "one" / "same.jsonl").write_text("b")
    (tmp_path / "two" / "same.jsonl").write_text("a")
    assert ledger.content_record(spark, str(tmp_path))["sha256"] != first["sha256"]


def test_log_scan(spark, tmp_path):
    path = tmp_path / "log"
    line = lambda m: json.dumps({"eventMessage": m, "timestamp": "2024-01-01 09:00:00.250000+0900"})
    path.write_text("Filtering the log\n" + line("a") + "\n" + line("b") + "\n")
    assert [(r["message"], r["ts"]) for r in events.scan(spark, str(path), "Filtering").orderBy("line").collect()] == [("a", 1704067200.25), ("b", 1704067200.25)]
    for wrong in (line("a"), "Filtering\n{x\n", "Filtering\n" + json.dumps({"eventMessage": 1}), "Filtering\n" + line("x" * 70_000)):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            events.scan(spark, str(path), "Filtering")


def test_percentiles_by_key_match_those_of_lists(spark):
    rows = [("a", (i * 7919) % 5003) for i in range(5000)] + [("b", 5), ("c", 1), ("c", 9), ("c", 4), ("d", 3)] + [("d", 3)] * 2000
    df = spark.createDataFrame([*rows, ("e", None)], "k string, v int")
    got = {r["k"]: (r["n"], (r["whole"], r["hundredths"]), r["nearest"]) for r in stats.percentile_95_by(df, "k", "v").collect()}
    lists = {k: [x for j, x in rows if j == k] for k in "abcd"}
    assert got == {k: (len(x), stats.percentile_95(x), stats.nearest_rank_95(x)) for k, x in lists.items()}


def test_pre_tokens(spark):
    t = "I'll go  there,\n\n42 times!  Ünï\t x"
    (row,) = spark.createDataFrame([(t,)], "t string").select(text.pre_tokens(F.col("t")).alias("x")).collect()
    assert list(row["x"]) == ["I", "'ll", " go", " ", " there", ",\n\n", "4", "2", " times", "!", " ", " Ünï", "\t", " x"]


def test_history_rotates(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(4):
        (source / f"{i}.txt").write_text(f"{i}" * 50 + "\n")
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(source))
    run = streams.append_history(stream, str(out), str(tmp_path / "check"), 60)
    run.processAllAvailable()
    run.stop()
    assert sorted(p.name for p in out.iterdir()) == ["segment=0", "segment=1"]
    assert sorted(r["value"][0] for r in spark.read.option("recursiveFileLookup", "true").text(str(out)).collect()) == ["0", "1", "2", "3"]


def test_own_encoder_equals_the_library():
    import random

    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    letters = bpe.byte_letters()
    assert len(set(letters)) == 256 and letters[ord("a")] == "a" and letters[32] == chr(288)
    merges = [("h", "e"), ("l", "l"), ("he", "ll"), (letters[32], "w"), ("o", "r"), (letters[32] + "w", "or"), ("l", "o"), (letters[0xC3], letters[0xA9]), ("e", "r")]
    vocabulary = {x: i for i, x in enumerate([*letters, *(a + b for a, b in merges)])}
    library = Tokenizer(models.BPE(vocabulary, merges))
    library.normalizer = normalizers.NFC()
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(text.PRE_TOKENS), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    library.decoder = decoders.ByteLevel()
    own = bpe.Encoder.from_json(library.to_str())
    rng = random.Random(9)
    alphabet = "hello world er  \n\t'sré é12😀.,!?\u00a0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "hello world", "I'LL don't", "e\u0301 caf\u00e9"]
    for t in texts:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, t


def test_encoder_as_a_column(spark):
    encoder = bpe.Encoder({x: i for i, x in enumerate(bpe.byte_letters())}, [])
    got = spark.createDataFrame([("ab",), (None,), ("",), ("x" * 9,)], "t string").select(bpe.encoded(encoder, 8)(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [[97, 98], None, [], None]


def test_document_frequencies_are_those_of_the_rows(spark):
    rows = [("a", [1, 2, 1, 2, 0, 3]), ("b", [2, 1]), ("c", []), ("d", None), ("e", [1, 2, 1, 2, 0, 3]), ("f", [3])]
    df = spark.createDataFrame(rows, "id string, ids array<int>").coalesce(1)
    by_rows = features.ngrams(df).groupBy("n", "key").agg(F.count("*").alias("df"))
    assert {tuple(r) for r in features.document_frequencies(df).collect()} == {tuple(r) for r in by_rows.collect()}


def test_aggregates_by_group(spark):
    df = spark.createDataFrame([("g", "A", "A", 0.9), ("g", "A", "B", 0.8), ("g", "B", "B", 1.0), ("h", "A", None, 0.1)], "g string, gold string, said string, conf double")
    gold, said = F.col("gold"), F.col("said")
    ok = F.coalesce(gold == said, F.lit(False))
    got = {r["g"]: r for r in df.groupBy("g").agg(aggregates.accuracy(gold, said).alias("a"), aggregates.macro_f1(gold, said, ["A", "B", "C"]).alias("f"), aggregates.calibration_error(F.col("conf"), ok).alias("e"), aggregates.paired_p(ok, F.lit(False)).alias("p")).collect()}
    assert abs(got["g"]["a"] - 2 / 3) < 1e-12 and abs(got["g"]["f"] - 2 / 3) < 1e-12 and got["h"]["f"] == 0 and got["h"]["a"] == 0
    assert abs(got["g"]["e"] - (abs(0.9 - 1) + 0.8 + 0) / 3) < 1e-12 and got["g"]["p"] == 0.5 and got["h"]["p"] == 1


def test_jobs_records_and_measurements():
    assert search.transition("queued", "start") == "running" and search.transition("cancelling", "finish") == "cancelled"
    with pytest.raises(ValueError):
        search.transition("done", "start")
    assert search.job_status(None, False) == "none" and search.job_status({"state": "running"}, False) == "interrupted" and search.job_status({"state": "done"}, False) == "done"
    record = search.SearchRecord((search.Entry("a", "evaluated", 3, 4, 0.25), search.Entry("b", "scoring_failed")), "a", ("a",))
    assert json.loads(search.record_json(record)) == {"entries": [{"candidate": "a", "state": "evaluated", "n_correct": 3, "n": 4, "milliseconds": 250}, {"candidate": "b", "state": "scoring_failed", "n_correct": None, "n": None, "milliseconds": 0}], "selected": "a", "tied": ["a"]}
    ticks = iter(range(0, 10**9, 1_000_000))
    found = search.measured(lambda: None, 2, 5, 60.0, lambda: next(ticks))
    assert found == {"n": 5, "complete": True, "p95_us": (1000, 0), "mean_us": 1000}
    slow = iter(range(0, 10**12, 10**9))
    assert search.measured(lambda: None, 0, 100, 9.5, lambda: next(slow))["complete"] is False


def test_packages_of_more_bytes_than_an_int_holds(spark, tmp_path):
    from assayer.plans import registry

    rows = [(2, "x" * 120_000), (4, "é" * 60_000), (8, "x" * 2000), (14, "x" * 2001), (1, "x" * 120_000), (9, "x" * 120_000), (25, "x" * 120_000), (16, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["line"]: (r["reason"], r["unknown"]) for r in registry.QUERIES["package_eligibility"](spark, str(tmp_path)).collect()}
    over = ("vocabulary_over_guideline", "")
    assert got == {2: over, 4: over, 8: (None, ""), 14: over, 1: (None, ""), 9: ("unsupported_ops", "Loop"), 25: ("prediction_mismatch", ""), 16: (None, "")}
