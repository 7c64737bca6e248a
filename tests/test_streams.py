import json

from pyspark.sql import functions as F

from assayer.streaming import streams


def test_history_rates(spark, tmp_path):
    folder = tmp_path / "history"
    folder.mkdir()
    lines = [{"time": 100 + k, "text": "x", "output": "{}", "exit_code": k % 2, "elapsed_ms": k, "package": "p", "version": "1"} for k in range(10)]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rates = streams.history_rates(streams.history(spark, str(folder)))
    query = rates.writeStream.outputMode("complete").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    row = spark.table("rates").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed")).first()
    assert (row["n"], row["failed"]) == (10, 5)


def test_fold_keeps_its_state_between_batches(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    stream = spark.readStream.schema("k string, seq long, copies int").json(str(folder))
    query = streams.fold_stream(stream, ["k"]).writeStream.format("memory").queryName("folded").outputMode("append").start()
    for name, rows in (("1", [("a", 1, None), ("a", 2, None)]), ("2", [("a", 3, 4), ("b", 4, 2)]), ("3", [("a", 5, 1), ("a", 6, 1)])):
        (folder / f"{name}.json").write_text("\n".join(json.dumps({"k": k, "seq": s, "copies": c}) for k, s, c in rows))
        query.processAllAvailable()
    query.stop()
    got = sorted((r["seq"], r["occurrences"], r["claimed"]) for r in spark.table("folded").collect())
    assert got == [(1, 1, False), (2, 1, False), (3, 4, True), (4, 3, False), (5, 1, True), (6, 2, False)]


def test_batches_are_all_or_nothing(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"id": "1", "predicted_label": "A"}))
    stream = spark.readStream.schema("id string, predicted_label string").json(str(folder))
    query = streams.score_batches(stream, lambda df: df, out, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    (folder / "2.json").write_text(json.dumps({"id": "2", "predicted_label": "B"}) + "\n" + json.dumps({"id": "3"}))
    try:
        query.processAllAvailable()
    except Exception:
        pass
    query.stop()
    assert [r["id"] for r in spark.read.parquet(out).collect()] == ["1"]
