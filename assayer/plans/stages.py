"""Whole stages: inspect a dataset, and evaluate predictions on frozen data."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontools import answer_needles
from ..functions.text import normalised
from ..operators import calibration, compare, evaluation, quality, selection, split
from ..sources import jsonl, sides
from ..sources.sides import BadInput


@contextmanager
def held(*frames: DataFrame) -> Iterator[None]:
    """The frames cached for the block and let go after it, so that a later read of the same path sees the files anew."""
    for df in frames:
        df.cache()
    try:
        yield
    finally:
        for df in frames:
            df.unpersist()


@dataclass(frozen=True)
class Inspected:
    records: DataFrame  # train records with their split
    evaluation: DataFrame
    report: dict[str, Any]


def _records(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    found = jsonl.inspect(jsonl.lines(spark, path), labels)
    place = F.struct("file", "line", "field")
    first = found.anomalies.agg(F.min(place)["line"].alias("line"), F.min_by("code", place).alias("code")).first()
    if first["line"] is not None:
        raise BadInput(first["code"], first["line"])
    return found.records.withColumnRenamed("label_id", "label")


def inspect_dataset(spark: SparkSession, train_path: str, evaluation_path: str, labels: list[str], seed: int = 0, ratios: split.Ratios = split.Ratios()) -> Inspected:  # noqa: B008
    """Checks both files, splits the training records by group, and makes sure that no input and no group leaks.

    Any anomaly, missing group, empty split, leak or straddling group stops the stage.
    Contradictions and metadata in inputs are counted in the report; no text or id is.
    """
    train, test = _records(spark, train_path, labels), _records(spark, evaluation_path, labels)
    groups = split.split_groups(train, seed, ratios)
    records = split.split_records(train, groups)
    with held(train, test, records):
        if train.isEmpty() or test.isEmpty():
            raise BadInput("empty_data")
        if not train.where("group_id is null").isEmpty():
            raise BadInput("missing_group")
        manifest = {r["split"]: {"n": r["n"], "digest": r["digest"]} for r in split.digests(records).collect()}
        wanted = [s for s, share in zip(split.SPLITS, (ratios.train, ratios.validation, ratios.test), strict=True) if share > 0]
        if set(wanted) - manifest.keys():
            raise BadInput("empty_split")
        parts = records.select("id", "input", "group_id", F.col("split").alias("part")).unionByName(test.select("id", "input", "group_id", F.lit("evaluation").alias("part")))
        if not quality.input_leaks(parts).isEmpty():
            raise BadInput("input_leak")
        if not quality.group_straddles(parts).isEmpty():
            raise BadInput("group_straddle")
        report = {
            "n_train": train.count(),
            "n_evaluation": test.count(),
            "splits": manifest,
            "contradictions": quality.contradictions(train, F.sha2(normalised("input"), 256), F.col("label")).count(),
            "metadata_mixed": quality.metadata_mixed(train, {"id": F.col("id"), "label": F.col("label")}, answers=answer_needles(F.to_json(F.struct(F.col("label").alias("intent"))))).count(),
        }
    return Inspected(records, test, report)


def evaluate_predictions(spark: SparkSession, gold_path: str, predictions_path: str, labels: list[str], key: Column | None = None, min_accuracy: float | None = None, baseline: str | None = None, required: int = 0, top_k: int = 10) -> dict[str, Any]:
    """Aligns the files and reports totals, metrics, confusions, warnings, acceptance and the test against the majority label.

    baseline is the training data's majority label; without it the evaluation's own is taken.
    """
    names = spark.createDataFrame(list(enumerate(labels)), "pos int, label string")
    gold = sides.gold(jsonl.lines(spark, gold_path), labels)
    predictions = sides.predictions(jsonl.lines(spark, predictions_path))
    valid = gold.where("code is null")
    same = F.sha2("input", 256) if key is None else key
    contradictory = quality.duplicate_inputs(valid.where("input is not null"), same, "label", "id").where("code = 'contradictory_label'").select(F.col("line").alias("id"))
    active = valid.join(contradictory, "id", "left_anti")
    rows = evaluation.correct(evaluation.align(active, predictions, names))
    with held(active, rows):
        if active.isEmpty():
            raise BadInput("empty_data")
        return _report(spark, gold, active, rows, contradictory, names, min_accuracy, baseline, required, top_k)


def _report(spark: SparkSession, gold: DataFrame, active: DataFrame, rows: DataFrame, contradictory: DataFrame, names: DataFrame, min_accuracy: float | None, baseline: str | None, required: int, top_k: int) -> dict[str, Any]:
    total = evaluation.totals(rows).first().asDict()
    metrics = evaluation.label_metrics(rows, names)
    codes = gold.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()
    warned = {r["code"]: r["n"] for r in codes} | {"contradictory_label": contradictory.count(), "unseen_class": quality.absent_labels(active, names).count()}
    warned |= {f"all_{kind}": total["n"] for kind in ("abstain", "error") if total[f"n_{kind}"] == total["n"]}
    majority = baseline or compare.majority_label(active, names).first()["label"]
    pairs = rows.select(F.col("correct").alias("candidate"), (F.col("gold") == majority).alias("baseline"))
    tested = compare.paired_test(compare.paired_counts(pairs), required).first().asDict()
    ci = spark.range(1).select(selection.stats.wilson(F.lit(total["n_correct"]), F.lit(total["n"])).alias("ci")).first()["ci"]
    verdict = None
    if min_accuracy is not None:
        verdict = spark.range(1).select(selection.stats.accuracy_verdict(F.lit(ci["lo"]), F.lit(ci["hi"]), min_accuracy).alias("v")).first()["v"]
    return {
        "totals": total,
        "interval": (ci["lo"], ci["hi"]),
        "per_label": [r.asDict() for r in metrics.orderBy("pos").collect()],
        "macro_f1": evaluation.macro_f1(metrics).first()["macro_f1"],
        "quadrant": evaluation.quadrant(rows).first().asDict(),
        "confusable": [tuple(r) for r in evaluation.confusable_pairs(rows, names, top_k).collect()],
        "warnings": {code: n for code, n in warned.items() if n},
        "baseline": {"label": majority, **tested},
        "acceptance": verdict,
    }


def calibrate_on_validation(scores: DataFrame, labels: list[str]) -> calibration.Calibration:
    """Calibration from (gold, scores), the scores probabilities in label order; their logarithms are the logits, of zero -inf."""
    logits = F.transform("scores", lambda p: F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf"))))
    return calibration.calibrate(calibration.prepared(scores.select("gold", logits.alias("logits")), labels))
