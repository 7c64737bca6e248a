"""Choosing among candidates, reports over them, and what a package may be."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .compare import holm
from .evaluation import align, correct

#: Exit codes, the guideline of a package's size, the guideline of latency.
EXIT_CODES = {"ok": 0, "judged_fail": 10, "out_of_scope": 11, "pending": 12, "limit_exceeded": 20, "invalid_input": 64, "runtime_error": 70}
SIZE_GUIDELINE = 40_000_000
LATENCY_GUIDELINE_US = 250_000
#: Candidates that are compared at once; each is judged on every gold row.
MOST_CANDIDATES = 4096


def candidate_outcomes(gold: DataFrame, predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(candidate, id, gold, kind, label, reason, correct): every gold row for every candidate; predictions carry `candidate`."""
    candidates = predictions.select("candidate").distinct()
    if candidates.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError("too many candidates")
    keyed = gold.select("id", "label").join(F.broadcast(candidates)).select(F.struct("candidate", "id").alias("id"), "label")
    return correct(align(keyed, predictions.select(F.struct("candidate", "id").alias("id"), "status", "predicted_label"), labels)).select("id.candidate", "id.id", "gold", "kind", "label", "reason", "correct")


def report(outcomes: DataFrame, baseline: str, family_size: int | None = None, required: int = 0) -> DataFrame:
    """One row a candidate: n, n_correct, accuracy and its interval, the paired test against the baseline candidate, adjusted, and the verdict."""
    totals = outcomes.groupBy("candidate").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    base = outcomes.where(F.col("candidate") == baseline).select("id", F.col("correct").alias("base"))
    pairs = outcomes.where(F.col("candidate") != baseline).join(base, "id")
    tables = pairs.groupBy("candidate").agg(F.count_if(F.col("correct") & ~F.col("base")).alias("only_a"), F.count_if(~F.col("correct") & F.col("base")).alias("only_b"))
    tests = holm(tables.withColumn("p_value", stats.mcnemar_p(F.col("only_a"), F.col("only_b"))), order_col="candidate", family_size=family_size)
    joined = totals.join(tests, "candidate", "left").withColumn("ci", stats.wilson(F.col("n_correct"), F.col("n")))
    verdict = F.when(F.col("p_value").isNull(), F.lit(None)).when(F.col("n") < required, "undeterminable").when((F.col("only_a") > F.col("only_b")) & (F.col("adjusted_p") < stats.LEVEL), "better").otherwise("not_better")
    return joined.select("candidate", "n", "n_correct", F.expr("try_divide(n_correct, n)").alias("accuracy"), "ci.lo", "ci.hi", "only_a", "only_b", "p_value", "adjusted_p", verdict.alias("verdict"))


@dataclass(frozen=True)
class Selection:
    candidate: str | None
    n_correct: int
    n: int
    tied: list[str]


def select_best(totals: DataFrame, order: list[str]) -> Selection:
    """The candidate with the most correct rows, the first declared of equals; totals: (candidate, n, n_correct), a row each."""
    rows = sorted(totals.select("candidate", "n", "n_correct").where(F.col("candidate").isin(order)).collect(), key=lambda r: order.index(r["candidate"]))
    if not rows:
        return Selection(None, 0, 0, [])
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("candidates were not judged on the same number of rows")
    best = max(r["n_correct"] for r in rows)
    tied = [r["candidate"] for r in rows if r["n_correct"] == best]
    return Selection(tied[0], best, rows[0]["n"], tied)


def set_difference(expected: DataFrame, found: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, side, n): ids that do not occur exactly once on both sides."""
    a = expected.groupBy(id_col).agg(F.count("*").alias("expected"))
    b = found.groupBy(id_col).agg(F.count("*").alias("found"))
    both = a.join(b, id_col, "full").select(id_col, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("expected <> 1 or found <> 1")


def reproducibility(runs: DataFrame, least: int = 3, most: int = 100) -> DataFrame:
    """(i, j) of disagreeing runs, after checking that the runs (i, seed, n, n_correct, data_sha256) are comparable."""
    found = runs.agg(F.count("*").alias("n"), F.count_distinct("seed").alias("seeds"), F.count_distinct("n").alias("totals"), F.count_distinct("data_sha256").alias("data")).first()
    if not least <= found["n"] <= most or found["seeds"] != found["n"] or found["totals"] != 1 or found["data"] != 1:
        raise ValueError("the runs cannot be compared")
    from .compare import disjoint_intervals

    return disjoint_intervals(runs.select("i", stats.wilson(F.col("n_correct"), F.col("n")).alias("ci")).select("i", "ci.lo", "ci.hi"))


def capacity(files: DataFrame) -> DataFrame:
    """(component, n_files, bytes) of (component, path, length); a path that is listed twice is an error."""
    if files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a file is listed twice")
    return files.groupBy("component").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def over(value: Column, limit: int | None) -> Column:
    """Whether a value exceeds a limit; null without one."""
    return F.lit(None).cast("boolean") if limit is None else value > limit


def package_outcome(breaches: list[str], quality: str) -> tuple[int, str]:
    """(exit code, verdict): a broken limit comes before the quality, which is pass, fail, undeterminable or not_defined."""
    if breaches:
        return EXIT_CODES["limit_exceeded"], "limit_exceeded"
    codes = {"fail": "judged_fail", "undeterminable": "pending", "pass": "ok", "not_defined": "ok"}
    return EXIT_CODES[codes[quality]], quality


def eligible(candidates: DataFrame, allowed_ops: list[str], limit: int = SIZE_GUIDELINE) -> DataFrame:
    """candidates (candidate, bytes, has_vocabulary, ops, mismatches) with the first reason that excludes each, null if none does."""
    unknown = F.array_except("ops", F.array(*[F.lit(x) for x in allowed_ops]).cast("array<string>"))
    reason = F.when(F.size(unknown) > 0, "unsupported_ops").when(F.col("mismatches") > 0, "prediction_mismatch").when(F.col("has_vocabulary") & (F.col("bytes") > limit), "vocabulary_over_guideline")
    return candidates.select("*", reason.alias("reason"), F.slice(F.array_sort(unknown), 1, 16).alias("unknown_ops"))


def top_scores(results: DataFrame, k: int = 3) -> DataFrame:
    """(id, place, label, score): the k highest scores of each row; scores is an array of (id, score) in label order."""
    ranked = F.slice(F.array_sort(F.transform("scores", lambda s, i: F.struct((-s["score"]).alias("s"), i.alias("pos"), s["id"].alias("label")))), 1, k)
    return results.select("id", F.posexplode(ranked).alias("place", "x")).select("id", (F.col("place") + 1).alias("place"), "x.label", (-F.col("x.s")).alias("score"))


def mistakes(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    """(id, gold, kind, label, input) of the rows that were not judged right."""
    return outcomes.where("not correct").join(records.select("id", "input"), "id").select("id", "gold", "kind", "label", "input")


def even_batches(rows: DataFrame, length: Column, size: int, order_col: str = "pos") -> DataFrame:
    """rows with batch: rows sorted by length (ties in order) in runs of `size`, the rest kept; for bounded tables."""
    from pyspark.sql import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(length, order_col)) - 1) / size).cast("long"))
