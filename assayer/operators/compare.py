"""Comparisons of candidates with a baseline, with each other, and with what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def majority_label(records: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n): the most frequent label, the first declared of equals."""
    counts = records.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    return counts.join(labels, "label").orderBy(F.desc("n"), "pos").limit(1).select("label", "n")


def paired_counts(pairs: DataFrame, a: str = "candidate", b: str = "baseline") -> DataFrame:
    """One row from two boolean columns: both, only_a, only_b, neither, n."""
    x, y = F.col(a), F.col(b)
    return pairs.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), F.count("*").alias("n"))


def paired_test(counts: DataFrame, required: int = 0) -> DataFrame:
    """counts with p_value and verdict (better, not_better, undeterminable)."""
    tested = counts.withColumn("p_value", stats.mcnemar_p(F.col("only_a"), F.col("only_b")))
    verdict = F.when(F.col("n") < required, "undeterminable").when((F.col("only_a") > F.col("only_b")) & (F.col("p_value") < stats.LEVEL), "better").otherwise("not_better")
    return tested.withColumn("verdict", verdict)


def regression(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(id, previous, current) of the ids in both; each has (id, correct). See incomplete for what has no partner."""
    return previous.select("id", F.col("correct").alias("previous")).join(current.select("id", F.col("correct").alias("current")), "id")


def incomplete(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(id, problem): missing_previous, missing_current or repeated, for ids that do not occur exactly once on both sides."""
    sides = previous.select("id", F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(current.select("id", F.lit(0).alias("p"), F.lit(1).alias("c")))
    counts = sides.groupBy("id").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    problem = F.when(F.col("p") == 0, "missing_previous").when(F.col("c") == 0, "missing_current").when((F.col("p") > 1) | (F.col("c") > 1), "repeated")
    return counts.select("id", problem.alias("problem")).where("problem is not null")


def regression_report(previous: DataFrame, current: DataFrame) -> DataFrame:
    """transitions of two evaluations of the same records; ValueError if an id is missing on a side or repeats."""
    wrong = incomplete(previous, current).groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']} (first {r['first']})" for r in sorted(wrong, key=lambda r: r["problem"])))
    return transitions(regression(previous, current))


def transitions(pairs: DataFrame) -> DataFrame:
    """(transition, n, rate, lo, hi): kept, lost, gained, missed, each with the interval of its share of all rows."""
    name = F.when(F.col("previous") & F.col("current"), "kept").when(F.col("previous"), "lost").when(F.col("current"), "gained").otherwise("missed")
    names = pairs.sparkSession.createDataFrame([("kept",), ("lost",), ("gained",), ("missed",)], "transition string")
    counts = names.join(pairs.groupBy(name.alias("transition")).agg(F.count("*").alias("n")), "transition", "left").select("transition", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # four rows
    return counts.select("*", total.alias("total")).select("transition", "n", F.expr("try_divide(n, total)").alias("rate"), stats.wilson(F.col("n"), F.col("total")).alias("ci")).select("transition", "n", "rate", "ci.lo", "ci.hi")


def holm(tests: DataFrame, p_col: str = "p_value", order_col: str = "pos", family_size: int | None = None) -> DataFrame:
    """tests (one row a candidate) with adjusted_p: ranks ascending, ties in the order given, running maximum."""
    ranked = tests.withColumn("__rank", F.row_number().over(Window.orderBy(p_col, order_col))).withColumn("__m", F.lit(family_size) if family_size else F.count("*").over(Window.partitionBy()))
    raw = F.least(F.lit(1.0), (F.col("__m") - F.col("__rank") + 1) * F.col(p_col))
    return ranked.withColumn("adjusted_p", F.max(raw).over(Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0))).drop("__rank", "__m")


def label_set_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(change, pos, label): removed labels in the previous order, added ones in the current."""
    removed = previous.join(current, "label", "left_anti").select(F.lit("removed").alias("change"), "pos", "label")
    added = current.join(previous, "label", "left_anti").select(F.lit("added").alias("change"), "pos", "label")
    return removed.unionByName(added)


def disjoint_intervals(runs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(i, j) with i < j of runs (i, lo, hi; at most some hundred) whose intervals do not overlap."""
    other = F.broadcast(runs.select(F.col("i").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")))
    return runs.join(other, (F.col("i") < F.col("j")) & ((F.col("hi") < F.col("lo2") - tolerance) | (F.col("hi2") < F.col("lo") - tolerance))).select("i", "j")


def common_rows(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("id", "input", "label")) -> DataFrame:
    """One row: n_common (equal in all keys), n_previous_only, n_current_only by counts."""
    common = previous.select(*keys).join(current.select(*keys), list(keys)).agg(F.count("*").alias("n_common"))
    sizes = previous.agg(F.count("*").alias("p")).crossJoin(current.agg(F.count("*").alias("c")))
    return common.crossJoin(sizes).select("n_common", (F.col("p") - F.col("n_common")).alias("n_previous_only"), (F.col("c") - F.col("n_common")).alias("n_current_only"))
