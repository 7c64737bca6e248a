"""Gold labels against predictions: alignment, outcomes, confusion matrix and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the confusion matrix beside the labels.
EXTRA = ("<invalid>", "<abstain>", "<error>")
KINDS = ("label", "invalid", "abstain", "error")
SCORE_TOLERANCE = 1e-6


def classify(status: Column, predicted: Column, known: Column) -> Column:
    """struct(kind, label, reason) of a prediction; known says whether predicted is a declared label."""
    out = lambda kind, label=None, reason=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if label is None else label).alias("label"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when((status == "ok") & predicted.isNull(), out("invalid", None, "not_string"))
        .when((status == "ok") & known, out("label", predicted))
        .when(status == "ok", out("invalid", None, "unknown_label"))
        .when(status == "abstain", out("abstain"))
        .when(status == "error", out("error", None, "reported"))
        .otherwise(out("invalid", None, "unknown_status"))
    )


def align(gold: DataFrame, predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, gold, kind, label, reason): every gold row with its outcome; no prediction is an error, predictions without gold are dropped."""
    known = labels.select(F.col("label").alias("predicted_label"), F.lit(True).alias("known"))
    judged = predictions.join(known, "predicted_label", "left").select("id", classify(F.col("status"), F.col("predicted_label"), F.coalesce("known", F.lit(False))).alias("o"))
    missing = F.struct(F.lit("error").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit("missing_prediction").alias("reason"))
    return gold.select("id", F.col("label").alias("gold")).join(judged, "id", "left").select("id", "gold", F.coalesce("o", missing).alias("o")).select("id", "gold", "o.kind", "o.label", "o.reason")


def scores_invalid(scores: Column) -> Column:
    """Present scores that are empty of sense: a null, non-finite or negative one, or a sum off one by more than the tolerance."""
    values = F.map_values(scores)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.coalesce(bad | (F.abs(total - 1) > SCORE_TOLERANCE), F.lit(False))


def correct(rows: DataFrame) -> DataFrame:
    return rows.withColumn("correct", F.coalesce((F.col("kind") == "label") & (F.col("label") == F.col("gold")), F.lit(False)))


def cells(rows: DataFrame) -> DataFrame:
    """(gold, predicted, n) of the cells that occur; what is no label falls into one of the extra columns."""
    column = F.when(F.col("kind") == "label", F.col("label"))
    for kind, name in zip(KINDS[1:], EXTRA, strict=True):
        column = column.when(F.col("kind") == kind, name)
    return rows.groupBy("gold", column.alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(gold, predicted, n) with all cells of the declared labels; labels are a bounded table."""
    names = labels.select("label")
    extra = rows.sparkSession.createDataFrame([(x,) for x in EXTRA], "label string")
    grid = names.select(F.col("label").alias("gold")).crossJoin(names.union(extra).select(F.col("label").alias("predicted")))
    return grid.join(cells(rows), ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_metrics(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(pos, label, support, predicted, tp, precision, recall, f1): precision is null without predictions, recall without support, f1 without either."""
    cell = cells(rows)
    support = cell.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cell.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = labels.join(support, "label", "left").join(predicted, "label", "left").select("pos", "label", zero("support"), zero("predicted"), zero("tp"))
    return joined.select("*", F.expr("try_divide(tp, predicted)").alias("precision"), F.expr("try_divide(tp, support)").alias("recall"), F.expr("try_divide(2 * tp, support + predicted)").alias("f1"))


def macro_f1(metrics: DataFrame) -> DataFrame:
    """One row: the mean of the labels' defined f1, added up in declaration order, and how many are defined."""
    ordered = metrics.where("f1 is not null").agg(F.sort_array(F.collect_list(F.struct("pos", "f1"))).alias("x"))  # a row for each label
    return ordered.select(F.expr("try_divide(aggregate(x, 0D, (a, y) -> a + y.f1), size(x))").alias("macro_f1"), F.size("x").cast("long").alias("n_labels"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: n, counts by outcome, correct, accuracy over all rows, over adopted ones (all but abstentions), coverage."""
    counts = correct(rows).agg(
        F.count("*").alias("n"), F.count_if(F.col("correct")).alias("n_correct"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
    )
    return counts.select(
        "*", F.expr("try_divide(n_correct, n)").alias("accuracy"), F.expr("try_divide(n_correct, n - n_abstain)").alias("adopted_accuracy"), F.expr("try_divide(n - n_abstain, n)").alias("coverage"),
        F.expr("try_divide(n_error, n)").alias("error_rate"),
    )


def quadrant(rows: DataFrame) -> DataFrame:
    """One row that parts all rows into five: type and meaning right, meaning wrong, type wrong, abstention, error."""
    c = correct(rows)
    return c.agg(
        F.count_if(F.col("correct")).alias("type_ok_meaning_ok"), F.count_if((F.col("kind") == "label") & ~F.col("correct")).alias("type_ok_meaning_ng"),
        F.count_if(F.col("kind") == "invalid").alias("type_ng"), F.count_if(F.col("kind") == "abstain").alias("abstain"), F.count_if(F.col("kind") == "error").alias("error"),
    )


def confusable_pairs(rows: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent confusions between labels: gold, predicted, n, in order of n, then of the labels' declaration."""
    if not 1 <= k <= 1000:
        raise ValueError("k must lie in 1..1000")
    pos = lambda name: labels.select(F.col("label").alias(name), F.col("pos").alias(f"{name}_pos"))
    off = cells(rows).where("gold <> predicted").join(pos("gold"), "gold").join(pos("predicted"), "predicted")
    return off.orderBy(F.desc("n"), "gold_pos", "predicted_pos").limit(k).select("gold", "predicted", "n")


def warnings(gold: DataFrame, predictions: DataFrame, labels: DataFrame, key: Column) -> DataFrame:
    """(code, action, n) of what alignment has to say. gold: id, label, input, line; predictions: id, status, predicted_label.

    Rows without a gold label, with an unknown one, or whose input has several are
    excluded; a repeated input is only said; labels that no row has are counted last.
    """
    known = labels.select("label", F.lit(True).alias("known"))
    judged = gold.join(known, "label", "left").select("*", F.when(F.col("label").isNull(), "missing_gold").when(F.col("known").isNull(), "unknown_gold_label").alias("code"))
    valid = judged.where("code is null").drop("code")
    from .quality import duplicate_inputs

    repeated = duplicate_inputs(valid, key, "label")
    active = valid.join(repeated.where("code = 'contradictory_label'").select("line"), "line", "left_anti")
    unseen = labels.join(active.select("label").distinct(), "label", "left_anti").select(F.lit("unseen_class").alias("code"))
    codes = judged.where("code is not null").select("code").unionByName(repeated.select("code")).unionByName(unseen)
    action = F.when(F.col("code").isin("missing_gold", "unknown_gold_label", "contradictory_label"), "exclude").otherwise("warn_include")
    return codes.groupBy("code").agg(F.count("*").alias("n")).select("code", action.alias("action"), "n")
