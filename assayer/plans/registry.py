"""Registered queries over the test tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text, times
from ..operators import calibration, compare, evaluation, events, features, inference, quality, selection, split
from ..sources import jsonl
from .views import CLASSES, LABELS, SPREAD, Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "per_label_metrics"


def query(name: str, oracle: str | None = None) -> Callable:
    def add(run: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: run(Views(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return run

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def outcomes(v: Views) -> DataFrame:
    return evaluation.align(v.records, v.predictions, v.labels)


def pairs(v: Views) -> DataFrame:
    now = evaluation.correct(outcomes(v)).select("id", F.col("correct").alias("candidate"))
    before = evaluation.correct(evaluation.align(v.records, v.previous, v.labels)).select("id", F.col("correct").alias("baseline"))
    return now.join(before, "id")


def logits(v: Views) -> DataFrame:
    return calibration.prepared(v.logits, [str(i) for i in range(CLASSES)])


# --- contract checks -------------------------------------------------------------------------------------------------

@query("label_report", sql("SELECT l.pos, l.label, count(r.id) AS n FROM v_lbl l LEFT JOIN v_rec r ON r.label = l.label GROUP BY l.pos, l.label", "v_rec", "v_lbl"))
def _(v: Views) -> DataFrame:
    return quality.label_counts(v.records, v.labels)


@query(
    "dataset_summary",
    sql("""SELECT (SELECT count(*) FROM v_rec) AS n_rows, (SELECT count(DISTINCT input) FROM v_rec) AS n_inputs, count(*) FILTER (n > 0) AS n_labels, min(n) FILTER (n > 0) AS min_count, count(*) FILTER (n = 0) AS n_absent
    FROM (SELECT l.label, count(r.id) AS n FROM v_lbl l LEFT JOIN v_rec r ON r.label = l.label GROUP BY l.label)""", "v_rec", "v_lbl"),
)
def _(v: Views) -> DataFrame:
    return quality.summary(v.records, v.labels)


@query("absent_labels", sql("SELECT pos, label FROM v_lbl WHERE label NOT IN (SELECT label FROM v_rec)", "v_rec", "v_lbl"))
def _(v: Views) -> DataFrame:
    return quality.absent_labels(v.records, v.labels)


@query("data_volume", sql("SELECT label, count(*) AS n, CASE WHEN count(*) < 100 THEN 'few' WHEN count(*) < 3000 THEN 'some' ELSE 'many' END AS volume FROM v_rec GROUP BY label", "v_rec"))
def _(v: Views) -> DataFrame:
    return v.records.groupBy("label").agg(F.count("*").alias("n")).withColumn("volume", quality.data_volume(F.col("n")))


@query("duplicate_ids", sql("SELECT id, line FROM (SELECT CASE WHEN line % 5 = 0 THEN 'shared' || line // 10 ELSE id END AS id, line, count(*) OVER (PARTITION BY CASE WHEN line % 5 = 0 THEN 'shared' || line // 10 ELSE id END) AS n FROM v_rec) WHERE n > 1", "v_rec"))
def _(v: Views) -> DataFrame:
    return quality.duplicate_ids(v.records.withColumn("id", F.expr("if(line % 5 = 0, concat('shared', line div 10), id)")))


@query("first_valid_line", sql("SELECT key, line, first_line FROM (SELECT label || group_id AS key, line, min(CASE WHEN line % 4 > 0 THEN line END) OVER (PARTITION BY label || group_id) AS first_line FROM v_rec) WHERE line > first_line", "v_rec"))
def _(v: Views) -> DataFrame:
    return quality.first_lines(v.records.withColumn("key", F.concat("label", "group_id")), "key", fine=F.col("line") % 4 > 0)


@query(
    "contradictions",
    sql(r"""SELECT sha256(key) AS key, min(id) AS first_id, count(*) AS n_ids, count(DISTINCT gold) AS n_gold, count(DISTINCT group_id) AS n_groups, count(*) FILTER (group_id IS NULL) AS n_without_group
    FROM (SELECT trim(regexp_replace(input, '\s+', ' ', 'g')) AS key, CAST(line % 3 AS VARCHAR) AS gold, id, group_id FROM v_rec) GROUP BY sha256(key) HAVING count(DISTINCT gold) >= 2""", "v_rec"),
)
def _(v: Views) -> DataFrame:
    return quality.contradictions(v.records, F.sha2(text.collapsed(F.col("input")), 256), (F.col("line") % 3).cast("string"))


@query(
    "contradiction_members",
    sql(r"""SELECT sha256(key) AS key, id, gold FROM (SELECT *, min(gold) OVER (PARTITION BY key) AS a, max(gold) OVER (PARTITION BY key) AS b
    FROM (SELECT trim(regexp_replace(input, '\s+', ' ', 'g')) AS key, CAST(line % 3 AS VARCHAR) AS gold, id FROM v_rec)) WHERE a <> b""", "v_rec"),
)
def _(v: Views) -> DataFrame:
    return quality.contradiction_members(v.records, F.sha2(text.collapsed(F.col("input")), 256), (F.col("line") % 3).cast("string"))


@query(
    "duplicate_inputs",
    sql("""SELECT line, CASE WHEN a = b THEN 'duplicate_input' ELSE 'contradictory_label' END AS code
    FROM (SELECT line, count(*) OVER w AS n, min(line % 2) OVER w AS a, max(line % 2) OVER w AS b FROM v_rec WINDOW w AS (PARTITION BY input)) WHERE n > 1""", "v_rec"),
)
def _(v: Views) -> DataFrame:
    return quality.duplicate_inputs(v.records.withColumn("parity", F.col("line") % 2), F.sha2("input", 256), "parity")


@query(
    "metadata_mixed",
    sql("""SELECT id, CASE WHEN i AND l THEN 'id,label' WHEN i THEN 'id' ELSE 'label' END AS reasons
    FROM (SELECT id, contains(input, id) AS i, contains(input, ' ' || label || ' ') AS l FROM v_rec) WHERE i OR l""", "v_rec"),
)
def _(v: Views) -> DataFrame:
    found = quality.metadata_mixed(v.records, {"id": F.col("id"), "label": F.concat(F.lit(" "), F.col("label"), F.lit(" "))})
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "input_leaks",
    sql("""SELECT o.part, sha256(o.input) AS input_sha256, t.n AS n_base, o.n AS n_other, t.first_id AS first_base, o.first_id AS first_other
    FROM (SELECT part, input, count(*) AS n, min(id) AS first_id FROM v_part WHERE part <> 'train' GROUP BY 1, 2) o JOIN (SELECT input, count(*) AS n, min(id) AS first_id FROM v_part WHERE part = 'train' GROUP BY 1) t ON t.input = o.input""", "v_part"),
)
def _(v: Views) -> DataFrame:
    return quality.input_leaks(v.parts)


@query("group_straddles", sql("SELECT 'g' || line % 113 AS group_id, count(DISTINCT part) AS n_parts, count(*) AS n_records FROM v_part GROUP BY 1 HAVING count(DISTINCT part) >= 2", "v_part"))
def _(v: Views) -> DataFrame:
    return quality.group_straddles(v.parts.withColumn("group_id", F.concat(F.lit("g"), F.col("line") % 113)))


@query("group_labels", sql("SELECT group_id, label FROM (SELECT group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, label) AS k FROM v_rec GROUP BY group_id, label) WHERE k = 1", "v_rec"))
def _(v: Views) -> DataFrame:
    return quality.group_labels(v.records)


@query("resource_limits", sql("SELECT count(*) AS n_rows, max(strlen(id)) AS max_id_bytes, sum(strlen(id))::BIGINT AS total_id_bytes, max(strlen(input)) AS max_input_bytes, sum(strlen(input))::BIGINT AS total_input_bytes FROM v_rec", "v_rec"))
def _(v: Views) -> DataFrame:
    return quality.limits(v.records, ["id", "input"])


# --- alignment and metrics -------------------------------------------------------------------------------------------

@query("alignment", sql("SELECT id, gold, kind, label, reason FROM v_out", "v_out"))
def _(v: Views) -> DataFrame:
    return outcomes(v)


@query(
    "alignment_warnings",
    sql("""SELECT code, CASE WHEN code IN ('missing_gold', 'unknown_gold_label', 'contradictory_label') THEN 'exclude' ELSE 'warn_include' END AS action, count(*) AS n FROM (
    WITH g AS (SELECT line, input, CASE WHEN line % 31 = 0 THEN NULL WHEN line % 37 = 0 THEN 'zz' WHEN line % 2 = 0 THEN 'en' ELSE label END AS label FROM v_rec),
    k AS (SELECT g.*, CASE WHEN g.label IS NULL THEN 'missing_gold' WHEN l.label IS NULL THEN 'unknown_gold_label' END AS code FROM g LEFT JOIN v_lbl l ON l.label = g.label),
    d AS (SELECT line, label, CASE WHEN n = 1 THEN NULL WHEN a = b THEN 'duplicate_input' ELSE 'contradictory_label' END AS code FROM (SELECT line, label, count(*) OVER w AS n, min(label) OVER w AS a, max(label) OVER w AS b FROM k WHERE code IS NULL WINDOW w AS (PARTITION BY input)))
    SELECT code FROM k WHERE code IS NOT NULL UNION ALL SELECT code FROM d WHERE code IS NOT NULL
    UNION ALL SELECT 'unseen_class' FROM v_lbl WHERE label NOT IN (SELECT label FROM d WHERE code IS DISTINCT FROM 'contradictory_label')) GROUP BY code""", "v_rec", "v_lbl"),
)
def _(v: Views) -> DataFrame:
    gold = v.records.withColumn("label", F.when(F.col("line") % 31 == 0, F.lit(None)).when(F.col("line") % 37 == 0, "zz").when(F.col("line") % 2 == 0, "en").otherwise(F.col("label")))
    return evaluation.warnings(gold, v.predictions, v.labels, F.sha2("input", 256))


@query("outcome_totals", sql("""SELECT n, n_correct, n_label, n_invalid, n_abstain, n_error, round(n_correct / n, 9) AS accuracy, round(n_correct / (n - n_abstain), 9) AS adopted_accuracy, round((n - n_abstain) / n, 9) AS coverage, round(n_error / n, 9) AS error_rate FROM (
    SELECT count(*) AS n, count(*) FILTER (kind = 'label' AND label = gold) AS n_correct, count(*) FILTER (kind = 'label') AS n_label, count(*) FILTER (kind = 'invalid') AS n_invalid, count(*) FILTER (kind = 'abstain') AS n_abstain, count(*) FILTER (kind = 'error') AS n_error FROM v_out)""", "v_out"))  # fmt: skip
def _(v: Views) -> DataFrame:
    return rounded(evaluation.totals(outcomes(v)), "accuracy", "adopted_accuracy", "coverage", "error_rate")


@query("quadrant", sql("""SELECT count(*) FILTER (kind = 'label' AND label = gold) AS type_ok_meaning_ok, count(*) FILTER (kind = 'label' AND label <> gold) AS type_ok_meaning_ng, count(*) FILTER (kind = 'invalid') AS type_ng,
    count(*) FILTER (kind = 'abstain') AS abstain, count(*) FILTER (kind = 'error') AS error FROM v_out""", "v_out"))  # fmt: skip
def _(v: Views) -> DataFrame:
    return evaluation.quadrant(outcomes(v))


@query("confusion_matrix", sql("""SELECT g.label AS gold, p.label AS predicted, coalesce(c.n, 0)::BIGINT AS n FROM v_lbl g CROSS JOIN (SELECT label FROM v_lbl UNION ALL SELECT unnest(['<invalid>', '<abstain>', '<error>'])) p
    LEFT JOIN v_cell c ON c.gold = g.label AND c.predicted = p.label""", "v_cell"))  # fmt: skip
def _(v: Views) -> DataFrame:
    return evaluation.confusion_matrix(outcomes(v), v.labels)


@query("per_label_metrics", sql("""SELECT pos, label, support, predicted, tp, CASE WHEN predicted > 0 THEN round(tp / predicted, 9) END AS "precision", CASE WHEN support > 0 THEN round(tp / support, 9) END AS recall,
    CASE WHEN support + predicted > 0 THEN round(2 * tp / (support + predicted), 9) END AS f1 FROM v_metric""", "v_metric"))  # fmt: skip
def _(v: Views) -> DataFrame:
    return rounded(evaluation.label_metrics(outcomes(v), v.labels), "precision", "recall", "f1")


@query("macro_f1", sql("SELECT round(avg(f1), 9) AS macro_f1, count(f1) AS n_labels FROM (SELECT CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) END AS f1 FROM v_metric)", "v_metric"))
def _(v: Views) -> DataFrame:
    return rounded(evaluation.macro_f1(evaluation.label_metrics(outcomes(v), v.labels)), "macro_f1")


@query("confusable_pairs", sql("""SELECT c.gold, c.predicted, c.n FROM v_cell c JOIN v_lbl g ON g.label = c.gold JOIN v_lbl p ON p.label = c.predicted WHERE c.gold <> c.predicted ORDER BY c.n DESC, g.pos, p.pos LIMIT 10""", "v_cell"))
def _(v: Views) -> DataFrame:
    return evaluation.confusable_pairs(outcomes(v), v.labels)


WILSON = "greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) AS lo, least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) AS hi"


@query("wilson_by_label", sql(f"SELECT label, tp, support, round(lo, 9) AS lo, round(hi, 9) AS hi FROM (SELECT label, tp, support, {WILSON} FROM (SELECT label, tp, support, tp / support AS p, support::DOUBLE AS n FROM v_metric WHERE support > 0)) UNION ALL SELECT label, tp, support, NULL, NULL FROM v_metric WHERE support = 0", "v_metric"))
def _(v: Views) -> DataFrame:
    metrics = evaluation.label_metrics(outcomes(v), v.labels).withColumn("ci", stats.wilson(F.col("tp"), F.col("support")))
    return rounded(metrics.select("label", "tp", "support", "ci.lo", "ci.hi"), "lo", "hi")


@query("acceptance", sql(f"SELECT label, CASE WHEN lo IS NULL THEN 'undeterminable' WHEN lo >= 0.6 - 1e-9 THEN 'pass' WHEN hi < 0.6 - 1e-9 THEN 'fail' ELSE 'undeterminable' END AS verdict FROM (SELECT label, {WILSON} FROM (SELECT label, CASE WHEN support > 0 THEN tp / support END AS p, CASE WHEN support > 0 THEN support::DOUBLE END AS n FROM v_metric))", "v_metric"))
def _(v: Views) -> DataFrame:
    metrics = evaluation.label_metrics(outcomes(v), v.labels).withColumn("ci", stats.wilson(F.col("tp"), F.col("support")))
    return metrics.select("label", stats.accuracy_verdict(F.col("ci.lo"), F.col("ci.hi"), 0.6).alias("verdict"))


# --- comparisons -----------------------------------------------------------------------------------------------------

@query("majority_baseline", sql("SELECT r.label, count(*) AS n FROM v_rec r JOIN v_lbl l ON l.label = r.label GROUP BY r.label, l.pos ORDER BY n DESC, l.pos LIMIT 1", "v_rec", "v_lbl"))
def _(v: Views) -> DataFrame:
    return compare.majority_label(v.records, v.labels)


PAIRED = 'SELECT count(*) FILTER (candidate AND baseline) AS "both", count(*) FILTER (candidate AND NOT baseline) AS only_a, count(*) FILTER (NOT candidate AND baseline) AS only_b, count(*) FILTER (NOT candidate AND NOT baseline) AS neither, count(*) AS n FROM v_pair'


@query("paired_counts", sql(PAIRED, "v_pair"))
def _(v: Views) -> DataFrame:
    return compare.paired_counts(pairs(v))


@query("mcnemar", sql(f"""SELECT only_a, only_b, round(p, 9) AS p_value, CASE WHEN only_a > only_b AND p < 0.05 THEN 'better' ELSE 'not_better' END AS verdict FROM (SELECT only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 1 ELSE
    least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda k: exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))))) END AS p FROM ({PAIRED}))""", "v_pair"))  # fmt: skip
def _(v: Views) -> DataFrame:
    return rounded(compare.paired_test(compare.paired_counts(pairs(v))), "p_value").select("only_a", "only_b", "p_value", "verdict")


@query("regression_transitions", sql(f"""SELECT t AS transition, k AS n, round(p, 9) AS rate, round(lo, 9) AS lo, round(hi, 9) AS hi FROM (SELECT t, k, p, {WILSON} FROM (SELECT t, k, k / n AS p, n::DOUBLE AS n FROM (
    SELECT unnest(['kept', 'lost', 'gained', 'missed']) AS t, unnest(["both", only_b, only_a, neither]) AS k, n FROM ({PAIRED}))))""", "v_pair"))  # fmt: skip
def _(v: Views) -> DataFrame:
    joined = compare.regression(pairs(v).select("id", F.col("baseline").alias("correct")), pairs(v).select("id", F.col("candidate").alias("correct")))
    return rounded(compare.transitions(joined), "rate", "lo", "hi")


@query("holm_adjusted", sql("""SELECT pos, round(p_value, 9) AS p_value, round(max(least(1, (m - k + 1) * p_value)) OVER (ORDER BY k), 9) AS adjusted_p FROM (SELECT *, row_number() OVER (ORDER BY p_value, pos) AS k, count(*) OVER () AS m FROM (
    SELECT l.pos, (count(r.id) % 97 + 1) / 200.0 AS p_value FROM v_lbl l LEFT JOIN v_rec r ON r.label = l.label GROUP BY l.pos))""", "v_rec", "v_lbl"))  # fmt: skip
def _(v: Views) -> DataFrame:
    tests = quality.label_counts(v.records, v.labels).select("pos", ((F.col("n") % 97 + 1) / 200.0).alias("p_value"))
    return rounded(compare.holm(tests), "p_value", "adjusted_p")


@query("interval_overlap", sql(f"""SELECT a.i, b.i AS j FROM (SELECT i, {WILSON} FROM (SELECT pos AS i, tp / support AS p, support::DOUBLE AS n FROM v_metric WHERE support > 0)) a
    JOIN (SELECT i, {WILSON} FROM (SELECT pos AS i, tp / support AS p, support::DOUBLE AS n FROM v_metric WHERE support > 0)) b ON a.i < b.i AND (a.hi < b.lo - 1e-9 OR b.hi < a.lo - 1e-9)""", "v_metric"))  # fmt: skip
def _(v: Views) -> DataFrame:
    metrics = evaluation.label_metrics(outcomes(v), v.labels).where("support > 0")
    return compare.disjoint_intervals(metrics.select(F.col("pos").alias("i"), stats.wilson(F.col("tp"), F.col("support")).alias("ci")).select("i", "ci.lo", "ci.hi"))


@query("label_set_diff", sql("""SELECT 'removed' AS change, pos, label FROM v_lbl WHERE label NOT IN (SELECT label FROM v_rec) UNION ALL SELECT 'added', 9, 'src0'""", "v_rec", "v_lbl"))
def _(v: Views) -> DataFrame:
    current = v.labels.join(v.records.select("label").distinct(), "label").select("pos", "label").unionByName(v.spark.createDataFrame([(9, "src0")], "pos int, label string"))
    return compare.label_set_diff(v.labels, current)


@query("common_rows", sql("""SELECT n_common, n - n_common AS n_previous_only, n - n_common AS n_current_only FROM (SELECT count(*) FILTER (line % 5 > 0 OR label = 'en') AS n_common, count(*) AS n FROM v_rec)""", "v_rec"))
def _(v: Views) -> DataFrame:
    current = v.records.withColumn("label", F.when(F.col("line") % 5 == 0, "en").otherwise(F.col("label")))
    return compare.common_rows(v.records, current)


# --- calibration and abstention --------------------------------------------------------------------------------------

@query("softmax_top1", sql("SELECT id, top, round(conf, 9) AS conf FROM v_conf", "v_conf"))
def _(v: Views) -> DataFrame:
    return rounded(logits(v).select("id", F.col("top").alias("top"), calibration.confidence(F.lit(1.0)).alias("conf")), "conf")


@query("calibration_measures", sql("""SELECT round(sum(nll) / sum(n), 9) AS nll, round(sum(abs(conf - ok)) / sum(n), 9) AS ece FROM (SELECT len(list_filter(range(1, 15), lambda k: conf >= k / 15)) AS bin, count(*) AS n, sum(conf) AS conf, sum((top = gold_pos)::INT) AS ok, sum(nll) AS nll FROM v_conf GROUP BY 1)""", "v_conf"))
def _(v: Views) -> DataFrame:
    return rounded(calibration.measures(logits(v), 1.0), "nll", "ece")


@query("abstention_threshold", sql("SELECT round(conf, 9) AS tau FROM (SELECT conf, row_number() OVER (ORDER BY conf) - 1 AS k, count(*) OVER () AS n FROM v_conf) WHERE k = (n - 1) // 5", "v_conf"))
def _(v: Views) -> DataFrame:
    return rounded(calibration.threshold(logits(v).select(calibration.confidence(F.lit(1.0)).alias("conf"))), "tau")


@query("abstention_decisions", sql("SELECT CASE WHEN top = 3 THEN 'out_of_scope' WHEN conf >= 0.2 THEN 'adopt' ELSE 'abstain' END AS decision, count(*) AS n FROM v_conf GROUP BY 1", "v_conf"))
def _(v: Views) -> DataFrame:
    decision = calibration.decide(calibration.confidence(F.lit(1.0)), (F.col("top") - 1).cast("string"), F.lit(0.2), "2")
    return logits(v).groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query("coverage", sql("SELECT n, n - a AS answered, a AS abstained, round((n - a) / n, 9) AS coverage, 5 * (n - a) >= 4 * n AS meets_target FROM (SELECT count(*) AS n, count(*) FILTER (conf < 0.2) AS a FROM v_conf)", "v_conf"))
def _(v: Views) -> DataFrame:
    decision = calibration.decide(calibration.confidence(F.lit(1.0)), F.col("top").cast("string"), F.lit(0.2))
    return rounded(calibration.coverage(logits(v).select(decision.alias("decision"))), "coverage")


@query("temperature_calibration")
def _(v: Views) -> DataFrame:
    c = calibration.calibrate(logits(v))
    return v.spark.createDataFrame([(c.best_temperature, c.temperature, c.adopted, c.tau, c.nll_before, c.nll_after, c.ece_before, c.ece_after)], "best_temperature double, temperature double, adopted boolean, tau double, nll_before double, nll_after double, ece_before double, ece_after double")


# --- splits and features ---------------------------------------------------------------------------------------------

def _allocation_sql() -> str:
    return """SELECT label, n_groups, train, validation, n_groups - train - validation AS test FROM (SELECT label, n AS n_groups, val AS validation,
        CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 1 WHEN n - least(n * 8 // 10, n - val) - val < 1 THEN least(n * 8 // 10, n - val) - 1 ELSE least(n * 8 // 10, n - val) END AS train
        FROM (SELECT label, count(*) AS n, CASE WHEN count(*) <= 2 THEN 0 ELSE greatest(1, count(*) // 10) END AS val FROM (
        SELECT g, label FROM (SELECT g, label, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, label) AS k FROM (SELECT 'g' || line % 113 AS g, label FROM v_rec) GROUP BY g, label) WHERE k = 1) GROUP BY label))"""


def grouped(v: Views) -> DataFrame:
    return v.records.withColumn("group_id", F.concat(F.lit("g"), F.col("line") % 113))


@query("split_allocations", sql(_allocation_sql(), "v_rec"))
def _(v: Views) -> DataFrame:
    return split.allocations(split.split_groups(grouped(v), 42))


def _times(x: str, y: int) -> str:
    return f"((({x})::UHUGEINT * {y}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _mixed(x: str) -> str:
    """splitmix64's output for a state, in SQL."""
    one = f"xor({x}, ({x}) >> 30)"
    two = _times(one, 0xBF58476D1CE4E5B9)
    three = _times(f"xor({two}, ({two}) >> 27)", 0x94D049BB133111EB)
    return f"xor({three}, ({three}) >> 31)"


def _state(seed: str, k: str) -> str:
    return f"((({seed})::UHUGEINT + ({k})::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _split_sql(seed: int) -> str:
    """The seeded shuffle of each label's sorted groups as a recursion over swaps; labels have two letters here."""
    first = _times(f"xor({0xCBF29CE484222325}::UBIGINT, ascii(label[1])::UBIGINT)", 0x100000001B3)
    hashed = _times(f"xor({first}, ascii(label[2])::UBIGINT)", 0x100000001B3)
    return f"""WITH RECURSIVE v_rec AS (SELECT doc_id AS line, lang AS label FROM documents),
    m AS (SELECT g, label FROM (SELECT g, label, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, label) AS k FROM (SELECT 'g' || line % 113 AS g, label FROM v_rec) GROUP BY g, label) WHERE k = 1),
    h AS (SELECT label, list_sort(list(g)) AS l, xor({seed}::UBIGINT, {hashed}) AS mixed FROM m GROUP BY label),
    s AS (SELECT label, l, {_mixed(_state("mixed", "1"))} AS seed FROM h),
    f AS (SELECT label, l, len(l) - 1 AS i, 1 AS k, seed FROM s UNION ALL
        SELECT label, list_transform(range(1, len(l) + 1), lambda p: CASE WHEN p = i + 1 THEN l[j + 1] WHEN p = j + 1 THEN l[i + 1] ELSE l[p] END), i - 1, k + 1, seed
        FROM (SELECT *, ({_mixed(_state("seed", "k"))} % (i + 1)::UBIGINT)::BIGINT AS j FROM f WHERE i >= 1)),
    a AS (SELECT label, l, len(l) AS n, CASE WHEN len(l) <= 2 THEN 0 ELSE greatest(1, len(l) // 10) END AS val FROM f WHERE i <= 0),
    c AS (SELECT label, l, n, val, CASE WHEN n <= 2 THEN 1 WHEN n - least(n * 8 // 10, n - val) - val < 1 THEN least(n * 8 // 10, n - val) - 1 ELSE least(n * 8 // 10, n - val) END AS train FROM a)
    SELECT g AS group_id, label, CASE WHEN k <= train THEN 'train' WHEN k <= train + val THEN 'validation' ELSE 'test' END AS split FROM (SELECT label, train, val, unnest(l) AS g, unnest(range(1, n + 1)) AS k FROM c)"""


@query("group_split", _split_sql(42))
def _(v: Views) -> DataFrame:
    return split.split_groups(grouped(v), 42)


#: Pairs of bytes of whole texts, keyed as the operator keys byte ids (bytes plus one, base 257).
GRAMS = """WITH g AS (SELECT id, unnest(list_transform(range(0, len(h) // 2 - 1), lambda i: substr(h, (2 * i + 1)::INT, 4))) AS x FROM (SELECT CAST(doc_id AS VARCHAR) AS id, hex(encode(text)) AS h FROM documents)),
    t AS (SELECT id, x, count(*) AS tf FROM g GROUP BY id, x),
    v AS (SELECT x, ((('0x' || x[1:2])::INT + 1) * 257 + ('0x' || x[3:4])::INT + 1)::BIGINT AS key, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY x HAVING count(*) >= 2)"""


def byte_rows(v: Views) -> DataFrame:
    """Whole texts, which stand for their byte ids."""
    return v.records.select("id", F.col("input").alias("ids"))


@query("byte_ngram_df", GRAMS + " SELECT 2 AS n, key, df, round(idf, 4) AS idf FROM v")
def _(v: Views) -> DataFrame:
    vocab = features.vocabulary(features.document_frequencies(byte_rows(v), (2,)), v.records.count(), kind="double")
    return vocab.select("n", "key", "df", F.round("idf", 4).alias("idf"))


#: The features are single precision by default, so their equivalent gives each row's number of them and their largest.
@query("tfidf_features", GRAMS + """, w AS (SELECT id, (1 + ln(tf)) * idf AS x FROM t JOIN v USING (x)), k AS (SELECT id, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS val FROM w)
    SELECT id, count(*) AS n, round(max(val), 2) AS largest FROM k GROUP BY id""")
def _(v: Views) -> DataFrame:
    rows = byte_rows(v)
    found = features.tfidf_rows(rows, features.vocabulary(features.document_frequencies(rows, (2,)), v.records.count(), kind="double"))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.round(F.max("val"), 2).alias("largest"))


#: The whole vocabulary and features, orders 1 to 4; SQL has equivalents for pairs of bytes only (byte_ngram_df, tfidf_features).
@query("ngram_vocabulary")
def _(v: Views) -> DataFrame:
    return features.vocabulary(features.document_frequencies(byte_rows(v)), v.records.count())


@query("ngram_tfidf")
def _(v: Views) -> DataFrame:
    rows = byte_rows(v)
    return features.tfidf_rows(rows, features.vocabulary(features.document_frequencies(rows), v.records.count()))


@query("byte_ids", """SELECT id, len(b)::BIGINT AS n, sha256(array_to_string(b, ',')) AS sha256 FROM (SELECT id, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT + 1) AS b FROM (SELECT CAST(doc_id AS VARCHAR) AS id, hex(encode(text)) AS h FROM documents))""")
def _(v: Views) -> DataFrame:
    ids = text.byte_ids(1 << 30)(F.col("input"))
    return v.records.select("id", ids.alias("ids")).select("id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("sha256"))


# --- event logs ------------------------------------------------------------------------------------------------------

@query("duplicate_fold", """WITH e AS (SELECT event_id, event_type, user_id % 50 AS bucket, CASE WHEN event_id % 3 = 0 THEN event_id % 7 + 1 END AS copies FROM events),
    s AS (SELECT *, sum(CASE WHEN copies IS NULL THEN 1 ELSE -1 END) OVER (PARTITION BY event_type, bucket ORDER BY event_id) AS total FROM e),
    m AS (SELECT *, least(0, min(total) OVER (PARTITION BY event_type, bucket ORDER BY event_id)) AS low FROM s),
    d AS (SELECT *, coalesce(lag(total - low) OVER (PARTITION BY event_type, bucket ORDER BY event_id), 0) AS before FROM m)
    SELECT event_type, count(*) AS n, sum(CASE WHEN copies IS NULL THEN 1 WHEN before > 0 THEN copies ELSE 1 + copies END)::BIGINT AS occurrences, count(*) FILTER (copies IS NOT NULL AND before > 0) AS claimed FROM d GROUP BY event_type""")  # fmt: skip
def _(v: Views) -> DataFrame:
    rows = v.table("events").withColumn("bucket", F.col("user_id") % 50)
    folded = events.fold_duplicates(rows, ["event_type", "bucket"], ["event_id"], F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7 + 1))
    return folded.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("occurrences").alias("occurrences"), F.count_if("claimed").alias("claimed"))


@query("latency_p95", """SELECT event_type, n, place, x AS floor_hundredths FROM (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n,
    (95 * (count(*) OVER (PARTITION BY event_type) - 1)) // 100 AS place FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS x FROM events WHERE value IS NOT NULL)) WHERE k = place""")  # fmt: skip
def _(v: Views) -> DataFrame:
    rows = v.table("events").where("value is not null").select("event_type", F.round(F.col("value") * 100).cast("long").alias("x"))
    return stats.percentile_95_by(rows, "event_type", "x").select("event_type", "n", "place", F.col("floor_value").alias("floor_hundredths"))


# --- sources and reports over candidates -----------------------------------------------------------------------------

def raw_lines(v: Views) -> DataFrame:
    """The records as JSON lines, with faults by line number."""
    good = F.to_json(F.struct("id", F.lit("some text").alias("input"), F.struct(F.col("label").alias("intent")).alias("output"), "group_id"))
    n = F.col("line")
    raw = (
        F.when(n % 41 == 0, F.concat(F.lit("{"), good)).when(n % 43 == 0, F.lit("[1, 2]")).when(n % 47 == 0, F.lit('{"id":"0","id":"1","input":"x","output":{"intent":"en"}}'))
        .when(n % 53 == 0, F.lit('{"input":"","output":{"intent":"zz"},"tags":[1,"x",null]}')).when(n % 59 == 0, F.lit('{"id":"1","input":7,"output":"en","group_id":""}')).otherwise(good)
    )
    return v.records.select("line", raw.alias("raw"))


FAULTS = """WITH c AS (SELECT doc_id AS line, CASE WHEN doc_id % 41 = 0 THEN 41 WHEN doc_id % 43 = 0 THEN 43 WHEN doc_id % 47 = 0 THEN 47 WHEN doc_id % 53 = 0 THEN 53 WHEN doc_id % 59 = 0 THEN 59 END AS fault FROM documents),
    f(fault, field, code) AS (VALUES (41, '<record>', 'malformed_json'), (43, '<record>', 'malformed_record'), (47, '<record>', 'duplicate_key'), (53, 'id', 'missing_field'), (53, 'input', 'empty_value'),
    (53, 'output.intent', 'unknown_label'), (53, 'tags', 'type_mismatch'), (53, 'tags', 'type_mismatch'), (59, 'input', 'type_mismatch'), (59, 'output', 'type_mismatch'), (59, 'group_id', 'empty_value'), (59, 'id', 'duplicate_id'))"""


@query("inspection_anomalies", FAULTS + " SELECT c.line, f.field, f.code FROM c JOIN f ON f.fault = c.fault")
def _(v: Views) -> DataFrame:
    return jsonl.inspect(raw_lines(v), list(LABELS)).anomalies.select("line", "field", "code")


@query("inspection_records", FAULTS + " SELECT d.doc_id AS line, CAST(d.doc_id AS VARCHAR) AS id, d.lang AS label_id, d.source AS group_id FROM documents d JOIN c ON c.line = d.doc_id WHERE c.fault IS NULL")
def _(v: Views) -> DataFrame:
    return jsonl.inspect(raw_lines(v), list(LABELS)).records.select("line", "id", "label_id", "group_id")


@query("input_digests", "SELECT doc_id AS ordinal, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM documents")
def _(v: Views) -> DataFrame:
    return inference.input_digests(v.records.withColumnRenamed("line", "ordinal")).withColumn("n_bytes", F.col("n_bytes").cast("long"))


@query("contract_times", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events")
def _(v: Views) -> DataFrame:
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text_ = F.when(F.col("event_id") % 3 == 0, F.concat(written, F.lit("+09:00"))).when(F.col("event_id") % 3 == 1, F.concat(written, F.lit("Z"))).otherwise(F.concat(written, F.lit("+00:00")))
    return v.table("events").select("event_id", F.floor(times.rfc3339_utc(text_).cast("double")).cast("long").alias("seconds"))


@query("score_report", sql(f"""SELECT candidate, n, n_correct, round(accuracy, 9) AS accuracy, round(lo, 9) AS lo, round(hi, 9) AS hi, only_a, only_b FROM (SELECT candidate, k AS n_correct, n::BIGINT AS n, p AS accuracy, {WILSON}, only_a, only_b FROM (
    SELECT 'now' AS candidate, count(*) FILTER (candidate) AS k, count(*)::DOUBLE AS n, count(*) FILTER (candidate) / count(*) AS p, count(*) FILTER (candidate AND NOT baseline) AS only_a, count(*) FILTER (NOT candidate AND baseline) AS only_b FROM v_pair
    UNION ALL SELECT 'before', count(*) FILTER (baseline), count(*)::DOUBLE, count(*) FILTER (baseline) / count(*), NULL, NULL FROM v_pair))""", "v_pair"))  # fmt: skip
def _(v: Views) -> DataFrame:
    both = v.predictions.withColumn("candidate", F.lit("now")).unionByName(v.previous.withColumn("candidate", F.lit("before")))
    report = selection.report(selection.candidate_outcomes(v.records, both, v.labels), "before")
    return rounded(report, "accuracy", "lo", "hi").select("candidate", "n", "n_correct", "accuracy", "lo", "hi", "only_a", "only_b")


@query("id_set_difference", sql("SELECT coalesce(r.id, p.id) AS id, (r.id IS NOT NULL)::BIGINT AS expected, (p.id IS NOT NULL)::BIGINT AS found FROM v_rec r FULL JOIN v_pred p ON p.id = r.id WHERE r.id IS NULL OR p.id IS NULL", "v_rec", "v_pred"))
def _(v: Views) -> DataFrame:
    return selection.set_difference(v.records, v.predictions)


@query("mistakes", sql("SELECT o.id, o.gold, o.kind, o.label, length(r.input) AS n_chars FROM v_out o JOIN v_rec r ON r.id = o.id WHERE NOT coalesce(o.kind = 'label' AND o.label = o.gold, FALSE)", "v_out"))
def _(v: Views) -> DataFrame:
    found = selection.mistakes(evaluation.correct(outcomes(v)), v.records)
    return found.select("id", "gold", "kind", "label", F.length("input").cast("long").alias("n_chars"))


@query("top_scores", f"""SELECT id, place, label, round(score, 9) AS score FROM (SELECT id, label, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS place FROM (
    SELECT vec_id AS id, unnest(range({CLASSES})) AS pos, CAST(unnest(range({CLASSES})) AS VARCHAR) AS label, unnest(list_transform(embedding, lambda x: x::DOUBLE * {SPREAD})) AS score FROM embeddings)) WHERE place <= 3""")  # fmt: skip
def _(v: Views) -> DataFrame:
    named = F.transform("logits", lambda x, i: F.struct(i.cast("string").alias("id"), x.alias("score")))
    return rounded(selection.top_scores(v.logits.select("id", named.alias("scores"))).withColumn("place", F.col("place").cast("long")), "score")


@query("capacity", "SELECT lang AS component, count(*) AS n_files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def _(v: Views) -> DataFrame:
    return selection.capacity(v.records.select(F.col("label").alias("component"), F.col("id").alias("path"), F.octet_length("input").cast("long").alias("length")))


@query("byte_model_scores")
def _(v: Views) -> DataFrame:
    rng = np.random.default_rng(0)
    model = inference.ConvolutionModel(list(LABELS), rng.normal(size=(257, 8)), [(rng.normal(size=(8, 8, 3)), rng.normal(size=8))], rng.normal(size=(8, 5)), rng.normal(size=5))
    return inference.judged(inference.infer(v.records, model, lambda t: inference.bytes_of(t, 1 << 30)), list(LABELS), tau=0.5)


from . import contracts  # noqa: E402, F401  registers the others
