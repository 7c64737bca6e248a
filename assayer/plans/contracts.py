"""Further registered queries: digests and manifests, sides of an evaluation, answers in inputs, choices, events, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates, digests, jsontools, stats, text
from ..operators import calibration, choices, compare, events, quality, records, selection, split
from ..sources import jsonl, requests, sides
from .registry import LABELS, WILSON, logits, outcomes, query, raw_lines, rounded
from .views import CLASSES, Views, sql


def _digest_sql(rows: str, *columns: str, by: str = "") -> str:
    """The digest of rows, in SQL; by is a column or nothing."""
    row = " || ".join(f"coalesce(sha256(CAST({c} AS VARCHAR)), '-')" for c in columns)
    key, comma = (f"{by}, ", by and f"{by}, ") if by else ("", "")
    return f"""SELECT {key}CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(head || ':' || part, ',' ORDER BY head)) AS digest FROM (
        SELECT {key}head, sum(n) AS n, sha256(string_agg(r || ':' || n, ',' ORDER BY r || ':' || n)) AS part FROM (SELECT {key}r, r[1:4] AS head, count(*) AS n FROM (SELECT {key}sha256({row}) AS r FROM ({rows})) GROUP BY ALL) GROUP BY {comma}head) {f'GROUP BY {by}' if by else ''}"""


# --- digests and manifests -------------------------------------------------------------------------------------------

@query("content_digest", sql(_digest_sql("SELECT * FROM v_rec", "id", "input", "label"), "v_rec"))
def _(v: Views) -> DataFrame:
    return digests.rows_digest(v.records, ["id", "input", "label"])


_MANIFEST_ROWS = "SELECT id, input, label, group_id, part AS split FROM v_part"


@query(
    "split_manifest",
    sql(f"""SELECT c.split, c.n, g.n_groups, i.digest AS ids, c.digest AS content FROM ({_digest_sql(_MANIFEST_ROWS, "id", "input", "label", by="split")}) c
    JOIN ({_digest_sql(_MANIFEST_ROWS, "id", by="split")}) i ON i.split = c.split JOIN (SELECT split, count(DISTINCT group_id) AS n_groups FROM ({_MANIFEST_ROWS}) GROUP BY split) g ON g.split = c.split""", "v_part"),
)
def _(v: Views) -> DataFrame:
    return split.manifest(v.parts.withColumnRenamed("part", "split"))


@query("batch_summary", sql(f"""SELECT n AS "count", digest FROM ({_digest_sql("SELECT '{{\"id\":\"' || id || '\",\"label\":\"' || label || '\"}}' AS value FROM v_rec".replace("{{", "{").replace("}}", "}"), "value")})""", "v_rec"))
def _(v: Views) -> DataFrame:
    return requests.summary(requests.json_lines(v.records, ["id", "label"]))


@query("salted_digests", "SELECT doc_id AS line, sha256('salt' || text)[1:12] AS digest FROM documents")
def _(v: Views) -> DataFrame:
    return v.records.select("line", jsontools.salted_digest("salt", F.col("input")).alias("digest"))


@query("canonical_records", """SELECT doc_id AS line, sha256('{"id":"' || doc_id || '","label":"' || lang || '","line":' || doc_id || ',"nested":{"a":[1,2],"b":null}}') AS sha256 FROM documents""")
def _(v: Views) -> DataFrame:
    raw = F.concat(F.lit('{"nested": {"b": null, "a": [1, 2]}, "line": '), F.col("line"), F.lit(', "label": "'), F.col("label"), F.lit('", "id": "'), F.col("id"), F.lit('"}'))
    return v.records.select("line", F.sha2(jsontools.canonical_text(raw), 256).alias("sha256"))


@query("json_types", """SELECT doc_id AS line, CASE doc_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN 'bool' WHEN 2 THEN 'number' WHEN 3 THEN 'string' WHEN 4 THEN 'array' WHEN 5 THEN 'object' END AS kind FROM documents""")
def _(v: Views) -> DataFrame:
    value = F.element_at(F.array(*[F.lit(x) for x in ('{"a":null}', '{"a":true}', '{"a":1.5}', '{"a":"x"}', '{"a":[1]}', '{"a":{"b":1}}', "{}")]), (F.col("line") % 7 + 1).cast("int"))
    return v.records.select("line", jsontools.type_name(F.try_parse_json(value), "$.a").alias("kind"))


# --- sources ---------------------------------------------------------------------------------------------------------

@query(
    "inspection_files",
    """WITH l AS (SELECT doc_id, 'f' || doc_id % 3 AS file, doc_id // 3 + 1 AS line, CASE WHEN doc_id % 5 = 0 THEN 'shared' || doc_id // 20 ELSE CAST(doc_id AS VARCHAR) END AS id, doc_id % 11 > 0 AS fine FROM documents),
    o AS (SELECT id, min((file, line)) AS owner FROM l WHERE fine GROUP BY id)
    SELECT l.file, l.line, o.owner[1] AS first_file, o.owner[2] AS first_line FROM l JOIN o ON o.id = l.id WHERE (l.file, l.line) > o.owner""",
)
def _(v: Views) -> DataFrame:
    id_ = F.expr("if(line % 5 = 0, concat('shared', line div 20), id)")
    raw = F.to_json(F.struct(id_.alias("id"), F.lit("text").alias("input"), F.struct(F.when(F.col("line") % 11 > 0, F.col("label")).otherwise("zz").alias("intent")).alias("output")))
    rows = v.records.select(F.concat(F.lit("f"), F.col("line") % 3).alias("file"), F.expr("line div 3 + 1").alias("line"), raw.alias("raw"))
    return jsonl.inspect(rows, list(LABELS)).anomalies.where("code = 'duplicate_id'").select("file", "line", "first_file", "first_line")


@query("anomaly_report", """WITH c AS (SELECT doc_id AS line, CASE WHEN doc_id % 41 = 0 THEN 41 WHEN doc_id % 43 = 0 THEN 43 WHEN doc_id % 47 = 0 THEN 47 WHEN doc_id % 53 = 0 THEN 53 WHEN doc_id % 59 = 0 THEN 59 END AS fault FROM documents),
    f(fault, place) AS (VALUES (41, 1), (43, 1), (47, 1), (53, 2), (53, 3), (53, 5), (53, 6), (53, 6), (59, 3), (59, 4), (59, 7), (59, 2)) SELECT c.line, f.place FROM c JOIN f ON f.fault = c.fault""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return jsonl.in_report_order(jsonl.inspect(raw_lines(v), list(LABELS)).anomalies).select("line", "place")


@query("gold_side", """SELECT doc_id AS line, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 > 0 AND doc_id % 11 > 0 AND doc_id % 13 > 0 THEN lang END AS label,
    CASE WHEN doc_id % 7 = 0 THEN 'missing_gold' WHEN doc_id % 11 = 0 THEN 'malformed_gold' WHEN doc_id % 13 = 0 THEN 'unknown_gold_label' END AS code FROM documents""")  # fmt: skip
def _(v: Views) -> DataFrame:
    n = F.col("line")
    rest = F.when(n % 7 == 0, F.lit("")).when(n % 11 == 0, F.lit(',"label":7')).when(n % 13 == 0, F.lit(',"label":"zz"')).when(n % 2 == 0, F.concat(F.lit(',"output":{"intent":"'), F.col("label"), F.lit('"}'))).otherwise(F.concat(F.lit(',"label":"'), F.col("label"), F.lit('"')))
    rows = v.records.select("line", F.concat(F.lit('{"id":"'), F.col("id"), F.lit('"'), rest, F.lit("}")).alias("raw"))
    return sides.gold(rows, list(LABELS)).select("line", "id", "label", "code")


@query("prediction_side", """SELECT doc_id AS line, CASE WHEN doc_id % 5 < 2 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 >= 2 AND doc_id % 7 > 0 THEN lang END AS predicted_label, CASE WHEN doc_id % 5 < 2 THEN 'invalid_score' END AS reason FROM documents""")
def _(v: Views) -> DataFrame:
    n = F.col("line")
    scores = F.when(n % 5 == 0, F.lit('{"en":NaN,"fr":1.0}')).when(n % 5 == 1, F.lit('{"en":0.5,"fr":0.6}')).when(n % 5 == 2, F.lit("null")).otherwise(F.lit('{"en":0.25,"fr":0.75}'))
    label = F.when(n % 7 == 0, F.lit("3")).otherwise(F.concat(F.lit('"'), F.col("label"), F.lit('"')))
    raw = F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","status":"ok","predicted_label":'), label, F.lit(',"scores":'), scores, F.lit("}"))
    return sides.predictions(v.records.select("line", raw.alias("raw"))).select("line", "status", "predicted_label", "reason")


@query("judge_requests", """SELECT doc_id AS line, CASE WHEN e IS NULL THEN CAST(doc_id AS VARCHAR) END AS id, CASE WHEN e IS NULL THEN 'x' END AS input, e AS error FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown_field' WHEN doc_id % 7 = 0 THEN 'missing_field'
    WHEN doc_id % 11 = 0 THEN 'type_mismatch' WHEN doc_id % 13 = 0 THEN 'empty_id' WHEN doc_id % 17 = 0 THEN 'malformed_record' WHEN doc_id % 19 = 0 THEN 'id_too_long' END AS e FROM documents)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    n, good = F.col("line"), F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","input":"x"'))
    raw = (
        F.when(n % 5 == 0, F.concat(good, F.lit(',"more":1}'))).when(n % 7 == 0, F.lit('{"id":"a"}')).when(n % 11 == 0, F.lit('{"id":"a","input":[]}')).when(n % 13 == 0, F.lit('{"id":"","input":"x"}'))
        .when(n % 17 == 0, F.lit('["a"]')).when(n % 19 == 0, F.concat(F.lit('{"id":"'), F.repeat(F.lit("é"), F.lit(600)), F.lit('","input":"x"}'))).otherwise(F.concat(good, F.lit("}")))
    )
    return requests.parse(v.records.select("line", raw.alias("raw")))


@query("training_examples", """SELECT doc_id AS line, CASE WHEN e IS NULL THEN 'some text' END AS input, CASE WHEN e IS NULL THEN lang END AS label, e AS error FROM (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'fields' WHEN doc_id % 7 = 0 THEN 'type_mismatch'
    WHEN doc_id % 11 = 0 THEN 'empty_value' WHEN doc_id % 13 = 0 THEN 'unknown_label' END AS e FROM documents)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    n = F.col("line")
    raw = (
        F.when(n % 5 == 0, F.lit('{"input":"x","label":"en","more":1}')).when(n % 7 == 0, F.lit('{"input":"x","label":1}')).when(n % 11 == 0, F.lit('{"input":" \\t","label":"en"}'))
        .when(n % 13 == 0, F.lit('{"input":"x","label":"zz"}')).otherwise(F.to_json(F.struct(F.lit("some text").alias("input"), "label")))
    )
    return jsonl.examples(v.records.select("line", raw.alias("raw")), list(LABELS))


@query("prediction_lines", sql("""SELECT '{"id":"' || id || '","status":"' || CASE kind WHEN 'invalid' THEN 'ok' WHEN 'label' THEN 'ok' ELSE kind END || '","predicted_label":' || CASE WHEN kind = 'label' THEN '"' || label || '"' ELSE 'null' END || '}' AS value FROM v_out""", "v_out"))
def _(v: Views) -> DataFrame:
    return requests.prediction_lines(outcomes(v), "id")


@query("gold_lines", sql("""SELECT '{"id":"' || id || '","label":"' || label || '"}' AS value FROM v_rec""", "v_rec"))
def _(v: Views) -> DataFrame:
    return requests.json_lines(v.records, ["id", "label"], "line")


# --- contract checks -------------------------------------------------------------------------------------------------

@query("answer_leaks", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 < 4 AND doc_id % 3 = 0 THEN 'label,answer' WHEN doc_id % 3 = 0 THEN 'label' ELSE 'answer' END AS reasons FROM documents WHERE doc_id % 7 < 4 OR doc_id % 3 = 0""")
def _(v: Views) -> DataFrame:
    n, d = F.col("line"), F.concat(F.lit("d"), F.col("line"))
    # the answer as it is, spaced, in sorted order, its arguments alone; and two that are not quite it
    wrote = [F.concat(F.lit('{"intent":"'), d, F.lit('","arguments":{"b":1,"a":2}}')), F.concat(F.lit('{"intent": "'), d, F.lit('", "arguments": {"b": 1, "a": 2}}')), F.concat(F.lit('{"arguments":{"a":2,"b":1},"intent":"'), d, F.lit('"}')), F.lit('see {"a": 2, "b": 1}'), F.lit('{"a" : 2}'), F.lit('{"intent":"other"}'), F.lit("")]
    said = F.concat(F.lit("text "), F.element_at(F.array(*wrote), (n % 7 + 1).cast("int")), F.when(n % 3 == 0, F.concat(F.lit(" label"), n)).otherwise(F.lit("")))
    rows = v.records.select("id", "line", said.alias("input"))
    answers = jsontools.answer_needles(F.concat(F.lit('{"intent":"'), d, F.lit('","arguments":{"b":1,"a":2}}')))
    found = quality.metadata_mixed(rows, {"label": F.concat(F.lit("label"), n)}, answers=answers)
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query("regression_missing", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 AND doc_id % 11 = 0 THEN 'missing_previous' WHEN doc_id % 7 = 0 THEN 'missing_previous' WHEN doc_id % 11 = 0 THEN 'missing_current' ELSE 'repeated' END AS problem FROM documents
    WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0) AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    rows = v.records.select("id", "line", F.lit(True).alias("correct"))
    twice = rows.unionByName(rows.where("line % 13 = 0"))
    return compare.incomplete(rows.where("line % 7 > 0"), twice.where("line % 11 > 0"))


@query("candidate_repeats", sql("SELECT label || line % 50 AS candidate, count(*) AS n FROM v_rec GROUP BY 1 HAVING count(*) > 1", "v_rec"))
def _(v: Views) -> DataFrame:
    return records.repeated(v.records.select(F.concat("label", F.col("line") % 50).alias("candidate")))


@query("normalised_texts", r"""SELECT doc_id AS line, sha256(trim(regexp_replace(nfc_normalize(text), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')) AS sha256,
    NOT regexp_matches(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') AS is_empty FROM documents""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return v.records.select("line", F.sha2(text.normalised("input"), 256).alias("sha256"), text.is_empty_after_normalising(F.col("input")).alias("is_empty"))


@query("pre_tokens", r"SELECT doc_id AS line, length(regexp_replace(text, '\PN', '', 'g')) AS n_digits, TRUE AS whole FROM documents")
def _(v: Views) -> DataFrame:
    tokens = v.records.select("line", "input", text.pre_tokens(F.col("input")).alias("t"))
    return tokens.select("line", F.size(F.filter("t", lambda x: x.rlike(r"^\p{N}$"))).cast("long").alias("n_digits"), (F.array_join("t", "") == F.col("input")).alias("whole"))


@query("packed_ngrams", """SELECT id, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS largest FROM (SELECT id, unnest(list_transform(range(0, len(h) // 2 - 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 6))::BIGINT)) AS k FROM (SELECT CAST(doc_id AS VARCHAR) AS id, hex(encode(text)) AS h FROM documents)) GROUP BY id""")
def _(v: Views) -> DataFrame:
    ids = v.records.select("id", text.byte_ids(1 << 30)(F.col("input")).alias("ids"))
    return ids.select("id", F.explode(text.packed_ngrams(F.col("ids"), 3)).alias("k")).groupBy("id").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


@query("percent_shares", sql("SELECT label, printf('%.1f%%', 100 * n / (SELECT count(*) FROM v_rec)) AS share FROM (SELECT label, count(*) AS n FROM v_rec GROUP BY label)", "v_rec"))
def _(v: Views) -> DataFrame:
    counts = v.records.groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(v.records.agg(F.count("*").alias("total")))).select("label", stats.percent(F.col("n") / F.col("total")).alias("share"))


# --- abstention and choices ------------------------------------------------------------------------------------------

@query("abstention_comparison", sql("""SELECT k AS abstention, n, n_correct, n_abstain, round(n_correct / n, 9) AS accuracy, CASE WHEN n > n_abstain THEN round(n_correct / (n - n_abstain), 9) END AS adopted_accuracy, round((n - n_abstain) / n, 9) AS coverage FROM (
    SELECT 'without' AS k, count(*) AS n, count(*) FILTER (ok) AS n_correct, 0::BIGINT AS n_abstain FROM (SELECT top = gold_pos AS ok FROM v_d)
    UNION ALL SELECT 'with', count(*), count(*) FILTER (ok AND NOT a), count(*) FILTER (a) FROM (SELECT top = gold_pos AS ok, top <> 3 AND 1 / list_sum(list_transform(d, lambda x: exp(0.5 * x))) < 0.13 AS a FROM v_d))""", "v_d"))  # fmt: skip
def _(v: Views) -> DataFrame:
    found = calibration.compare_abstention(logits(v), [str(i) for i in range(CLASSES)], 2.0, 0.13, "2")
    return rounded(found, "accuracy", "adopted_accuracy", "coverage")


def _scored(v: Views) -> DataFrame:
    return choices.mapped(v.logits.select(F.col("id").cast("string").alias("id"), F.col("logits").alias("loglik")), [str(i) for i in range(CLASSES - 1)], [str(i) for i in range(CLASSES)])


@query("choice_posteriors", sql(f"SELECT CAST(id AS VARCHAR) AS id, CASE WHEN top < {CLASSES} THEN 'mapped' ELSE 'no_choice_match' END AS outcome, CASE WHEN top < {CLASSES} THEN CAST(top - 1 AS VARCHAR) END AS label, CASE WHEN top < {CLASSES} THEN round(conf, 9) END AS posterior FROM v_conf", "v_conf"))
def _(v: Views) -> DataFrame:
    return rounded(_scored(v), "posterior")


@query("choice_tally", sql(f"SELECT count(*) FILTER (top < {CLASSES}) AS mapped, count(*) FILTER (top = {CLASSES}) AS no_choice_match, 0::BIGINT AS invalid_score FROM v_conf", "v_conf"))
def _(v: Views) -> DataFrame:
    return choices.tally(_scored(v))


@query("prediction_parity", sql("SELECT count(*) AS n, count(*) FILTER (r.label IS DISTINCT FROM p.predicted_label) AS mismatches FROM v_rec r LEFT JOIN v_pred p ON p.id = r.id", "v_rec", "v_pred"))
def _(v: Views) -> DataFrame:
    return choices.parity(v.predictions, v.records)


@query("resolved_choices", "SELECT doc_id AS line, CASE WHEN doc_id % 3 = 0 THEN lang END AS label FROM documents")
def _(v: Views) -> DataFrame:
    wrote = F.when(F.col("line") % 3 == 0, F.col("label").cast("binary")).when(F.col("line") % 3 == 1, F.concat(F.col("label").cast("binary"), F.lit(bytearray(b" ")))).otherwise(F.lit(bytearray(b"\xff\xfe")))
    return v.records.select("line", choices.resolve(wrote, list(LABELS)).alias("label"))


@query("package_eligibility", "SELECT doc_id AS line, CASE WHEN doc_id % 3 = 0 THEN 'unsupported_ops' WHEN doc_id % 5 = 0 THEN 'prediction_mismatch' WHEN doc_id % 2 = 0 AND strlen(text) * 20000 > 40000000 THEN 'vocabulary_over_guideline' END AS reason, CASE WHEN doc_id % 3 = 0 THEN 'Loop' ELSE '' END AS unknown FROM documents")
def _(v: Views) -> DataFrame:
    n = F.col("line")
    rows = v.records.select("line", (F.octet_length("input").cast("long") * 20_000).alias("bytes"), (n % 2 == 0).alias("has_vocabulary"), F.when(n % 3 == 0, F.array(F.lit("MatMul"), F.lit("Loop"))).otherwise(F.array(F.lit("MatMul"))).alias("ops"), F.when(n % 5 == 0, 1).otherwise(0).alias("mismatches"))
    return selection.eligible(rows, ["MatMul", "Add"]).select("line", "reason", F.array_join("unknown_ops", ",").alias("unknown"))


@query("best_candidate", sql("SELECT CASE WHEN a >= b THEN 'now' ELSE 'before' END AS candidate, greatest(a, b) AS n_correct, n FROM (SELECT count(*) FILTER (candidate) AS a, count(*) FILTER (baseline) AS b, count(*) AS n FROM v_pair)", "v_pair"))
def _(v: Views) -> DataFrame:
    both = v.predictions.withColumn("candidate", F.lit("now")).unionByName(v.previous.withColumn("candidate", F.lit("before")))
    totals = selection.candidate_outcomes(v.records, both, v.labels).groupBy("candidate").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    best = selection.select_best(totals, ["now", "before"])
    return v.spark.createDataFrame([(best.candidate, best.n_correct, best.n)], "candidate string, n_correct long, n long")


@query("score_report_tests", sql("""SELECT 'now' AS candidate, round(p, 9) AS p_value, round(p, 9) AS adjusted_p, CASE WHEN only_a > only_b AND p < 0.05 THEN 'better' ELSE 'not_better' END AS verdict FROM (SELECT only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 1 ELSE
    least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda k: exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))))) END AS p
    FROM (SELECT count(*) FILTER (candidate AND NOT baseline) AS only_a, count(*) FILTER (NOT candidate AND baseline) AS only_b FROM v_pair)) UNION ALL SELECT 'before', NULL, NULL, NULL""", "v_pair"))  # fmt: skip
def _(v: Views) -> DataFrame:
    both = v.predictions.withColumn("candidate", F.lit("now")).unionByName(v.previous.withColumn("candidate", F.lit("before")))
    report = selection.report(selection.candidate_outcomes(v.records, both, v.labels), "before")
    return rounded(report, "p_value", "adjusted_p").select("candidate", "p_value", "adjusted_p", "verdict")


@query("even_batches", "SELECT item_id, (row_number() OVER (ORDER BY length(text), item_id) - 1) // 32 AS batch FROM benchmark")
def _(v: Views) -> DataFrame:
    return selection.even_batches(v.table("benchmark"), F.length("text"), 32, "item_id").select("item_id", "batch")


# --- event logs ------------------------------------------------------------------------------------------------------

@query("window_events", "SELECT event_id, ts BETWEEN (SELECT min(ts) FROM events) + INTERVAL 3598 SECOND AND (SELECT min(ts) FROM events) + INTERVAL 7205 SECOND AS inside FROM events")
def _(v: Views) -> DataFrame:
    rows = v.table("events")
    first = rows.agg(F.min("ts").alias("first"))
    start, end = F.col("first") + F.expr("INTERVAL 1 HOUR"), F.col("first") + F.expr("INTERVAL 2 HOUR")
    return rows.crossJoin(F.broadcast(first)).select("event_id", events.within(rows, "ts", start, end).alias("inside"))


@query("attributed_events", "SELECT CASE WHEN event_id % 10 = 0 THEN 'positive_control' WHEN user_id IN (1, 2, 3, 5, 8) THEN 'tool' ELSE 'unattributed' END AS attribution, count(*) AS n FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    return events.attribute(v.table("events"), "user_id", [1, 2, 3, 5, 8], F.col("event_id") % 10 == 0).groupBy("attribution").agg(F.count("*").alias("n"))


@query("kept_events", "SELECT event_id, (SELECT count(*) FROM events) > 500 AS truncated FROM events ORDER BY event_id LIMIT 500")
def _(v: Views) -> DataFrame:
    return events.kept(v.table("events"), ["event_id"], 500).select("event_id", "truncated")


_P95 = """SELECT event_type, list_sort(list(CAST(round(value * 100) AS BIGINT))) AS xs, count(*) AS n, (95 * (count(*) - 1)) // 100 AS place, (95 * (count(*) - 1)) % 100 AS rest FROM events WHERE value IS NOT NULL GROUP BY event_type"""


@query("latency_p95_interpolated", f"""SELECT event_type, n, place, floor_value, total // 100 AS whole, total % 100 AS hundredths, xs[(95 * n + 99) // 100] AS nearest FROM (
    SELECT *, xs[place + 1] AS floor_value, 100 * xs[place + 1] + CASE WHEN rest = 0 THEN 0 ELSE rest * (xs[place + 2] - xs[place + 1]) END AS total FROM ({_P95}))""")  # fmt: skip
def _(v: Views) -> DataFrame:
    rows = v.table("events").where("value is not null").select("event_type", F.round(F.col("value") * 100).cast("long").alias("x"))
    return stats.percentile_95_by(rows, "event_type", "x")


# --- statistics ------------------------------------------------------------------------------------------------------

#: The normal quantiles at 0.975 and 0.8.
_Z975, _Z80 = 1.959963984540054, 0.8416212335729143


@query("sample_sizes", f"""SELECT p_b, p_c, round(({_Z975} * sqrt(p_b + p_c) + {_Z80} * sqrt(p_b + p_c - (p_b - p_c) * (p_b - p_c))) ** 2 / ((p_b - p_c) * (p_b - p_c)), 6) AS estimate, round({_Z975}::DOUBLE, 9) AS z
    FROM (VALUES (0.3::DOUBLE, 0.1::DOUBLE), (0.2, 0.1), (0.4, 0.05), (0.12, 0.08)) t(p_b, p_c)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    rows = [(b, c, round(stats.sample_size_estimate(b, c), 6), round(stats.normal_quantile(0.975), 9)) for b, c in ((0.3, 0.1), (0.2, 0.1), (0.4, 0.05), (0.12, 0.08))]
    return v.spark.createDataFrame(rows, "p_b double, p_c double, estimate double, z double")


def _power_sql(most: int, theta: str) -> str:
    """cond(n, power): the exact test's power by the number of discordant pairs, 0 to most."""
    return f"""k AS (SELECT n, unnest(range(0, n // 2 + 1)) AS k FROM range(1, {most + 1}) r(n)), t AS (SELECT n, k, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) AS lc FROM k),
    c AS (SELECT *, sum(exp(lc - n * ln(2))) OVER (PARTITION BY n ORDER BY k) AS tail FROM t),
    cond AS (SELECT n, least(1, sum(CASE WHEN tail < 0.025 THEN exp(lc + k * ln({theta}) + (n - k) * ln(1 - {theta})) + CASE WHEN 2 * k <> n THEN exp(lc + (n - k) * ln({theta}) + k * ln(1 - {theta})) ELSE 0 END ELSE 0 END)) AS power FROM c GROUP BY n)"""


@query("exact_power", f"WITH {_power_sql(200, '0.7')} SELECT n, round(power, 8) AS power FROM cond WHERE n IN (3, 5, 10, 21, 50, 100, 200)")
def _(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(n, round(stats.conditional_power(n, 0.7), 8)) for n in (3, 5, 10, 21, 50, 100, 200)], "n long, power double")


def _total_sql(totals: str, p_b: float, p_c: float, most: int) -> str:
    return f"""WITH {_power_sql(most, f'({p_b} / {p_b + p_c:g})')}, power AS (SELECT t.total, sum(exp(lgamma(t.total + 1) - lgamma(c.n + 1) - lgamma(t.total - c.n + 1) + c.n * ln({p_b + p_c:g}) + (t.total - c.n) * ln(1 - {p_b + p_c:g})) * c.power) AS power
    FROM ({totals}) t(total) JOIN cond c ON c.n <= t.total GROUP BY t.total)"""


@query("total_power", _total_sql("VALUES (40), (80), (160)", 0.2, 0.1, 160) + " SELECT total, round(power, 8) AS power FROM power")
def _(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(n, round(stats.power_of(n, 0.2, 0.1), 8)) for n in (40, 80, 160)], "total long, power double")


@query("required_size", _total_sql("SELECT unnest(range(42, 90))", 0.4, 0.1, 89) + " SELECT min(total) AS rows_needed FROM power WHERE power >= 0.8")
def _(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(stats.required_sample_size(0.4, 0.1),)], "rows_needed long")


@query("accuracy_interval_table", f"SELECT k, round(lo, 9) AS lo, round(hi, 9) AS hi FROM (SELECT k, {WILSON} FROM (SELECT k, k / 40 AS p, 40::DOUBLE AS n FROM range(0, 41) r(k)))")
def _(v: Views) -> DataFrame:
    rows = v.spark.range(41).select(F.col("id").alias("k"), stats.wilson(F.col("id"), F.lit(40)).alias("ci"))
    return rounded(rows.select("k", "ci.lo", "ci.hi"), "lo", "hi")


@query("measures_by_group", sql("""SELECT * FROM (WITH o AS (SELECT r.group_id, o.gold, CASE WHEN o.kind = 'label' THEN o.label END AS said, o.id FROM v_out o JOIN v_rec r ON r.id = o.id),
    f AS (SELECT group_id, avg(f1) AS f1 FROM (SELECT o.group_id, l.label, CASE WHEN count(*) FILTER (gold = l.label) + count(*) FILTER (said = l.label) > 0 THEN 2 * count(*) FILTER (gold = l.label AND said = l.label) / (count(*) FILTER (gold = l.label) + count(*) FILTER (said = l.label)) END AS f1 FROM o CROSS JOIN v_lbl l GROUP BY 1, 2) GROUP BY group_id)
    SELECT o.group_id, round(count(*) FILTER (gold = said) / count(*), 9) AS accuracy, round(any_value(f.f1), 9) AS macro_f1 FROM o JOIN f ON f.group_id IS NOT DISTINCT FROM o.group_id GROUP BY o.group_id)""", "v_out"))  # fmt: skip
def _(v: Views) -> DataFrame:
    rows = outcomes(v).join(v.records.select("id", "group_id"), "id").withColumn("said", F.when(F.col("kind") == "label", F.col("label")))
    gold, said = F.col("gold"), F.col("said")
    return rounded(rows.groupBy("group_id").agg(aggregates.accuracy(gold, said).alias("accuracy"), aggregates.macro_f1(gold, said, LABELS).alias("macro_f1")), "accuracy", "macro_f1")


@query("calibration_by_label", sql("""SELECT gold, round(sum(abs(gap)) / sum(n), 9) AS ece, round(sum(nll) / sum(n), 9) AS nll FROM (SELECT gold, least(CAST(floor(conf * 15) AS INT), 14) AS bin, count(*) AS n, sum(conf - (top = gold_pos)::INT) AS gap, sum(nll) AS nll FROM v_conf GROUP BY 1, 2) GROUP BY gold""", "v_conf"))
def _(v: Views) -> DataFrame:
    one = F.lit(1.0)
    rows = logits(v).select("gold", calibration.confidence(one).alias("conf"), (F.col("top") == F.col("gold_pos")).alias("ok"), F.exp(-calibration.nll(one)).alias("chance"))
    found = rows.groupBy("gold").agg(aggregates.calibration_error(F.col("conf"), F.col("ok")).alias("ece"), aggregates.mean_nll(F.col("chance")).alias("nll"))
    return rounded(found, "ece", "nll")
