"""Gold and prediction files for an evaluation: strict, the first bad line stops the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontools import line_class, type_name
from ..operators.evaluation import scores_invalid

class BadInput(ValueError):
    """A file that breaks the contract as a whole; `reason` is a fixed code."""

    def __init__(self, reason: str, line: int | None = None):
        super().__init__(reason if line is None else f"{reason} at line {line}")
        self.reason, self.line = reason, line


def without_literals(raw: Column) -> Column:
    """raw with non-finite literals among the values of a flat top-level `scores` object put as null.

    Elsewhere they stay, so that such a line stays malformed.
    """
    inside = F.regexp_extract(raw, r'"scores"\s*:\s*\{[^{}]*\}', 0)
    cleaned = F.regexp_replace(inside, r":\s*(?:-?(?:NaN|Infinity)\b|-?[0-9]+(?:\.[0-9]+)?[eE]\+?[0-9]{3,})", ":null")
    return F.when(inside != "", F.replace(raw, inside, cleaned)).otherwise(raw)


def _checked(rows: DataFrame, raw: Column) -> DataFrame:
    read = rows.select(*["file"] * ("file" in rows.columns), "line", raw.alias("raw")).withColumn("class", line_class(F.col("raw"))).withColumn("v", F.when(F.col("class") == "object", F.try_parse_json("raw")))
    kind, value = type_name(F.col("v"), "$.id"), F.try_variant_get(F.col("v"), "$.id", "string")
    return read.withColumn("id", F.when(kind == "string", value)).withColumn("bad", F.when(F.col("class") != "object", F.col("class")).when(F.col("id").isNull() | (F.col("id") == ""), "malformed_id"))


def _stop(read: DataFrame) -> None:
    place = F.struct(*["file"] * ("file" in read.columns), "line")
    first = read.where("bad is not null").agg(F.min_by("bad", place).alias("bad"), F.min(place)["line"].alias("line")).first()
    if first["line"] is not None:
        raise BadInput(first["bad"], first["line"])
    repeated = read.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        raise BadInput("duplicate_id")


def gold(rows: DataFrame, label_names: list[str]) -> DataFrame:
    """(line, id, label, input, code) from (line, raw): the label, else output.intent; code says why a row has no usable label."""
    read = _checked(rows, F.col("raw"))
    _stop(read)
    v = F.col("v")
    direct, nested = type_name(v, "$.label"), type_name(v, "$.output.intent")
    use_direct = direct.isNotNull() & (direct != "null")
    kind = F.when(use_direct, direct).otherwise(nested)
    value = F.when(use_direct, F.try_variant_get(v, "$.label", "string")).otherwise(F.try_variant_get(v, "$.output.intent", "string"))
    code = F.when(kind.isNull() | (kind == "null"), "missing_gold").when(kind != "string", "malformed_gold").when(~value.isin(label_names), "unknown_gold_label")
    return read.select(*["file"] * ("file" in read.columns), "line", "id", F.when(code.isNull(), value).alias("label"), F.when(type_name(v, "$.input") == "string", F.try_variant_get(v, "$.input", "string")).alias("input"), code.alias("code"))


def predictions(rows: DataFrame) -> DataFrame:
    """(line, id, status, predicted_label, reason): a label that is no string is null; invalid scores make the row an error."""
    read = _checked(rows, without_literals(F.col("raw")))
    _stop(read)
    v = F.col("v")
    scores_kind = type_name(v, "$.scores")
    scores = F.from_json(F.to_json(F.try_variant_get(v, "$.scores", "variant")), "map<string,double>")
    numbers = F.forall(F.map_values(F.try_variant_get(v, "$.scores", "map<string,variant>")), lambda x: type_name(x, "$") == "number")
    bad = F.when(scores_kind.isNull() | (scores_kind == "null"), F.lit(False)).when(scores_kind != "object", F.lit(True)).otherwise(~F.coalesce(numbers, F.lit(False)) | scores_invalid(scores))
    status = F.try_variant_get(v, "$.status", "string")
    label = F.when(type_name(v, "$.predicted_label") == "string", F.try_variant_get(v, "$.predicted_label", "string"))
    return read.select("line", "id", F.when(bad, "error").otherwise(status).alias("status"), F.when(~bad, label).alias("predicted_label"), F.when(bad, "invalid_score").alias("reason"))
