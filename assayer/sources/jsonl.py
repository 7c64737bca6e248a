"""JSON Lines with line numbers, checked line by line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsontools import line_class, type_name
from ..functions.text import is_empty_after_normalising

RECORD = "<record>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of every line that is not blank; blank lines count in the numbering.

    Files of any size are read in splits. A line's number is its place in its split, as
    the scan counts it, and the lines of the splits before it, a row for each split.
    """
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = read.join(splits.select("file", "block", (before - F.col("first") + 1).alias("shift")), ["file", "block"])
    return numbered.select("file", (F.col("at") + F.col("shift")).alias("line"), F.regexp_replace("value", r"\r$", "").alias("raw")).where(~F.col("raw").rlike(r"(?U)^\s*$"))


@dataclass(frozen=True)
class Inspection:
    records: DataFrame  # file, line, id, input, label_id, tags, group_id
    anomalies: DataFrame  # file, line, field, code, expected, actual, first_file, first_line


def _anomaly(field: str, code: str, expected: str | None = None, actual: Column | None = None) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(expected).cast("string").alias("expected"), (F.lit(None).cast("string") if actual is None else actual).alias("actual"))


def _text_field(v: Column, path: str, field: str, required: bool) -> Column:
    kind, value = type_name(v, path), F.try_variant_get(v, path, "string")
    missing = F.when(kind.isNull(), _anomaly(field, "missing_field")) if required else F.when(kind.isNull(), F.lit(None))
    return missing.when(kind != "string", _anomaly(field, "type_mismatch", "string", kind)).when(value == "", _anomaly(field, "empty_value"))


def inspect(rows: DataFrame, labels: list[str], raw_col: str = "raw", line_col: str = "line", file_col: str = "file") -> Inspection:
    """Records that satisfy the contract, and every anomaly of the others.

    A record has non-empty strings id and input, an object output whose intent is one of
    the labels, and may have tags (an array of strings) and a non-empty string group_id.
    A line that is no JSON object, or repeats a key, has that one anomaly; others may have
    several. The first record of an id that is fine otherwise owns it, by file and line;
    later lines with that id, in whatever file, are duplicates. Without a column for the
    file all lines are of one.
    """
    if not labels:
        raise ValueError("the label set is empty")
    file = F.col(file_col) if file_col in rows.columns else F.lit("")
    read = rows.select(file.alias("file"), F.col(line_col).alias("line"), F.col(raw_col).alias("raw")).withColumn("kind", line_class(F.col("raw"))).withColumn("v", F.when(F.col("kind") == "object", F.try_parse_json("raw")))
    v = F.col("v")
    output, intent = type_name(v, "$.output"), type_name(v, "$.output.intent")
    label = F.try_variant_get(v, "$.output.intent", "string")
    label_check = (
        F.when(output.isNull(), _anomaly("output", "missing_field"))
        .when(output != "object", _anomaly("output", "type_mismatch", "object", output))
        .when(intent.isNull(), _anomaly("output.intent", "missing_field"))
        .when(intent != "string", _anomaly("output.intent", "type_mismatch", "string", intent))
        .when(label == "", _anomaly("output.intent", "empty_value"))
        .when(~label.isin(labels), _anomaly("output.intent", "unknown_label"))
    )
    tags = type_name(v, "$.tags")
    elements = F.try_variant_get(v, "$.tags", "array<variant>")
    element_kinds = F.transform(elements, lambda e: type_name(e, "$"))
    tag_checks = F.when(tags == "array", F.transform(F.filter(element_kinds, lambda k: k != "string"), lambda k: _anomaly("tags", "type_mismatch", "string", k))).when(tags.isNotNull(), F.array(_anomaly("tags", "type_mismatch", "array", tags)))
    fields = F.array_compact(F.array(_text_field(v, "$.id", "id", True), _text_field(v, "$.input", "input", True), label_check, _text_field(v, "$.group_id", "group_id", False)))
    whole = F.array(F.struct(F.lit(RECORD).alias("field"), F.col("kind").alias("code"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    found = F.when(F.col("kind") != "object", whole).otherwise(F.concat(fields, F.coalesce(tag_checks, F.expr("cast(array() as array<struct<field:string,code:string,expected:string,actual:string>>)"))))
    checked = read.select(
        "file", "line", F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.input", "string").alias("input"), label.alias("label_id"),
        F.transform(elements, lambda e: F.try_variant_get(e, "$", "string")).alias("tags"), F.try_variant_get(v, "$.group_id", "string").alias("group_id"), found.alias("found"),
    )
    fine = F.size("found") == 0
    named = F.col("id").isNotNull() & (F.col("id") != "")
    place = F.struct("file", "line")
    owners = checked.where(fine & named).groupBy("id").agg(F.min(place).alias("owner"))
    owned = checked.join(owners, "id", "left").withColumn("owner", F.when(named, F.col("owner")))
    repeated = F.col("owner").isNotNull() & (place > F.col("owner"))
    none = F.lit(None).cast("string")
    columns = ["file", "line", "a.field", "a.code", "a.expected", "a.actual"]
    anomalies = owned.select("file", "line", F.explode("found").alias("a")).select(*columns, none.alias("first_file"), F.lit(None).cast("long").alias("first_line"))
    duplicate = F.struct(F.lit("id").alias("field"), F.lit("duplicate_id").alias("code"), none.alias("expected"), none.alias("actual")).alias("a")
    duplicates = owned.where(repeated).select("file", "line", duplicate, "owner").select(*columns, F.col("owner.file").alias("first_file"), F.col("owner.line").alias("first_line"))
    return Inspection(owned.where(fine & ~repeated).select("file", "line", "id", "input", "label_id", "tags", "group_id"), anomalies.unionByName(duplicates))


#: The order of a report's fields.
FIELDS = (RECORD, "id", "input", "output", "output.intent", "tags", "group_id")


def in_report_order(anomalies: DataFrame) -> DataFrame:
    """Anomalies by file, line and field, with the field's place in that order."""
    place = F.array_position(F.array(*[F.lit(f) for f in FIELDS]), F.col("field")).alias("place")
    return anomalies.select("*", place).orderBy("file", "line", "place", "code", "actual")


def examples(rows: DataFrame, labels: list[str], raw_col: str = "raw", line_col: str = "line") -> DataFrame:
    """(line, input, label, error) of training lines: objects of exactly the strings input and label, the input with something left after normalising."""
    v = F.col("v")
    read = rows.select(F.col(line_col).alias("line"), F.col(raw_col).alias("raw")).withColumn("kind", line_class(F.col("raw"))).withColumn("v", F.when(F.col("kind") == "object", F.try_parse_json("raw")))
    keys, text, label = F.json_object_keys("raw"), F.try_variant_get(v, "$.input", "string"), F.try_variant_get(v, "$.label", "string")
    error = (
        F.when(F.col("kind") != "object", F.col("kind"))
        .when((F.size(keys) != 2) | ~F.array_contains(keys, "input") | ~F.array_contains(keys, "label"), "fields")
        .when((type_name(v, "$.input") != "string") | (type_name(v, "$.label") != "string"), "type_mismatch")
        .when(is_empty_after_normalising(text), "empty_value")
        .when(~label.isin(labels), "unknown_label")
    )
    return read.select("line", F.when(error.isNull(), text).alias("input"), F.when(error.isNull(), label).alias("label"), error.alias("error"))
