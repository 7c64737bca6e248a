"""Lines to judge: strict id and input, with limits, and the files that go out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import rows_digest
from ..functions.jsontools import line_class, type_name
from .sides import BadInput


@dataclass(frozen=True)
class Limits:
    line_bytes: int = 1 << 20
    id_bytes: int = 1024
    records: int = 100_000
    total_bytes: int = 64 << 20


def parse(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(line, id, input, error) of (line, raw): an object of the strings id (1 to id_bytes bytes) and input, and nothing else."""
    v = F.col("v")
    read = rows.withColumn("class", line_class(F.col("raw"))).withColumn("v", F.when(F.col("class") == "object", F.try_parse_json("raw")))
    id_kind, input_kind = type_name(v, "$.id"), type_name(v, "$.input")
    id_, keys = F.try_variant_get(v, "$.id", "string"), F.json_object_keys("raw")
    error = (
        F.when(F.octet_length("raw") > limits.line_bytes, "too_large")
        .when(F.col("class") != "object", F.col("class"))
        .when(F.size(F.array_except(keys, F.array(F.lit("id"), F.lit("input")))) > 0, "unknown_field")
        .when(id_kind.isNull() | input_kind.isNull(), "missing_field")
        .when((id_kind != "string") | (input_kind != "string"), "type_mismatch")
        .when(id_ == "", "empty_id")
        .when(F.octet_length(id_) > limits.id_bytes, "id_too_long")
    )
    return read.select("line", F.when(error.isNull(), id_).alias("id"), F.when(error.isNull(), F.try_variant_get(v, "$.input", "string")).alias("input"), error.alias("error"))


def batch(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(line, id, input) of a whole batch: limits and the first bad record, by line, stop it, and so does a batch without records."""
    found = parse(rows, limits)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).alias("bytes")).first()
    if not size["n"]:
        raise BadInput("invalid_input")
    if size["n"] > limits.records or size["bytes"] > limits.total_bytes:
        raise BadInput("limit_exceeded")
    first = found.where("error is not null").agg(F.min("line").alias("line"), F.min_by("error", "line").alias("error")).first()
    if first["line"] is not None:
        raise BadInput(first["error"], first["line"])
    return found.drop("error")


def single(spark: SparkSession, id_: str, text: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    if not id_ or len(id_.encode()) > limits.id_bytes or len(text.encode()) > limits.line_bytes:
        raise BadInput("invalid_input", 1)
    return spark.createDataFrame([(1, id_, text)], "line long, id string, input string")


def json_lines(rows: DataFrame, columns: list[str], order_col: str | None = None, keep_nulls: bool = True) -> DataFrame:
    """(value): each row as one JSON object with the columns in order; nulls are written unless keep_nulls is off."""
    ordered = rows if order_col is None else rows.orderBy(order_col)
    return ordered.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if keep_nulls else "true"}).alias("value"))


def prediction_lines(outcomes: DataFrame, order_col: str) -> DataFrame:
    """(value): one line a record in order; an invalid prediction is an ok one without a label."""
    status = F.when(F.col("kind").isin("label", "invalid"), "ok").otherwise(F.col("kind"))
    rows = outcomes.select(order_col, "id", status.alias("status"), F.when(F.col("kind") == "label", F.col("label")).alias("predicted_label"))
    return json_lines(rows, ["id", "status", "predicted_label"], order_col)


def write_new(lines: DataFrame, path: str) -> None:
    """Writes (value) as text under a path that must not exist."""
    lines.write.mode("errorifexists").text(path)


def summary(lines: DataFrame) -> DataFrame:
    """One row: count, and a digest of all lines that does not depend on their order."""
    return rows_digest(lines, ["value"]).select(F.col("n").alias("count"), "digest")


def within_budget(rows: DataFrame, bytes_col: Column, order_col: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The first rows, in order, that keep to both limits together; for samples of bounded tables."""
    from pyspark.sql import Window

    so_far = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.orderBy(order_col).limit(most_rows).withColumn("__bytes", F.sum(bytes_col).over(so_far))
    return marked.where(F.col("__bytes") <= most_bytes).drop("__bytes")
