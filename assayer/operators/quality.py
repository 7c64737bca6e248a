"""Contract checks of labelled text: counts, duplicates, contradictions, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_counts(records: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """(pos, label, n) for every declared label in declaration order, zeros included."""
    counts = records.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    return labels.join(counts, "label", "left").select("pos", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(records: DataFrame, labels: DataFrame, input_col: str = "input", label_col: str = "label") -> DataFrame:
    """One row: n_rows, n_inputs (distinct), n_labels (observed), min_count (over observed labels; null without rows), n_absent."""
    inputs = records.select(F.xxhash64(input_col, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), input_col).alias("b")).distinct().agg(F.count("*").alias("n_inputs"))
    counts = label_counts(records, labels, label_col)
    totals = counts.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 0).alias("n_labels"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("min_count"), F.count_if(F.col("n") == 0).alias("n_absent"))
    return totals.crossJoin(F.broadcast(inputs)).select("n_rows", "n_inputs", "n_labels", "min_count", "n_absent")


def absent_labels(records: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    seen = records.select(F.col(label_col).alias("label")).distinct()
    return labels.join(seen, "label", "left_anti").select("pos", "label")


def data_volume(n: Column) -> Column:
    """Fixed steps: under 100, under 3000, from 3000."""
    return F.when(n < 100, "few").when(n < 3000, "some").otherwise("many")


def duplicate_ids(rows: DataFrame, id_col: str = "id", line_col: str = "line") -> DataFrame:
    """All rows, the first included, of ids that occur more than once."""
    counts = rows.groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return rows.join(counts, id_col, "left_semi").select(id_col, line_col)


def first_lines(rows: DataFrame, key_col: str, line_col: str = "line", fine: Column | None = None) -> DataFrame:
    """(key, line, first_line) of rows that come after the first fine row of their key."""
    ok = F.lit(True) if fine is None else fine
    first = F.min(F.when(ok, F.col(line_col))).over(Window.partitionBy(key_col))
    return rows.select(F.col(key_col).alias("key"), F.col(line_col).alias("line"), first.alias("first_line")).where("line > first_line")


def contradictions(records: DataFrame, key: Column, gold: Column, id_col: str = "id", group_col: str | None = "group_id", keep_ids: int | None = None) -> DataFrame:
    """Inputs (by key) with two or more distinct golds: first_id, n_ids, n_gold, n_groups, n_without_group.

    The ids of an entry are not gathered (one input may have a third of all rows);
    `members` lists them, one row each.
    """
    group = F.col(group_col) if group_col else F.lit(None).cast("string")
    keyed = records.select(key.alias("key"), gold.alias("gold"), F.col(id_col).alias("id"), group.alias("group_id"))
    by_gold = keyed.groupBy("key", "gold").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.count_if(F.col("group_id").isNull()).alias("bare"))
    found = by_gold.groupBy("key").agg(F.count("gold").alias("n_gold"), F.sum("n").alias("n_ids"), F.min("first_id").alias("first_id"), F.sum("bare").alias("n_without_group")).where("n_gold >= 2")
    groups = keyed.where("group_id is not null").select("key", "group_id").distinct().groupBy("key").agg(F.count("*").alias("n_groups"))
    return found.join(groups, "key", "left").select("key", "first_id", "n_ids", "n_gold", F.coalesce("n_groups", F.lit(0)).cast("long").alias("n_groups"), "n_without_group")


def contradiction_members(records: DataFrame, key: Column, gold: Column, id_col: str = "id") -> DataFrame:
    """(key, id, gold) of every row whose input has contradictory golds."""
    keyed = records.select(key.alias("key"), gold.alias("gold"), F.col(id_col).alias("id"))
    mixed = keyed.groupBy("key").agg(F.min("gold").alias("a"), F.max("gold").alias("b")).where("a <> b").select("key")
    return keyed.join(mixed, "key", "left_semi")


def duplicate_inputs(records: DataFrame, key: Column, label_col: str, line_col: str = "line") -> DataFrame:
    """(line, code) of rows whose input (by key) occurs again: duplicate_input with one label, contradictory_label with several."""
    keyed = records.select(key.alias("key"), F.col(label_col).alias("label"), F.col(line_col).alias("line"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("n > 1")
    return keyed.join(groups, "key").select("line", F.when(F.col("a") == F.col("b"), "duplicate_input").otherwise("contradictory_label").alias("code"))


def metadata_mixed(records: DataFrame, reasons: dict[str, Column], input_col: str = "input", id_col: str = "id", answers: Column | None = None) -> DataFrame:
    """(id, reasons) of rows whose own metadata stands in their input. reasons: name -> needle; an empty needle is never found, but for `id`.

    answers, an array of the ways in which the row's answer may be written (see
    jsontools.answer_needles), adds the reason `answer` if one of them is found.
    """
    text = F.col(input_col)
    found = [F.when(F.contains(text, needle) & ((F.length(needle) > 0) | F.lit(name == "id")), name) for name, needle in reasons.items()]
    if answers is not None:
        found.append(F.when(F.exists(answers, lambda a: (F.length(a) > 0) & F.contains(text, a)), "answer"))
    return records.select(F.col(id_col).alias("id"), F.array_compact(F.array(*found)).alias("reasons")).where(F.size("reasons") > 0)


def input_leaks(parts: DataFrame, base: str = "train", input_col: str = "input", part_col: str = "part", id_col: str = "id") -> DataFrame:
    """(part, input_sha256, n_base, n_other, first_base, first_other): inputs of the base partition that occur, byte for byte, in another."""
    counts = parts.groupBy(F.sha2(input_col, 256).alias("input_sha256"), F.col(part_col).alias("part")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
    left = counts.where(F.col("part") == base).select("input_sha256", F.col("n").alias("n_base"), F.col("first_id").alias("first_base"))
    right = counts.where(F.col("part") != base).select("input_sha256", "part", F.col("n").alias("n_other"), F.col("first_id").alias("first_other"))
    return right.join(left, "input_sha256").select("part", "input_sha256", "n_base", "n_other", "first_base", "first_other")


def group_straddles(parts: DataFrame, group_col: str = "group_id", part_col: str = "part") -> DataFrame:
    """(group_id, n_parts, n_records) of groups that lie in several partitions; rows without a group are skipped."""
    counts = parts.where(F.col(group_col).isNotNull()).groupBy(F.col(group_col).alias("group_id"), part_col).agg(F.count("*").alias("n"))
    return counts.groupBy("group_id").agg(F.count("*").alias("n_parts"), F.sum("n").alias("n_records")).where("n_parts >= 2")


def group_labels(records: DataFrame, group_col: str = "group_id", label_col: str = "label") -> DataFrame:
    """(group_id, label): each group's most frequent label, the smallest of equals."""
    counts = records.groupBy(F.col(group_col).alias("group_id"), F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    return counts.groupBy("group_id").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))


def limits(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row for checks of resource limits: rows, and by column the largest and the total number of bytes."""
    sizes = [x for c in columns for x in (F.max(F.octet_length(c)).cast("long").alias(f"max_{c}_bytes"), F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long").alias(f"total_{c}_bytes"))]
    return records.agg(F.count("*").alias("n_rows"), *sizes)
