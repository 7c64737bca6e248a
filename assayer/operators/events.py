"""Event logs whose repeats are summarised: "N duplicate reports" lines fold into the originals before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsontools import type_name
from ..functions.times import log_epoch
from ..sources.jsonl import lines


def fold_duplicates(events: DataFrame, keys: list[str], order: list[str], copies: Column) -> DataFrame:
    """events with occurrences, claimed and origin (the order columns of the original that a summary claims).

    `copies` is null for an original, N for a summary of N repeats. A summary claims the
    latest original of its key that is not claimed yet, and counts N; without one it
    counts itself too, 1 + N. The stack of originals that wait is never built: its depth
    is a running sum less the running minimum below zero, and the original that a summary
    claims is the last one that reached the summary's depth.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("__n").isNull(), 1).otherwise(-1)
    marked = events.withColumn("__n", copies.cast("long")).withColumn("__sum", F.sum(step).over(so_far))
    marked = marked.withColumn("__low", F.least(F.lit(0), F.min("__sum").over(so_far)))
    marked = marked.withColumn("__before", F.coalesce(F.lag(F.col("__sum") - F.col("__low")).over(own), F.lit(0)))
    claimed = F.col("__n").isNotNull() & (F.col("__before") > 0)
    # a summary stands at the depth of the original that it takes away
    level = F.when(F.col("__n").isNull(), F.col("__sum") - F.col("__low")).otherwise(F.col("__before"))
    at_level = Window.partitionBy(*keys, "__level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    origin = F.last(F.when(F.col("__n").isNull(), F.struct(*order)), ignorenulls=True).over(at_level)
    out = marked.withColumn("__level", level).withColumn("origin", F.when(claimed, origin))
    occurrences = F.when(F.col("__n").isNull(), F.lit(1)).when(claimed, F.col("__n")).otherwise(1 + F.col("__n")).cast("long")
    return out.withColumn("claimed", claimed).withColumn("occurrences", occurrences).drop("__n", "__sum", "__low", "__before", "__level")


#: Fixed limits of a log: bytes of a line and of the file; what its first line starts with is the caller's.
MOST_LINE, MOST_FILE = 64 << 10, 256 << 20


def scan(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(line, message, ts) of a log of JSON lines after one header line; ValueError if anything in it is not as it must be."""
    rows = lines(spark, path)
    size = rows.agg(F.sum(F.octet_length("raw") + 1).alias("bytes"), F.max(F.octet_length("raw")).alias("longest"), F.min_by("raw", "line").alias("first")).first()
    if size["first"] is None or not size["first"].startswith(header):
        raise ValueError("the header is missing")
    if size["bytes"] > MOST_FILE or size["longest"] > MOST_LINE:
        raise ValueError("the log or a line of it is too long")
    v = F.try_parse_json("raw")
    read = rows.where("line > 1").select("line", F.try_variant_get(v, "$.eventMessage", "string").alias("message"), type_name(v, "$.eventMessage").alias("kind"), log_epoch(F.try_variant_get(v, "$.timestamp", "string")).alias("ts"))
    bad = read.where("kind is null or kind <> 'string'").agg(F.min("line").alias("line")).first()["line"]
    if bad is not None:
        raise ValueError(f"no event at line {bad}")
    return read.drop("kind")


def kept(events: DataFrame, order: list[str], most: int = 1000) -> DataFrame:
    """The first `most` events in order, with truncated: whether there are more. The others are only counted."""
    total = events.agg(F.count("*").alias("__n"))
    return events.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("__n") > most).drop("__n")


def within(events: DataFrame, ts_col: str, start: Column, end: Column, before: float = 2.0, after: float = 5.0) -> Column:
    """Whether an event lies in a window with slack (seconds) on both sides."""
    ts = F.col(ts_col).cast("timestamp").cast("double")
    return ts.between(start.cast("timestamp").cast("double") - before, end.cast("timestamp").cast("double") + after)


def attribute(folded: DataFrame, pid_col: str, tool_pids: list[int], control: Column) -> DataFrame:
    """folded with attribution: positive_control, tool or unattributed."""
    return folded.withColumn("attribution", F.when(control, "positive_control").when(F.col(pid_col).isin(tool_pids), "tool").otherwise("unattributed"))


def verdict(run_exit: int, tool_events: int, unattributed_events: int, control_ran: bool) -> str:
    """clean, denied, or undeterminable, in this order of doubt."""
    if not control_ran or run_exit not in (0, 10, 11, 12, 20, 64, 70):
        return "undeterminable"
    if tool_events:
        return "denied"
    return "undeterminable" if unattributed_events else "clean"
