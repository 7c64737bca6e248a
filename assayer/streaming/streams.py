"""Structured Streaming forms: history log, batch scoring, duplicate folding, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = "time long, text string, output string, exit_code int, elapsed_ms long, package string, version string"


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an append-only history as a stream; lines that do not parse are left out by null times."""
    raw = spark.readStream.format("text").load(folder)
    return raw.select(F.from_json("value", HISTORY).alias("h")).select("h.*").where("time is not null")


def append_history(stream: DataFrame, folder: str, checkpoint: str, most_bytes: int = 64 << 20):
    """Appends the stream's lines (value) to a history in segments: a segment that has reached most_bytes is left alone from then on.

    A batch that is written again replaces its own files, so that a restart repeats nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        sizes = {s.getPath().getName(): files.getContentSummary(s.getPath()).getLength() for s in (files.listStatus(at) if files.exists(at) else []) if s.getPath().getName().startswith("segment=")}
        last = max((int(n.partition("=")[2]) for n in sizes), default=0)
        done = [int(n.partition("=")[2]) for n in sizes if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/batch={number}"))]
        segment = done[0] if done else last + (sizes.get(f"segment={last}", 0) >= most_bytes)
        batch.select("value").write.mode("overwrite").text(f"{folder}/segment={segment}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def history_rates(lines: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Lines and failures by window of event time, late lines dropped after the watermark."""
    timed = lines.withColumn("at", F.timestamp_seconds("time")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("failed"), F.max("elapsed_ms").alias("slowest_ms"))


def score_batches(requests: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Scores each micro-batch and appends it whole or not at all: a batch with a bad row fails before anything is written."""

    def write(batch: DataFrame, number: int) -> None:
        scored = score(batch)
        bad = scored.where("predicted_label is null").limit(1).count()
        if bad:
            raise ValueError(f"batch {number} holds a row that cannot be scored")
        scored.withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").parquet(path)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def fold_stream(events: DataFrame, keys: list[str], most_pending: int = 100_000) -> DataFrame:
    """(keys, seq, occurrences, claimed) of a stream of events with keys, seq and copies (null: an original).

    The state of a key is the number of originals that wait, since only that decides what
    a summary counts. More than `most_pending` of them stop the query.
    """
    types = dict(events.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "seq long, occurrences long, claimed boolean"])

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, copies in zip(rows["seq"], rows["copies"], strict=True):
            if pd.isna(copies):
                waiting += 1
                out.append((*key, seq, 1, False))
            elif waiting:
                waiting -= 1
                out.append((*key, seq, int(copies), True))
            else:
                out.append((*key, seq, 1 + int(copies), False))
        if waiting > most_pending:
            raise ValueError("too many events wait for their summaries")
        state.update((waiting,))
        yield pd.DataFrame(out, columns=[*keys, "seq", "occurrences", "claimed"])

    return events.groupBy(*keys).applyInPandasWithState(fold, schema, "waiting long", "append", GroupStateTimeout.NoTimeout)
