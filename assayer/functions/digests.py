"""Digests of tables that do not depend on the order of their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(columns: Sequence[str]) -> Column:
    """A hash of the columns' bytes; each is hashed by itself first, so that no value runs into the next. A null is no value."""
    return F.sha2(F.concat(*[F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("-")) for c in columns]), 256)


def rows_digest(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, digest) of all rows, each as often as it occurs.

    Equal rows are counted first, so that they do not cancel out and a row that is
    repeated very often is one entry. Entries are hashed in order by the first four
    digits of their row's hash, and these parts in order again: no task sees more than
    1/65,536 of the distinct rows.
    """
    counted = rows.groupBy(*by, row_digest(columns).alias("row")).agg(F.count("*").alias("n"))
    entries = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "row", "n"))), ",")
    parts = counted.groupBy(*by, F.substring("row", 1, 4).alias("head")).agg(F.sum("n").alias("n"), F.sha2(entries, 256).alias("part"))
    whole = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "head", "part"))), ",")
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("digest"))
