"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of the edges: comp is the smallest node that its links reach.

    Alternates large-star and small-star steps: in each, neighbours move to the smallest
    neighbour of a node, until every node hangs on the smallest of its component. The
    smallest neighbour comes from an aggregate with map-side combine and goes back by a
    join, so a node with very many neighbours is never gathered in one place. The number
    of rounds grows with the logarithm of the longest path. Loops and repeated edges do no
    harm; an empty table gives none. The result is settled.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    current = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, current = current, settle(small)
        release(before)
        found = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if (found["n"], found["sum"]) == mark or not found["n"]:
            break
        mark = (found["n"], found["sum"])
    # a star forest now: each node other than the smallest has one edge, to the smallest
    out = settle(current.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(current.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))
    release(current)
    return out
