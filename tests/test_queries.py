"""Every registered query with a DuckDB equivalent against it, and its independence of partitioning."""

import math

import duckdb
import pytest

from assayer.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return round(float(value), 8) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in duck.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, duck.fetchall())


@pytest.mark.parametrize("name", ["per_label_metrics", "contradictions", "duplicate_fold", "group_split", "abstention_threshold"])
def test_does_not_depend_on_partitions(spark, name):
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = registry.QUERIES[name](spark, SF)
        seen.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES
