import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import arrow, common


def test_settled_tables_are_equal_and_lie_in_the_shared_folder(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2).withColumn("text", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string")))
    out = common.settle(df)
    assert out.schema.simpleString() == df.schema.simpleString() and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    folder = common.shared_dir(spark).removeprefix("file://")
    assert any(name.startswith("assayer-") for name in os.listdir(folder))
    assert common.settle(df.limit(0)).count() == 0


def test_slices_keep_all_rows_and_their_order():
    texts = ["", None, "a" * 50, "b", "c" * 200, "d" * 3, None, "e" * 99] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    for most in (1, 60, 10_000):
        parts = list(arrow.slices(batch, 1, most))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= most for p in parts)


def test_ragged_arrays():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 5, 40)
    flat, which = rng.integers(0, 100, lengths.sum()), rng.integers(0, 40, 25)
    starts = np.cumsum(lengths) - lengths
    got, sizes = arrow.take(flat, lengths, which)
    assert got.tolist() == [x for w in which for x in flat[starts[w] : starts[w] + lengths[w]]] and sizes.tolist() == lengths[which].tolist()
    for values in (np.zeros(0, int), rng.integers(0, 2**31 - 1, 1000), np.array([0])):
        assert arrow.expand(arrow.squeeze(values)).tolist() == values.tolist()
