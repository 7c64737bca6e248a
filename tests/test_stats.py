import math
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import stats


def exact_p(b, c):
    n, k = b + c, min(b, c)
    return float(min(Fraction(1), 2 * sum(Fraction(math.comb(n, i), 2**n) for i in range(k + 1)))) if n else 1.0


def test_mcnemar_column_and_driver_match_fractions(spark):
    cases = [(0, 0), (1, 0), (3, 1), (0, 9), (12, 5), (100, 70), (500, 431), (7, 7)]
    df = spark.createDataFrame(cases, "b long, c long")
    for r in df.select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect():
        want = exact_p(r["b"], r["c"])
        assert abs(r["p"] - want) < 1e-9
        assert abs(stats.mcnemar_exact(r["b"], r["c"]) - want) < 1e-9


@given(st.lists(st.floats(0, 1), max_size=8), st.integers(0, 3))
def test_holm(ps, more):
    got = stats.holm(ps, len(ps) + more)
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    assert all(a <= got[i] <= 1 for i, a in enumerate(ps))
    assert all(got[a] <= got[b] for a, b in zip(order, order[1:], strict=False))
    if ps:
        assert got[order[0]] == min(1.0, (len(ps) + more) * ps[order[0]])


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (12, 24), (0, 0), (3, 2)], "k long, n long")
    got = {(r["k"], r["n"]): r["w"] for r in df.select("k", "n", stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()}
    assert got[0, 0] is None and got[3, 2] is None
    assert got[0, 10]["lo"] == 0 and abs(got[10, 10]["hi"] - 1) < 1e-12
    lo, hi = got[12, 24]["lo"], got[12, 24]["hi"]
    z, p, n = 1.96, 0.5, 24
    for x in (lo, hi):  # both ends solve (p - x)^2 = z^2 x (1 - x) / n
        assert abs((p - x) ** 2 - z * z * x * (1 - x) / n) < 1e-12


def test_sample_sizes():
    n = stats.required_sample_size(0.2, 0.1)
    assert n >= stats.sample_size_estimate(0.2, 0.1) and stats.power_of(n, 0.2, 0.1) >= 0.8 > stats.power_of(n - 1, 0.2, 0.1) - 0.02
    assert stats.conditional_power(0, 0.6) == 0 and stats.conditional_power(5, 0.9) == 0
    assert abs(stats.conditional_power(6, 0.9) - (0.9**6 + 0.1**6)) < 1e-12
    with pytest.raises(ValueError):
        stats.sample_size_estimate(0.1, 0.2)


def test_percentiles():
    assert stats.percentile_95([10]) == (10, 0)
    assert stats.percentile_95(list(range(0, 21))) == (19, 0)
    assert stats.percentile_95([0, 10]) == (9, 50)
    assert stats.nearest_rank_95([1.0, 2.0, 3.0]) == 3.0


def test_judge():
    assert [stats.judge(9, 0, 0.004, 20, 30), stats.judge(9, 0, 0.004, 40, 30), stats.judge(0, 9, 0.004, 40, 30)] == ["undeterminable", "better", "not_better"]
