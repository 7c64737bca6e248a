"""Statistics: as columns where they run per row, as plain Python where they run once on aggregated numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The z of the 95 % interval, the tolerance of threshold comparisons, the level of tests.
Z95 = 1.96
TOLERANCE = 1e-9
LEVEL = 0.05


def wilson(correct: Column, total: Column, z: float = Z95) -> Column:
    """struct(lo, hi) of the Wilson score interval, clamped to 0..1; null if total is 0 or correct exceeds it."""
    n, p = total.cast("double"), F.try_divide(correct.cast("double"), total.cast("double"))
    z2 = z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    interval = F.struct(F.greatest(F.lit(0.0), middle - half).alias("lo"), F.least(F.lit(1.0), middle + half).alias("hi"))
    return F.when((total > 0) & (correct <= total) & (correct >= 0), interval)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of the paired test; 1 without discordant pairs. b and c are bigint.

    The tail is a sum over binomial terms, each from the one before, so that no factorial is formed.
    """
    n, k = b + c, F.least(b, c)
    first = F.exp(-n * F.lit(math.log(2.0)))
    step = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.expr("cast(array() as array<bigint>)")),
        F.struct(F.lit(0.0).alias("ln"), first.alias("sum")),
        lambda acc, i: F.struct(
            (acc["ln"] + F.log(n - i + 1) - F.log(i)).alias("ln"),
            (acc["sum"] + F.exp(acc["ln"] + F.log(n - i + 1) - F.log(i) - n * F.lit(math.log(2.0)))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * step))


def mcnemar_exact(b: int, c: int, most: int = 10_000_000) -> float:
    """The same on the driver, with the tail in log space."""
    if b < 0 or c < 0 or b + c > most:
        raise ValueError(f"discordant counts out of range: {b}, {c}")
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def judge(b: int, c: int, p: float, n: int, required: int) -> str:
    """better, not_better, or undeterminable with fewer rows than required."""
    if n < required:
        return "undeterminable"
    return "better" if b > c and p < LEVEL else "not_better"


def holm(p_values: list[float], family_size: int | None = None) -> list[float]:
    """Step-down adjusted p-values in the order given; the family may be larger than the list."""
    m = len(p_values) if family_size is None else family_size
    if m < len(p_values) or any(not 0 <= p <= 1 for p in p_values):
        raise ValueError("family smaller than the list, or a p-value outside of 0..1")
    out, running = [0.0] * len(p_values), 0.0
    for rank, i in enumerate(sorted(range(len(p_values)), key=lambda i: (p_values[i], i))):
        running = max(running, min(1.0, (m - rank) * p_values[i]))
        out[i] = running
    return out


def accuracy_verdict(lo: Column, hi: Column, least: float) -> Column:
    """pass if the whole interval reaches the target, fail if none of it does, undeterminable between or without one."""
    return F.when(lo.isNull() | hi.isNull(), "undeterminable").when(lo >= least - TOLERANCE, "pass").when(hi < least - TOLERANCE, "fail").otherwise("undeterminable")


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sample_size_estimate(p_b: float, p_c: float, alpha: float = LEVEL, power: float = 0.8) -> float:
    """Rows that a paired comparison needs by the normal approximation."""
    _check_assumption(p_b, p_c, alpha, power)
    d, s = p_b - p_c, p_b + p_c
    return (-normal_quantile(alpha / 2) * math.sqrt(s) + normal_quantile(power) * math.sqrt(max(0.0, s - d * d))) ** 2 / (d * d)


def _check_assumption(p_b: float, p_c: float, alpha: float, power: float) -> None:
    if not (0 <= p_c < p_b <= 1 and p_b + p_c <= 1 and 0 < alpha < 1 and 0 < power < 1):
        raise ValueError("assumed shares must satisfy 0 <= p_c < p_b, p_b + p_c <= 1")


def conditional_power(n: int, theta: float, alpha: float = LEVEL) -> float:
    """Chance that the exact test rejects, either way, given n discordant pairs of which each is a win with chance theta."""
    if n <= 0:
        return 0.0
    tail = total = 0.0
    for k in range(n // 2 + 1):
        log_choose = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        tail += math.exp(log_choose - n * math.log(2))
        if tail >= alpha / 2:
            break
        total += math.exp(log_choose + _ln_power(theta, k) + _ln_power(1 - theta, n - k))
        if k != n - k:
            total += math.exp(log_choose + _ln_power(theta, n - k) + _ln_power(1 - theta, k))
    return min(1.0, total)


def _ln_power(x: float, k: int) -> float:
    return 0.0 if k == 0 else k * math.log(x) if x > 0 else -math.inf


def power_of(total: int, p_b: float, p_c: float, alpha: float = LEVEL, known: dict[int, float] | None = None) -> float:
    """Power with `total` rows: the conditional power averaged over the number of discordant pairs."""
    q, theta = p_b + p_c, p_b / (p_b + p_c)
    known = {} if known is None else known
    power = 0.0
    for n in range(total + 1):
        weight = math.exp(math.lgamma(total + 1) - math.lgamma(n + 1) - math.lgamma(total - n + 1) + _ln_power(q, n) + _ln_power(1 - q, total - n))
        if weight > 1e-16:
            if n not in known:
                known[n] = conditional_power(n, theta, alpha)
            power += weight * known[n]
    return power


def required_sample_size(p_b: float, p_c: float, alpha: float = LEVEL, power: float = 0.8, most: int = 20_000) -> int:
    """The smallest number of rows, from the estimate on, at which the exact test has the power."""
    n, known = math.ceil(sample_size_estimate(p_b, p_c, alpha, power)), {}
    while n <= most:
        if power_of(n, p_b, p_c, alpha, known) >= power:
            return n
        n += 1
    raise ValueError(f"more than {most} rows are needed")


def percentile_95(samples: list[int]) -> tuple[int, int]:
    """(whole part, hundredths) of the linearly interpolated 95th percentile of integers, in integer arithmetic."""
    if not samples:
        raise ValueError("no samples")
    ordered = sorted(samples)
    at, rest = divmod(95 * (len(ordered) - 1), 100)
    step = ordered[at + 1] - ordered[at] if rest else 0
    return divmod(100 * ordered[at] + rest * step, 100)


def nearest_rank_95(values: list[float]) -> float:
    ordered = sorted(values)
    return ordered[math.ceil(0.95 * len(ordered)) - 1]


def percent(share: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.format_string("%.1f%%", 100 * share)


def percentile_95_by(rows: DataFrame, by: str, value_col: str, narrow: int = 1000) -> DataFrame:
    """(by, n, place, floor_value, whole, hundredths, nearest): the 95th percentile of whole numbers by key, as percentile_95 and nearest_rank_95 have it.

    Exact without a sort of a key's rows in one task: beyond `narrow` rows only the values
    between two approximate percentiles around the place are counted, by value.
    """
    x = F.col(value_col).cast("long")
    seen = rows.where(x.isNotNull()).select(F.col(by).alias("key"), x.alias("x"))
    around = seen.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", [0.94, 0.96], 100_000).alias("p"))
    places = around.select(
        "key", "n", F.expr("(95 * (n - 1)) div 100").alias("place"), F.expr("(95 * (n - 1)) % 100").alias("rest"), F.expr("(95 * n + 99) div 100 - 1").alias("rank"),
        F.when(F.col("n") < narrow, F.col("least")).otherwise(F.col("p")[0]).alias("lo"), F.when(F.col("n") < narrow, F.col("most")).otherwise(F.col("p")[1]).alias("hi"),
    )
    joined = seen.join(places, "key")
    below = joined.where("x < lo").groupBy("key").agg(F.count("*").alias("below"))
    counts = joined.where("x between lo and hi").groupBy("key", "x").agg(F.count("*").alias("k"))
    up_to = counts.withColumn("up_to", F.sum("k").over(Window.partitionBy("key").orderBy("x")))
    ranked = up_to.join(places, "key").join(below, "key", "left").withColumn("up_to", F.col("up_to") + F.coalesce("below", F.lit(0)))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("up_to") > place, F.col("x")))

    found = ranked.groupBy("key", "n", "place", "rest").agg(at(F.col("place")).alias("floor_value"), at(F.col("place") + 1).alias("above"), at(F.col("rank")).alias("nearest"))
    total = F.expr("100 * floor_value + if(rest = 0, 0, rest * (above - floor_value))")
    parts = found.withColumn("total", total)
    return parts.select(F.col("key").alias(by), "n", "place", "floor_value", F.expr("(total - pmod(total, 100)) div 100").alias("whole"), F.expr("pmod(total, 100)").alias("hundredths"), "nearest")
