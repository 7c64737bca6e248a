"""Temperature, calibration error, thresholds and abstention over logits (arrays in label order; -inf is a logit, NaN and +inf are not)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 15
#: What a row costs whose gold logit is -inf: -ln 1e-12.
IMPOSSIBLE = 27.631021115928547
MIN_T, MAX_T = 0.05, 20.0


def prepared(rows: DataFrame, labels: list[str], gold_col: str = "gold", logits_col: str = "logits") -> DataFrame:
    """rows with d (logits less the largest), top (place of the first largest) and gold_d; rows that break the contract have a null d."""
    x = F.col(logits_col)
    bad = (F.size(x) != len(labels)) | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (v == float("inf"))) | F.forall(x, lambda v: v == float("-inf"))
    best = F.array_max(x)
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(gold_col)).cast("int")
    d = F.when(~bad, F.transform(x, lambda v: v - best))
    return rows.select("*", d.alias("d"), F.when(~bad, F.array_position(x, best).cast("int")).alias("top"), place.alias("gold_pos")).withColumn("gold_d", F.when(F.col("gold_pos") > 0, F.get("d", F.col("gold_pos") - 1)))


def confidence(beta: Column) -> Column:
    """Share of the first largest logit at inverse temperature beta; needs d."""
    return 1 / F.aggregate("d", F.lit(0.0), lambda a, v: a + F.exp(beta * v))


def nll(beta: Column) -> Column:
    impossible = F.col("gold_d") == float("-inf")
    return F.when(impossible, F.lit(IMPOSSIBLE)).otherwise(F.log(F.aggregate("d", F.lit(0.0), lambda a, v: a + F.exp(beta * v))) - beta * F.col("gold_d"))


def bin_of(conf: Column) -> Column:
    """0..14 by comparison with the bounds; the last bin holds 1."""
    return F.greatest(F.lit(0), *[F.when(conf >= k / BINS, k).otherwise(0) for k in range(1, BINS)])


def measures(rows: DataFrame, beta: float) -> DataFrame:
    """One row: mean nll and calibration error at the inverse temperature."""
    b = F.lit(float(beta))
    seen = rows.select(nll(b).alias("nll"), confidence(b).alias("conf"), (F.col("top") == F.col("gold_pos")).cast("int").alias("ok"))
    bins = seen.groupBy(bin_of(F.col("conf")).alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("ok").alias("ok"), F.sum("nll").alias("nll"))
    return bins.agg((F.sum("nll") / F.sum("n")).alias("nll"), (F.sum(F.abs(F.col("conf") - F.col("ok"))) / F.sum("n")).alias("ece"))


def threshold(confidences: DataFrame, conf_col: str = "conf") -> DataFrame:
    """One row: the confidence at place (n - 1) div 5 of the ascending order, at which four fifths are answered.

    An exact order statistic without a sort on one task: the histogram of the values is
    narrowed to the bin that holds the place, which alone is sorted.
    """
    n = confidences.count()
    if not n:
        return confidences.select(F.col(conf_col).cast("double").alias("tau")).limit(0)
    place, low, high = (n - 1) // 5, 0.0, 1.0
    below = 0
    for _ in range(6):
        width = (high - low) / 256
        if width <= 0:
            break
        bin_ = F.least(F.lit(255), F.floor((F.col(conf_col) - low) / width)).cast("int")
        counts = sorted((r["b"], r["n"]) for r in confidences.where((F.col(conf_col) >= low) & (F.col(conf_col) <= high)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect())
        seen = below
        for b, k in counts:
            if seen + k > place:
                bounds = confidences.where((F.col(conf_col) >= low) & (F.col(conf_col) <= high)).where(bin_ == b).agg(F.min(conf_col).alias("lo"), F.max(conf_col).alias("hi")).first()
                break
            seen += k
        below, low, high = seen, float(bounds["lo"]), float(bounds["hi"])
        if low == high:
            return confidences.sparkSession.createDataFrame([(low,)], "tau double")
        if k <= 10_000:
            break
    inside = confidences.where((F.col(conf_col) >= low) & (F.col(conf_col) <= high)).orderBy(conf_col).limit(place - below + 1)
    return inside.agg(F.max(conf_col).alias("tau"))


@dataclass(frozen=True)
class Calibration:
    best_temperature: float
    temperature: float
    adopted: bool
    tau: float
    nll_before: float
    nll_after: float
    ece_before: float
    ece_after: float


#: Places at which one pass over the rows looks at the derivative.
GRID = 32


def calibrate(rows: DataFrame, steps: int = 40) -> Calibration:
    """Temperature where the derivative of the mean nll changes its sign, kept only if the calibration error strictly improves. rows: prepared.

    Each pass looks at a grid of inverse temperatures in one aggregate and goes on between
    the two neighbours with different signs.
    """
    rows = rows.cache()
    try:

        def slopes(betas: list[float]) -> list[float]:
            def mean(b: Column) -> Column:
                weights = F.transform("d", lambda v: F.exp(b * v))
                zipped = F.arrays_zip(weights.alias("w"), F.col("d").alias("v"))
                return F.aggregate(zipped, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t")), lambda a, z: F.struct((a["s"] + z["w"]).alias("s"), (a["t"] + F.when(z["w"] > 0, z["w"] * z["v"]).otherwise(0.0)).alias("t")), lambda a: a["t"] / a["s"])

            found = rows.where("gold_d > double('-infinity')").agg(*[F.avg(mean(F.lit(float(b))) - F.col("gold_d")).alias(f"h{i}") for i, b in enumerate(betas)]).first()
            return [x or 0.0 for x in found]

        low, high = 1 / MAX_T, 1 / MIN_T
        first, last = slopes([low, high])
        if first >= 0 and last <= 0:
            beta = 1.0
        elif first >= 0:
            beta = low
        elif last <= 0:
            beta = high
        else:
            beta = (low + high) / 2
            for _ in range(steps):
                grid = [low + (high - low) * (i + 1) / (GRID + 1) for i in range(GRID)]
                signs = slopes(grid)
                at = next((i for i, h in enumerate(signs) if h >= 0), GRID)
                low, high = (grid[at - 1] if at else low), (grid[at] if at < GRID else high)
                beta = (low + high) / 2
                if high - low < 1e-9:
                    break
        before, after = measures(rows, 1.0).first(), measures(rows, beta).first()
        adopted = after["ece"] < before["ece"]
        used = beta if adopted else 1.0
        tau = threshold(rows.select(confidence(F.lit(used)).alias("conf"))).first()["tau"]
        return Calibration(1 / beta, 1 / used, adopted, tau, before["nll"], after["nll"], before["ece"], after["ece"])
    finally:
        rows.unpersist()


def decide(conf: Column, top_label: Column, tau: Column, out_of_scope: str | None = None) -> Column:
    """out_of_scope (before the threshold is asked), adopt, or abstain."""
    adopt = F.when(conf >= tau, "adopt").otherwise("abstain")
    return adopt if out_of_scope is None else F.when(top_label == out_of_scope, "out_of_scope").otherwise(adopt)


def coverage(decisions: DataFrame, decision_col: str = "decision") -> DataFrame:
    """One row: n, answered, abstained, coverage, meets_target (answered at least 4/5, in integers)."""
    counts = decisions.agg(F.count("*").alias("n"), F.count_if(F.col(decision_col) == "abstain").alias("abstained"))
    return counts.select("n", (F.col("n") - F.col("abstained")).alias("answered"), "abstained", F.expr("try_divide(n - abstained, n)").alias("coverage"), (5 * (F.col("n") - F.col("abstained")) >= 4 * F.col("n")).alias("meets_target"))


def compare_abstention(rows: DataFrame, labels: list[str], temperature: float, tau: float, out_of_scope: str | None = None) -> DataFrame:
    """Two rows, without and with abstention: n, correct, accuracy over all rows and over adopted ones, coverage. rows: prepared, with id and gold.

    An out-of-scope decision counts as that label in either row.
    """
    from .evaluation import totals

    names = F.array(*[F.lit(x) for x in labels])
    conf, top = confidence(F.lit(1.0 / temperature)), F.get(names, F.col("top") - 1)
    seen = rows.select("gold", top.alias("label"), decide(conf, top, F.lit(tau), out_of_scope).alias("decision"))
    none = F.lit(None).cast("string")
    plain = seen.select("gold", F.lit("label").alias("kind"), "label", none.alias("reason"))
    kind = F.when(F.col("decision") == "abstain", "abstain").otherwise("label")
    careful = seen.select("gold", kind.alias("kind"), F.when(kind == "label", F.col("label")).alias("label"), none.alias("reason"))
    columns = ("n", "n_correct", "n_abstain", "accuracy", "adopted_accuracy", "coverage")
    return totals(plain).select(F.lit("without").alias("abstention"), *columns).unionByName(totals(careful).select(F.lit("with").alias("abstention"), *columns))
