"""Aggregate expressions, for any grouping: accuracy, negative log-likelihood, calibration error, macro F1, the paired test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stats


def accuracy(gold: Column, predicted: Column) -> Column:
    """Share of rows with the right label; a null prediction is a wrong one."""
    return F.try_divide(F.count_if(gold.eqNullSafe(predicted)), F.count(F.lit(1)))


def calibration_error(confidence: Column, correct: Column, bins: int = 15) -> Column:
    """Expected calibration error over bins of equal width, the last of which holds 1."""
    place = F.least(F.floor(confidence * bins), F.lit(bins - 1))
    gaps = [F.abs(F.coalesce(F.sum(F.when(place == k, confidence - correct.cast("int"))), F.lit(0.0))) for k in range(bins)]
    return F.try_divide(sum(gaps[1:], gaps[0]), F.count(confidence))


def mean_nll(chance: Column) -> Column:
    """Mean negative logarithm of the gold labels' chances."""
    return F.avg(-F.log(chance))


def macro_f1(gold: Column, predicted: Column, labels: Sequence[str]) -> Column:
    """Mean F1 of the labels that are gold or predicted somewhere; null if none is."""
    scores = []
    for label in labels:
        both, any_ = F.count_if((gold == label) & (predicted == label)), F.count_if(gold == label) + F.count_if(predicted == label)
        scores.append(F.try_divide(2 * both, any_))
    found = F.array_compact(F.array(*scores))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))


def paired_p(candidate: Column, baseline: Column) -> Column:
    """Exact two-sided p of the paired test over rows of two booleans."""
    return stats.mcnemar_p(F.count_if(candidate & ~baseline), F.count_if(~candidate & baseline))
