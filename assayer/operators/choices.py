"""Scoring a row against every choice, and reading a choice back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("mapped", "no_choice_match", "invalid_score")


def posteriors(loglik: Column) -> Column:
    """Softmax of the log-likelihoods as they are (no normalisation by length); null if one is null, NaN or infinite."""
    bad = F.exists(loglik, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    best = F.array_max(loglik)
    total = F.aggregate(loglik, F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return F.when(~bad & (F.size(loglik) > 0), F.transform(loglik, lambda x: F.exp(x - best) / total))


def score(rows: DataFrame, choices: list[str], loglik: Callable[[str, list[str]], list[float]], chunk: int = 8, id_col: str = "id", input_col: str = "input") -> DataFrame:
    """(id, loglik): the log-likelihood of each choice given each row's input, choices in chunks; rows stay where they are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [[x for at in range(0, len(choices), chunk) for x in loglik(text, choices[at : at + chunk])] if text is not None else None for text in part["input"]]
            yield pd.DataFrame({"id": part["id"], "loglik": found})

    return rows.select(F.col(id_col).alias("id"), F.col(input_col).alias("input")).mapInPandas(run, "id string, loglik array<double>")


def mapped(scored: DataFrame, labels: list[str], choices: list[str]) -> DataFrame:
    """(id, outcome, label, posterior): the first choice with the largest posterior, if it is a label byte for byte."""
    p = posteriors(F.col("loglik"))
    best = F.array_max("p")
    choice = F.get(F.array(*[F.lit(c) for c in choices]), F.array_position("p", best).cast("int") - 1)
    known = choice.isin(labels)
    with_p = scored.select("id", F.when(F.size("loglik") == len(choices), p).alias("p"))
    outcome = F.when(F.col("p").isNull(), "invalid_score").when(known, "mapped").otherwise("no_choice_match")
    return with_p.select("id", outcome.alias("outcome"), F.when(outcome == "mapped", choice).alias("label"), F.when(outcome == "mapped", best).alias("posterior"))


def tally(results: DataFrame) -> DataFrame:
    """One row: how many rows had each outcome."""
    return results.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def resolve(generated: Column, labels: list[str]) -> Column:
    """The label that a generated byte string is, exactly; null if none is."""
    text = F.try_validate_utf8(generated.cast("binary").cast("string"))
    return F.when(text.isin(labels), text)


def parity(results: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: n cases of the reference (id, label) and how many results differ or are missing."""
    both = reference.select("id", F.col("label").alias("expected")).join(results.select("id", F.col("predicted_label").alias("found")), "id", "left")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("expected").eqNullSafe(F.col("found"))).alias("mismatches"))


def empty_encoding(ids: list[int]) -> str:
    """empty ([]), padding (zeros only), or an error at the first other id."""
    first = next((i for i, x in enumerate(ids) if x), None)
    if first is not None:
        raise ValueError(f"an id at {first} for an empty input")
    return "padding" if ids else "empty"


def same_empty_encoding(inference: list[int], evaluation: list[int]) -> bool:
    return (empty_encoding(inference), len(inference)) == (empty_encoding(evaluation), len(evaluation))


def allotted(remaining: float, candidates: int, fixed: float | None = None, most: float = 3600.0) -> float:
    """Seconds for the next candidate: an even share of what remains, or a fixed time, within what remains and the cap."""
    if candidates <= 0 or remaining <= 0:
        return 0.0
    return min(most, remaining, remaining / candidates if fixed is None else fixed)

