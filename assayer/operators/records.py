"""Stored records against what they were made from: recompute and compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontools import canonical_sha256
from .compare import paired_counts, paired_test
from .evaluation import totals

#: What binds an evaluation's record to its files.
BOUND = ("predictions_sha256", "evaluation_sha256", "evaluation_bytes", "definition_sha256")


def unbound(record: Mapping[str, Any], found: Mapping[str, Any], names: Sequence[str] = BOUND) -> list[str]:
    """Names that the record lacks or that differ from what was found."""
    return [n for n in names if record.get(n) is None or record.get(n) != found.get(n)]


def same_request(stored: Mapping[str, Any], rebuilt: Mapping[str, Any]) -> bool:
    """Whether a stored request is the one that the data gives again, in canonical form."""
    return canonical_sha256(dict(stored)) == canonical_sha256(dict(rebuilt))


def comparison_differs(record: Mapping[str, Any], pairs: DataFrame, required: int = 0) -> list[str]:
    """Names of a stored comparison (only_a, only_b, n, p_value, verdict) that differ from a new one over pairs (candidate, baseline)."""
    found = paired_test(paired_counts(pairs), required).first().asDict()
    same = lambda a, b: a is not None and (abs(a - b) <= 1e-9 if isinstance(b, float) else a == b)
    return [n for n in ("only_a", "only_b", "n", "p_value", "verdict") if not same(record.get(n), found[n])]


def evaluation_differs(record: Mapping[str, Any], outcomes: DataFrame, found: Mapping[str, Any], applied: bool) -> list[str]:
    """What is wrong with a stored evaluation: its binding, its counts, and `not_applied` if the ledger has no completion of it."""
    counted = totals(outcomes).first().asDict()
    wrong = unbound(record, found) + [n for n in ("n", "n_correct", "n_abstain", "n_error", "n_invalid") if record.get(n) != counted[n]]
    return wrong if applied else [*wrong, "not_applied"]


def repeated(candidates: DataFrame, name_col: str = "candidate") -> DataFrame:
    """(candidate, n) of names that occur more than once."""
    return candidates.groupBy(F.col(name_col).alias("candidate")).agg(F.count("*").alias("n")).where("n > 1")


def search_problems(candidates: Sequence[str], outputs: Sequence[str], gold_ids: DataFrame, split_digest: str, frozen_digest: str) -> list[str]:
    """Why a search must not start: no or repeated candidates, outputs that are shared or lie in each other, gold ids that are empty or repeat, another split than the frozen one."""
    problems = []
    if not candidates or any(not c for c in candidates) or len(set(candidates)) != len(candidates):
        problems.append("candidates")
    folders = sorted(o.rstrip("/") + "/" for o in outputs)
    if len(outputs) != len(candidates) or any(b.startswith(a) for a, b in zip(folders, folders[1:], strict=False)):
        problems.append("outputs")
    seen = gold_ids.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("ids"), F.max("n").alias("most"), F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("bad")).first()
    if not seen["ids"] or seen["most"] > 1 or seen["bad"]:
        problems.append("gold")
    return [*problems, "split"] if split_digest != frozen_digest else problems
