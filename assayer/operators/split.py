"""Reproducible splits: whole groups, stratified by label."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import rows_digest
from .quality import group_labels

SPLITS = ("train", "validation", "test")
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Ratios:
    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1

    def __post_init__(self) -> None:
        shares = (self.train, self.validation, self.test)
        if not all(0 <= x <= 1 for x in shares) or abs(sum(shares) - 1) > 1e-9:
            raise ValueError("ratios must lie in 0..1 and add up to 1")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a; its offset basis and prime are fixed values."""
    out = 0xCBF29CE484222325
    for b in data:
        out = (out ^ b) * 0x100000001B3 & _MASK
    return out


class SplitMix64:
    """The public splitmix64 generator; its increment and multipliers are fixed values."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _MASK
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        return z ^ z >> 31


def label_seed(seed: int, label: str) -> int:
    return SplitMix64(seed ^ fnv1a(label.encode())).next()


def allocate(n: int, ratios: Ratios) -> tuple[int, int, int]:
    """Groups for train, validation and test out of n.

    Shares are rounded down; validation gets one at least if it has a share, test takes
    the rest, one at least if train can spare it. Without a share for test its rest goes
    to train, or to validation if train has none. One or two groups go to the largest
    shares, equal ones in the order train, test, validation.
    """
    shares = {"train": ratios.train, "validation": ratios.validation, "test": ratios.test}
    if n <= 2:
        order = sorted((s for s in SPLITS if shares[s] > 0), key=lambda s: (-shares[s], ("train", "test", "validation").index(s)))
        got = dict.fromkeys(SPLITS, 0)
        for slot in range(n):
            got[order[min(slot, len(order) - 1)]] += 1
        return got["train"], got["validation"], got["test"]
    validation = min(n, max(1, int(n * ratios.validation))) if ratios.validation > 0 else 0
    train = min(int(n * ratios.train), n - validation)
    test = n - train - validation
    if ratios.test > 0 and not test and train:
        train, test = train - 1, 1
    if ratios.test == 0:
        train, validation, test = (train + test, validation, 0) if ratios.train > 0 else (train, validation + test, 0)
    return train, validation, test


def split_groups(records: DataFrame, seed: int, ratios: Ratios = Ratios(), group_col: str = "group_id", label_col: str = "label") -> DataFrame:  # noqa: B008
    """(group_id, label, split) of every group, by its most frequent label.

    The rule shuffles the sorted groups of a label with a generator of its own, so the
    groups of one label (not its records) meet in one task.
    """

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        label = rows["label"].iloc[0]
        groups = sorted(rows["group_id"], key=str.encode)
        draw = SplitMix64(label_seed(seed, label))
        for i in range(len(groups) - 1, 0, -1):
            j = draw.next() % (i + 1)
            groups[i], groups[j] = groups[j], groups[i]
        train, validation, _ = allocate(len(groups), ratios)
        names = ["train"] * train + ["validation"] * validation + ["test"] * (len(groups) - train - validation)
        return pd.DataFrame({"group_id": groups, "label": label, "split": names})

    return group_labels(records, group_col, label_col).groupBy("label").applyInPandas(deal, "group_id string, label string, split string")


def split_by_hash(records: DataFrame, seed: int, ratios: Ratios = Ratios(), group_col: str = "group_id") -> DataFrame:  # noqa: B008
    """records with split, by the hash of the group alone: no shuffle, for any number of groups, with shares kept in expectation only."""
    place = F.pmod(F.xxhash64(F.lit(seed), group_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return records.withColumn("split", F.when(place < ratios.train, "train").when(place < ratios.train + ratios.validation, "validation").otherwise("test"))


def split_records(records: DataFrame, groups: DataFrame, group_col: str = "group_id") -> DataFrame:
    return records.join(groups.select(F.col("group_id").alias(group_col), "split"), group_col)


def allocations(groups: DataFrame) -> DataFrame:
    """(label, n_groups, train, validation, test) of a split."""
    return groups.groupBy("label").agg(F.count("*").alias("n_groups"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def digests(records: DataFrame, id_col: str = "id", input_col: str = "input", label_col: str = "label") -> DataFrame:
    """(split, n, digest): a digest of each split's rows that does not depend on their order."""
    return rows_digest(records, [id_col, input_col, label_col], ["split"])


def verify(records: DataFrame, manifest: dict[str, tuple[int, str]]) -> list[str]:
    """Names of splits whose rows differ from the manifest {split: (n, digest)}."""
    found = {r["split"]: (r["n"], r["digest"]) for r in digests(records).collect()}
    return sorted(s for s in found.keys() | manifest.keys() if found.get(s) != manifest.get(s))


def manifest(records: DataFrame, id_col: str = "id", input_col: str = "input", label_col: str = "label", group_col: str = "group_id") -> DataFrame:
    """(split, n, n_groups, ids, content): what a split is known by; ids is a digest of its ids, content one of its rows.

    The ids themselves stay a table, `select(id, split)` of records. ValueError if an id repeats.
    """
    if not records.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a record's id repeats")
    groups = records.select("split", group_col).distinct().groupBy("split").agg(F.count(group_col).alias("n_groups"))
    ids = rows_digest(records, [id_col], ["split"]).select("split", F.col("digest").alias("ids"))
    content = digests(records, id_col, input_col, label_col).select("split", "n", F.col("digest").alias("content"))
    return content.join(groups, "split").join(ids, "split").select("split", "n", "n_groups", "ids", "content")


def record(records: DataFrame, groups: DataFrame, seed: int, ratios: Ratios = Ratios(), **columns: str) -> dict:  # noqa: B008
    """The record of a split: its seed and ratios, the manifest of each part, and the groups allotted by label. groups: of split_groups."""
    parts = {r["split"]: {k: r[k] for k in ("n", "n_groups", "ids", "content")} for r in manifest(records, **columns).collect()}
    allotted = {r["label"]: [r[s] for s in SPLITS] for r in allocations(groups).collect()}
    return {"seed": seed, "ratios": [str(x) for x in (ratios.train, ratios.validation, ratios.test)], "splits": parts, "allocations": allotted}


def verify_record(found: dict, stored: dict) -> list[str]:
    """What differs between a record made anew and a stored one: seed, ratios, allocations, or a split with the field."""
    wrong = [k for k in ("seed", "ratios", "allocations") if found.get(k) != stored.get(k)]
    a, b = found.get("splits", {}), stored.get("splits", {})
    return wrong + [f"{s}.{k}" for s in sorted(a.keys() | b.keys()) for k in ("n", "n_groups", "ids", "content") if a.get(s, {}).get(k) != b.get(s, {}).get(k)]
