"""Frozen data, versions, and tests that may be applied once. Entries are files that are created and never changed."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import rows_digest
from ..functions.jsontools import canonical, canonical_sha256


def content_record(spark: SparkSession, path: str) -> dict[str, Any]:
    """Digest, byte length and number of the files under path, by their paths below it; read where they lie."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(at).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.element_at(F.split("path", root, 2), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")
    found = rows_digest(rows, ["name", "sha256", "length"]).first()
    size = rows.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0
    return {"sha256": found["digest"] if found else canonical_sha256([]), "bytes": size, "n_files": found["n"] if found else 0}


def gate(frozen: dict[str, Any] | None, found: dict[str, Any] | None) -> str:
    """skip without frozen and found data, run if they are equal; all else is an error."""
    if frozen is None and found is None:
        return "skip"
    if frozen is None or found is None or frozen["sha256"] != found["sha256"]:
        raise ValueError("the data is not what was frozen")
    return "run"


def unchanged(spark: SparkSession, path: str, run: Callable[[], Any]) -> Any:
    """run(), with the content under path the same before and after."""
    before = content_record(spark, path)
    out = run()
    if content_record(spark, path) != before:
        raise ValueError("the data changed while it was used")
    return out


class Ledger:
    """Create-only entries in a folder that all share (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, name: str, entry: dict[str, Any]) -> bool:
        """Writes the entry under the name; False, and nothing changed, if there is one already."""
        at = self._paths(f"{self.folder}/{name}.json")
        if self._files.exists(at):
            return False
        self._files.mkdirs(at.getParent())
        try:
            out = self._files.create(at, False)
        except Exception:
            if self._files.exists(at):
                return False
            raise
        out.write(bytearray(canonical(entry).encode()))
        out.close()
        return True

    def read(self, name: str) -> dict[str, Any] | None:
        at = self._paths(f"{self.folder}/{name}.json")
        if not self._files.exists(at):
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(at.toString(), wholetext=True).collect()))

    def entries(self) -> DataFrame:
        return self.spark.read.text(f"{self.folder}/*.json", wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "").alias("name"), F.col("value").alias("entry"))

    def record_version(self, kind: str, number: int, sha256: str) -> None:
        if not self.create(f"{kind}-v{number}", {"kind": kind, "number": number, "sha256": sha256}):
            raise ValueError("this version is recorded already")

    def may_roll_back_to(self, kind: str, number: int, sha256: str) -> bool:
        found = self.read(f"{kind}-v{number}")
        return found is not None and found["sha256"] == sha256

    def apply_once(self, key: dict[str, Any], run: Callable[[], dict[str, Any]]) -> dict[str, Any]:
        """run() under a right that is used up before it starts; its outcome is recorded after."""
        name = canonical_sha256(key)
        if not self.create(f"applied-{name}", key):
            raise ValueError("the test was applied before")
        out = run()
        self.create(f"done-{name}", out)
        return out
