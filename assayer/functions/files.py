"""Checks of files before they are used: size, tensor files, vocabularies. They run on the driver, over bounded bytes."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

#: Fixed limits: bytes of a tensor file's header, entries of a vocabulary, bytes of one of its tokens.
MOST_HEADER_BYTES, MOST_ENTRIES, MOST_TOKEN_BYTES = 100_000_000, 4_194_304, 4096


def read_bounded(spark: SparkSession, path: str, most: int) -> bytes:
    """The bytes of one regular file of at most `most` bytes, wherever Spark can read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at) or not files.getFileStatus(at).isFile():
        raise ValueError("no regular file")
    if files.getFileStatus(at).getLen() > most:
        raise ValueError(f"more than {most} bytes")
    (row,) = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(row["content"])


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a key repeats")
    return dict(pairs)


def check_tensors(data: bytes) -> list[str]:
    """Names of the tensors of a file: eight bytes of length, a JSON header, and data without gaps or overlaps; ValueError if it is none."""
    size = int.from_bytes(data[:8], "little") if len(data) >= 8 else 0
    if not 2 <= size <= MOST_HEADER_BYTES or len(data) < 8 + size or data[8:9] != b"{":
        raise ValueError("header length")
    try:
        header = json.loads(data[8 : 8 + size], object_pairs_hook=_unique)
    except ValueError as e:
        raise ValueError("header") from e
    meta = header.pop("__metadata__", None)
    if meta is not None and not (isinstance(meta, dict) and all(isinstance(x, str) for x in meta.values())):
        raise ValueError("metadata")
    spans = []
    for tensor in header.values():
        span = tensor.get("data_offsets") if isinstance(tensor, dict) else None
        shape = tensor.get("shape") if isinstance(tensor, dict) else None
        whole = lambda xs: isinstance(xs, list) and all(type(x) is int and x >= 0 for x in xs)
        if not whole(span) or len(span) != 2 or span[0] > span[1] or not whole(shape) or not isinstance(tensor.get("dtype"), str):
            raise ValueError("tensor")
        spans.append(tuple(span))
    if not spans:
        raise ValueError("no tensors")
    ends = 0
    for low, high in sorted(spans):
        if low != ends:
            raise ValueError("offsets")
        ends = high
    if ends != len(data) - 8 - size:
        raise ValueError("offsets")
    return list(header)


def check_vocabulary(data: bytes, most_bytes: int = 1 << 28) -> int:
    """Entries of a vocabulary, an object from tokens to whole numbers from 0; ValueError if it is none or too large."""
    if len(data) > most_bytes:
        raise ValueError("too large")
    try:
        found = json.loads(data, object_pairs_hook=_unique)
    except (ValueError, RecursionError) as e:
        raise ValueError("no vocabulary") from e
    if not isinstance(found, dict) or not 0 < len(found) <= MOST_ENTRIES:
        raise ValueError("entries")
    if any(len(k.encode()) > MOST_TOKEN_BYTES or type(v) is not int or v < 0 for k, v in found.items()):
        raise ValueError("token")
    return len(found)


def check_tokenizer(data: bytes, most_bytes: int = 1 << 26) -> str:
    """The type of a tokenizer file's model."""
    if len(data) > most_bytes:
        raise ValueError("too large")
    try:
        kind = json.loads(data)["model"]["type"]
    except (ValueError, KeyError, TypeError, RecursionError) as e:
        raise ValueError("no tokenizer") from e
    if not isinstance(kind, str):
        raise ValueError("no tokenizer")
    return kind
