"""Strict JSON, in columns and on the driver."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType


def line_class(raw: Column) -> Column:
    """object, malformed_json, malformed_record or duplicate_key, from how the strict and the lenient parser disagree."""
    strict, lenient = F.try_parse_json(raw), F.from_json(raw, "map<string,string>")
    return F.when(strict.isNull() & lenient.isNotNull(), "duplicate_key").when(strict.isNull(), "malformed_json").when(F.schema_of_variant(strict).startswith("OBJECT<"), "object").otherwise("malformed_record")


def type_name(variant: Column, path: str) -> Column:
    """null, bool, number, string, array or object at the path; null (the column's) if there is nothing."""
    kind = F.schema_of_variant(F.variant_get(variant, path, "variant"))
    return (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY<"), "array")
        .when(kind.startswith("OBJECT<"), "object")
        .otherwise("number")
    )


def canonical(value: Any) -> str:
    """Sorted keys, no blanks, integers only."""

    def check(x: Any) -> None:
        if isinstance(x, float):
            raise ValueError("a canonical document holds no floating-point number")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_sha256(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def renderings(value: Any) -> list[str]:
    """The distinct ways a JSON value may be written into a text: compact or spaced, keys as given or sorted."""
    out = [json.dumps(value, separators=sep, sort_keys=order, ensure_ascii=False) for order in (False, True) for sep in ((",", ":"), (", ", ": "))]
    return [x for x in dict.fromkeys(out) if x not in ("", "{}", "null")]


@pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """Each JSON text in canonical form; null if it is none, or holds a floating-point number."""

    def one(text: str) -> str | None:
        try:
            return canonical(json.loads(text))
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def answer_needles(texts: pd.Series) -> pd.Series:
    """The ways in which an answer, JSON, may stand in a text: the answer, and its arguments if it has some, in all renderings; a text that is no JSON stands for itself."""

    def one(text: str) -> list[str]:
        try:
            value = json.loads(text)
        except ValueError:
            return [text] if text else []
        own = value.get("arguments") if isinstance(value, dict) else None
        return [x for y in (value, *([own] if isinstance(own, dict) and own else [])) for x in renderings(y)]

    return texts.map(one, na_action="ignore")


def value_or_text(captured: Column) -> Column:
    """Captured output as a variant: the JSON it is, else the text itself."""
    return F.coalesce(F.try_parse_json(captured), F.to_variant_object(F.struct(captured.alias("text"))))


def salted_digest(salt: str, text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, length)


def shards_digest(domain: str, parts: list[bytes]) -> str:
    """A digest of weights and their shards that no other list of parts has: each length stands before its bytes."""
    h = hashlib.sha256(domain.encode() + b"\x00")
    for part in parts:
        h.update(len(part).to_bytes(8, "big"))
        h.update(part)
    return h.hexdigest()
