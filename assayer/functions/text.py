"""Text functions. Two whitespace rules exist and are kept apart: `collapsed` and `normalised`."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: What str.split() takes for white space, and the four separators that only `normalised` does.
UNICODE_RULE = "nfkc_ws"


def collapsed(text: Column) -> Column:
    """Unicode white space runs as one blank, ends trimmed; no other normalisation."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def is_empty_after_normalising(text: Column) -> Column:
    return text.rlike(r"(?U)^[\s\x1c-\x1f]*$")


def normalise(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


@pandas_udf(StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """NFKC, then white space runs (with U+001C to U+001F) as one blank, ends trimmed."""
    return texts.map(normalise, na_action="ignore")


def byte_ids(most: int) -> Column:
    """A function of a normalised text: its UTF-8 bytes plus one, at most `most` of them; [0] if there are none."""

    @pandas_udf(ArrayType(IntegerType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: np.frombuffer(t.encode()[:most], np.uint8).astype(np.int32) + 1 if t else np.zeros(1, np.int32), na_action="ignore")

    return encode


def ngram_keys(ids: Column, n: int) -> Column:
    """Keys of the runs of n byte ids, packed in base 257; runs that hold padding (0) are left out."""
    grams = F.when(F.size(ids) >= n, F.transform(F.sequence(F.lit(1), F.size(ids) - (n - 1)), lambda i: F.slice(ids, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<array<int>>)"))
    full = F.filter(grams, lambda g: ~F.array_contains(g, 0))
    return F.transform(full, lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda acc, b: acc * 257 + b))


def packed_ngrams(ids: Column, n: int) -> Column:
    """Keys of the runs of n byte ids (1 to 256), a byte for each id less one; runs with another id are left out. n is at most 8."""
    grams = F.when(F.size(ids) >= n, F.transform(F.sequence(F.lit(1), F.size(ids) - (n - 1)), lambda i: F.slice(ids, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<array<int>>)"))
    full = F.filter(grams, lambda g: F.forall(g, lambda b: b.between(1, 256)))
    return F.transform(full, lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 8).bitwiseOR((b - 1).cast("bigint"))))


#: Fixed pattern of the byte-level tokenizers' first cut.
PRE_TOKENS = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def pre_tokens(text: Column) -> Column:
    """The pieces of a text, in order, whose joined text is the text again; normalise before if the tokenizer does."""
    return F.regexp_extract_all(text, F.lit(f"(?U){PRE_TOKENS}"), F.lit(0))
