"""Byte-level tokens and chat sequences from a tokenizer file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

MOST_BYTES = 262_144


def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(path: str, most_bytes: int = MOST_BYTES) -> Callable[[Column], Column]:
    """A function of a text column: its ids, the tokenizer loaded once a task; null for texts over the limit."""

    @pandas_udf(ArrayType(IntegerType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _load(path)
        for texts in parts:
            yield texts.map(lambda t: None if len(t.encode()) > most_bytes else tokenizer.encode(t, add_special_tokens=False).ids, na_action="ignore")

    return run


def chat_ids(path: str, start_token: str, end_token: str) -> Callable[[Column, Column, Column], Column]:
    """A function of system, user and assistant texts: start role content end, a line feed after each; without an assistant text its head alone."""

    @pandas_udf(ArrayType(IntegerType()))
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokenizer = _load(path)
        start, end = tokenizer.token_to_id(start_token), tokenizer.token_to_id(end_token)
        if start is None or end is None:
            raise ValueError("the tokenizer lacks the chat tokens")
        ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

        def one(system: str, user: str, assistant: str | None) -> list[int] | None:
            turns = [("system", system), ("user", user), *([("assistant", assistant)] if isinstance(assistant, str) else [])]
            if any(not isinstance(t, str) for _, t in turns) or any(len(f"{r}\n{t}".encode()) > MOST_BYTES for r, t in turns):
                return None
            out = []
            for role, content in turns:
                out += [start, *ids(f"{role}\n{content}"), end, *ids("\n")]
            return out if isinstance(assistant, str) else [*out, start, *ids("assistant\n")]

        for system, user, assistant in parts:
            yield pd.Series([one(*row) for row in zip(system, user, assistant, strict=True)])

    return run
