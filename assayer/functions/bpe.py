"""Byte-pair encoding of the repository's own: bytes as letters, pieces merged by rank."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from .text import PRE_TOKENS
from .tokenize import MOST_BYTES


@lru_cache(maxsize=1)
def byte_letters() -> tuple[str, ...]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in printable else chr(next(spare)) for b in range(256))


class Encoder:
    """Ids of texts by a vocabulary (letters of bytes to ids) and merges, the first of which come first."""

    def __init__(self, vocabulary: dict[str, int], merges: Sequence[tuple[str, str]], pattern: str = PRE_TOKENS, nfc: bool = True):
        self.vocabulary, self.ranks, self.nfc = vocabulary, {pair: rank for rank, pair in enumerate(merges)}, nfc
        self.pattern = regex.compile(pattern)

    @staticmethod
    def from_json(data: str) -> Encoder:
        """From a tokenizer file with a byte-level model."""
        model = json.loads(data)["model"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return Encoder(model["vocab"], merges)

    def pieces(self, text: str) -> list[str]:
        """The text's pieces before any merge; what the pattern leaves out is a piece, too."""
        text = unicodedata.normalize("NFC", text) if self.nfc else text
        out, at = [], 0
        for m in self.pattern.finditer(text):
            if m.start() > at:
                out.append(text[at : m.start()])
            if m.end() > m.start():
                out.append(m[0])
            at = m.end()
        return out + [text[at:]] * (at < len(text))

    def merged(self, piece: str) -> list[int]:
        letters = byte_letters()
        parts = [letters[b] for b in piece.encode()]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocabulary[p] for p in parts]

    def encode(self, text: str) -> list[int]:
        known: dict[str, list[int]] = {}
        out: list[int] = []
        for piece in self.pieces(text):
            if piece not in known:
                known[piece] = self.merged(piece)
            out += known[piece]
        return out


def encoded(encoder: Encoder, most_bytes: int = MOST_BYTES) -> Callable[[Column], Column]:
    """A function of a text column: its ids; null for texts over the limit."""

    @pandas_udf(ArrayType(IntegerType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if len(t.encode()) > most_bytes else encoder.encode(t), na_action="ignore")

    return run
