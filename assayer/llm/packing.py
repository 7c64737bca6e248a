"""Sequence packing by best-fit decreasing.

A document's ids are the tokenizer's ids and one end id. Documents longer than a
window are first cut into full windows; what is left of each is packed, longest
first, into the open window whose free space is the smallest that still holds it.
A segment tree over the free capacities finds that window in O(log window).

Packing needs only lengths, so tokens never leave the task that made them: the
scan emits one small row per piece (with the checksum of its ids), which is written
with its place. Full windows are sequences as they are; the other pieces are dealt by
the hash of their place, so that repeated rows spread like all others, into groups of
a bounded expected size, packed one group per task. Sequence ids are even for packed
windows, by group, and odd for full ones, by place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, take
from .common import settle

#: How the tokenizer splits lower-cased text into words.
WORD = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
#: Chunks of these characters only are normal forms already, and lower-casing does what the tokenizer does.
PLAIN = r"^[!-~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}]+$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that the vocabulary writes for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(shown)))
    return table


class TextEncoder:
    """Ids of whole texts.

    No merge of the vocabulary crosses a space or a line feed, so a text's ids are
    those of its chunks in order, and each distinct chunk of a slice is encoded once.
    Chunks of plain characters share the ids of their words in the same way; words go
    straight to the model. All else goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        ids: list[int] = []
        lengths = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            got = tokenize(word) if word else ()
            lengths[i] = len(got)
            ids += [t.id for t in got]
        return np.array(ids, np.uint32), lengths

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, "<|"))
        easy = pc.utf8_lower(chunks.filter(plain))
        letters = pc.utf8_is_alpha(easy)
        spaced = pc.replace_with_mask(easy, pc.invert(letters), pc.replace_substring_regex(easy.filter(pc.invert(letters)), WORD, r"\1 "))
        split = pc.split_pattern(spaced, " ")
        coded = split.values.dictionary_encode()
        flat, lengths = take(*self._words(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False))
        ends, bounds = np.concatenate([[0], np.cumsum(lengths)]), split.offsets.to_numpy()
        easy_lengths = np.diff(ends[bounds])
        hard = [g.ids for g in self.tokenizer.encode_batch_fast(chunks.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        lengths = np.concatenate([easy_lengths, np.array([len(g) for g in hard], np.int64)])
        flat = np.concatenate([flat, np.array([i for g in hard for i in g], np.uint32)])
        mask = plain.to_numpy(zero_copy_only=False)
        at = np.empty(len(mask), np.int64)
        at[mask], at[~mask] = np.arange(mask.sum()), mask.sum() + np.arange((~mask).sum())
        return take(flat, lengths, at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and how many each text has; null texts count as empty."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.values.dictionary_encode()
        flat, lengths = take(*self._chunks(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        ends, bounds = np.concatenate([[0], np.cumsum(lengths)]), split.offsets.to_numpy()
        return flat, np.diff(ends[bounds])


def cut(df: DataFrame, id_col: str, text_col: str, window: int, tokenizer_path: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, place (the piece's number) and, if asked for, the ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = TextEncoder(tokenizer_path), np.array([end_id], np.uint32)
        place = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1):
                flat, lengths = encoder.encode(part.column(1))
                doc, start, length, crc, total, ids = [], [], [], [], [], []
                low = 0
                for key, n in zip(part.column(0).to_pylist(), lengths.tolist(), strict=True):
                    own = np.concatenate([flat[low : low + n], end])
                    low += n
                    for at in range(0, n + 1, window):
                        piece = own[at : at + window]
                        doc.append(key)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.astype("<u4", copy=False)))
                        total.append(n + 1)
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, range(place, place + len(doc)))]
                place += len(doc)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class Capacities:
    """Segment tree over the capacities 0..window; a leaf says how many open windows have it left."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1 - 1).bit_length() if window else 1
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity >= need that an open window has, or -1."""
        tree, at = self.tree, need + self.size
        if tree[at]:
            return need
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; lengths are at most window and given longest first."""
    tree, open_windows = Capacities(window), [[] for _ in range(window + 1)]
    number, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, need in enumerate(lengths.tolist()):
        capacity = tree.tightest(need)
        if capacity < 0:
            capacity, at = window, used
            used += 1
        else:
            at = open_windows[capacity].pop()
            tree.add(capacity, -1)
        number[i], offset[i] = at, window - capacity
        if left := capacity - need:
            open_windows[left].append(at)
            tree.add(left, 1)
    return number, offset


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    tokenizer_path: str | None = None,
    end_id: int = 1,
    group_rows: int = 8192,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every row's text into sequences of at most `window` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, before these two). A null text counts as empty: its one
    piece is the end id. A very long text is cut into full windows and a rest. A repeated
    row is packed as often as it occurs. A null id is kept as a null id. An empty table gives no rows. Columns of df other than the two named are
    not read, so that their names cannot clash. `group_rows` is the number of
    documents that are packed together: more rows give less padding and larger tasks.
    """
    pieces = settle(cut(df, id_col, text_col, window, tokenizer_path or default_tokenizer(), end_id, with_ids))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    rest = pieces.where(F.col("length") < window)
    groups = max(1, math.ceil(rest.count() / group_rows))
    types = dict(pieces.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in columns], "sequence_id long, offset long"])

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "place"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        number, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows[columns].assign(sequence_id=2 * (number * groups + int(key[0])), offset=offset)

    full = pieces.where(F.col("length") >= window).select(*columns, (2 * F.col("place") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = rest.withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(groups))).groupBy("grp").applyInPandas(place, schema)
    return packed.select(*columns, "sequence_id", "offset").unionByName(full)
