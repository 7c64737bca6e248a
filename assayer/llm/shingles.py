"""Words and word shingles of whole texts, as hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .arrow import sums, words_of

BASE = 0x9E3779B97F4A7C15


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, which of them each word of all texts is, and where each text starts (and the last ends).

    A word is what stands between white space, in lower case and without anything but
    letters and digits; what has neither is no word. Null texts have no words.
    """
    clean = pc.replace_substring_regex(pc.fill_null(texts, ""), "[\t\x0b\x0c\r\xa0]", " ")
    chunks, at, bounds = words_of(clean)
    lower = pc.utf8_lower(chunks)
    odd = pc.invert(pc.utf8_is_alpha(lower))
    bare = pc.replace_with_mask(lower, odd, pc.replace_substring_regex(lower.filter(odd), r"[^\p{L}\p{N}]+", ""))
    names = bare.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in names], np.uint64)
    keep = np.array([bool(w) for w in names], bool)[at] if len(at) else np.zeros(0, bool)
    return hashes, at[keep], np.concatenate([[0], np.cumsum(sums(keep.astype(np.int64), bounds))])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text starts (and the last ends)."""
    hashes, codes, bounds = word_codes(texts)
    return hashes[codes], bounds


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words; it does not see where texts end."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(BASE) + words[j : j + n]
    return mixed(total)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of one text: its runs of `size` words, or all of its words if it has fewer."""
    return windows(words, min(size, len(words))) if len(words) else np.zeros(0, np.uint64)


def by_text(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text and how often it has them."""
    runs = windows(words, size)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = runs[low : high - size + 1] if high - low >= size else shingles(words[low:high], size)
        yield np.unique(own, return_counts=True)
