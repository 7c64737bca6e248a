"""Ragged arrays over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task takes up at once (one row at least).
SLICE_BYTES = 16 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `most` bytes in that column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, most + (ends[low - 1] if low else 0), "right")))
        yield batch.slice(low, high - low)
        pa.default_memory_pool().release_unused()  # workers live on, and with them what they do not give back
        low = high


def take(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat named by which, joined, and the length of each."""
    starts, got = np.cumsum(lengths) - lengths, lengths[which]
    return flat[np.repeat(starts[which] - (np.cumsum(got) - got), got) + np.arange(got.sum())], got


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces of the texts between spaces and line feeds, the piece at each place, and where each text starts (and the last ends)."""
    split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    coded = split.values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy().astype(np.int64)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between neighbouring bounds."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return np.diff(total[bounds])


def squeeze(values: np.ndarray) -> bytes:
    """Integers of 64 bits at most as compressed byte planes."""
    width = 4 if not len(values) or max(values.max(), -values.min()) < 2**31 else 8
    planes = np.ascontiguousarray(values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return (len(values) << 4 | width).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(planes, asbytes=True)


def expand(squeezed: bytes) -> np.ndarray:
    n, width = divmod(int.from_bytes(squeezed[:8], "little"), 16)
    planes = pa.Codec("zstd").decompress(squeezed[8:], width * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<i{width}").reshape(-1)


def squeeze_hashes(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as compressed byte planes of their differences."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(hashes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def expand_hashes(squeezed: bytes) -> np.ndarray:
    n = int.from_bytes(squeezed[:8], "little")
    planes = pa.Codec("zstd").decompress(squeezed[8:], 8 * n, asbytes=True) if n else b""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").reshape(-1), dtype=np.uint64)
