"""Words, shingles and windows of whole Arrow batches as 64-bit hashes, with NumPy.

Words are the maximal runs of bytes other than space and 9 to 13, as in ``[^\\x20\\x09-\\x0D]+``. A word's hash is a
polynomial of its bytes modulo 2**64, taken from one running sum over the batch and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bases of the polynomials (odd, so that they have inverses) and the multipliers of the mixer.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
MIX_1, MIX_2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: Bytes of text worked on at once; a longer document is worked on alone.
SLICE_BYTES = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; a bijection."""
    x = x ^ (x >> U(33))
    x = x * MIX_1
    x = x ^ (x >> U(33))
    x = x * MIX_2
    return x ^ (x >> U(33))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept up to the usual slice."""
    had = _powers.get(base)
    if had is None or len(had[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        had = (both[0], both[1])
        if size <= 4 * SLICE_BYTES:
            _powers[base] = had
    return had[0][:n], had[1][:n]


def window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each s, e."""
    p, inverse = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a slice of texts: ``hashes``, byte ``starts`` and ``ends`` in ``data``, and ``ptr``: row r has the
    words ptr[r] to ptr[r + 1] - 1. Null texts have none."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if lower:
            data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        n = len(data)
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        row = np.zeros(n + 1, dtype=bool)
        row[offsets] = True
        row[n] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        self.data = data
        self.starts = np.flatnonzero(word & (~before | row[:n]))
        self.ends = np.flatnonzero(word & (~after | row[1:])) + 1
        self.ptr = np.searchsorted(self.starts, offsets)
        self.hashes = window_hashes(_BYTES[data], self.starts, self.ends, BYTE_BASE)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most ``limit`` bytes of text or one row."""
    col = batch.column(batch.schema.get_field_index(text)).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of k consecutive words; fewer words make one shingle, none make none."""
    n = len(words.hashes)
    full = window_hashes(words.hashes, np.arange(max(0, n - k + 1)), np.arange(max(0, n - k + 1)) + k, WORD_BASE) if n >= k else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(words.hashes[a:b], np.array([0]), np.array([b - a]), WORD_BASE))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ragged(arrays: list[np.ndarray], kind: pa.DataType | None = None) -> pa.Array:
    """A list array of the arrays; 64-bit hashes are kept as signed."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    values = pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat)
    if ends[-1] < 2**31:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values)
