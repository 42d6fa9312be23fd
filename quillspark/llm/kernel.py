"""Vectorised text kernels: one Arrow batch of texts is treated as one byte array.

All hashes are 64 bit, modulo 2**64, over random byte codes drawn from a fixed seed, so every
worker and every run sees the same values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_rng = np.random.default_rng(20240607)
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) of every element."""
    x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts in a row, and where each text starts (one more entry: the end).
    A null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    size = off[-1] - off[0]
    raw = np.frombuffer(data, np.uint8, count=int(size), offset=int(off[0])) if size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def byte_set(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = lower_table()
WHITE = byte_set([0x20, *range(0x09, 0x0E)])


def prefix_hash(raw: np.ndarray, codes: np.ndarray = CODES) -> tuple[np.ndarray, np.ndarray]:
    """``(H, inv)``: the hash of ``raw[s:e]`` is ``(H[e] - H[s]) * inv[s]``, wherever it stands."""
    n = len(raw)
    power = np.empty(n + 1, np.uint64)
    power[0] = 1
    power[1:] = BASE
    np.cumprod(power, out=power)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[raw] * power[:n], out=h[1:])
    power[0] = 1
    power[1:] = BASE_INV
    np.cumprod(power, out=power)
    return h, power


def spans(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't separators, never across texts: starts, ends, and the
    number of the first run of each text (one more entry: how many there are)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[raw]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.concatenate(([False], inside[:-1])) & ~first[:n]
    after = np.concatenate((inside[1:], [False])) & ~first[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    h, inv = prefix_hash(raw, codes)
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


LOWER_CODES = CODES[LOWER]
SHINGLE = 5


def shingle_sets(column: pa.Array, words: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of word shingles as a sorted array of distinct 64-bit hashes. Words are
    runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text of fewer words than a shingle has
    its whole sequence as the only one; a text without words (or null) has none."""
    raw, off = batch_bytes(column)
    starts, ends, first = spans(raw, off, WHITE)
    w = span_hashes(raw, starts, ends, LOWER_CODES)
    m = len(w)
    sh = np.zeros(max(m - words + 1, 0), np.uint64)
    for k in range(words):
        sh = sh * BASE + w[k : k + len(sh)]
    sh = mix(sh, 1)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(np.unique(sh[a : b - words + 1]))
        elif b > a:
            x = U(0)
            with np.errstate(over="ignore"):
                for v in w[a:b]:
                    x = x * BASE + v
                out.append(mix(np.array([x], np.uint64), 100 + int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batches, column: str, limit: int = 2 << 20):
    """Cut Arrow batches into runs of rows whose texts hold about ``limit`` bytes, so that a
    kernel's working memory is bounded by that and the longest single text."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
