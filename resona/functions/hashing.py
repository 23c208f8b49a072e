"""Words of UTF-8 text as 64-bit hashes, computed for a whole Arrow column at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
LONG = 64
SLICE = 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=8)
def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and those of its inverse."""
    base = int(np.random.default_rng(seed).integers(1 << 40, 1 << 62)) | 5
    up, down = np.ones(n, U), np.ones(n, U)
    up[1:], down[1:] = U(base), U(pow(base, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=8)
def byte_values(seed: int, fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; fold: capital ASCII letters count as small ones."""
    values = np.random.default_rng(seed + 1000).integers(0, 1 << 63, 256).astype(U)
    if fold:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=4)
def separators(kind: str) -> np.ndarray:
    """space: the six ASCII white-space bytes. letters: all ASCII bytes but letters and digits. symbols: all bytes but visible ASCII ones that are neither."""
    out = np.zeros(256, bool)
    if kind == "space":
        out[list(SPACE)] = True
    elif kind == "symbols":
        out[:] = [i <= 32 or i >= 127 or chr(i).isalnum() for i in range(256)]
    else:
        out[:128] = [not chr(i).isalnum() for i in range(128)]
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of words before it (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators(kind)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial for short words, xxh3 for those over LONG bytes."""
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    values, (up, down) = byte_values(seed, fold), powers(seed, SLICE + LONG)
    size = ends - starts
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(starts, base + SLICE)))
        end = min(int(ends[hi - 1]), base + SLICE + LONG)
        sums = np.zeros(end - base + 1, U)
        np.cumsum(values[data[base:end]] * up[: end - base], out=sums[1:])
        a, b = starts[lo:hi] - base, np.minimum(ends[lo:hi], end) - base
        out[lo:hi] = (sums[b] - sums[a]) * down[a]
        lo = hi
    out = mix(out + size.astype(U) * U(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(size > LONG):
        word = data[starts[i] : ends[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if fold else word, seed=seed)
    return out


def window_hashes(words: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` words (len(words) - width + 1 of them, document ends not heeded)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    up, down = powers(seed, SLICE + width)
    for lo in range(0, n, SLICE):
        part = words[lo : lo + SLICE + width - 1]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        got = sums[width:] - sums[:-width]
        out[lo : lo + len(got)] = got * down[: len(got)]
    return mix(out)


def in_one_document(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, and the document of each."""
    n = np.maximum(np.diff(bounds) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return bounds[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n), doc


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Cuts a column into runs of documents of about `most` bytes: pairs of indices."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi
