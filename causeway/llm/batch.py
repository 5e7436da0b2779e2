"""Vectorised work on batches of UTF-8 texts: word cuts, hashes, dictionaries and ragged gathers.

A batch is ``(data, offsets)``: the texts' bytes one after another as ``uint8`` and ``n + 1`` offsets.
A null text is an empty one here. Everything runs over whole texts; nothing is cut off.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: ASCII white space, the separators of the plain word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Separators of the lower-cased word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 1 << 16


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunks at all
        column = pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without separators, and the number of words before each text (n + 1)."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        head, tail = offsets[:-1][full], offsets[1:][full] - 1
        first[head], last[tail] = inside[head], inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) of ragged rows of these lengths, and each element's place within its row."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    return offs, np.arange(offs[-1]) - np.repeat(offs[:-1], lengths)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[starts[i] : starts[i] + lengths[i]]`` one after another, and their offsets."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    total = int(offs[-1])
    shift = np.asarray(starts, np.int64) - offs[:-1]
    if total <= _BLOCK:
        at = np.repeat(shift, lengths)
        at += np.arange(total)
        return values[at], offs
    out = np.empty(total, values.dtype)  # in blocks, as places take eight bytes each
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + _BLOCK, side="right")) - 1)
        lo, hi = int(offs[i]), int(offs[j])
        if j == i + 1:
            out[lo:hi] = values[starts[i] : starts[i] + lengths[i]]
        else:
            at = np.repeat(shift[i:j], lengths[i:j])
            at += np.arange(lo, hi)
            out[lo:hi] = values[at]
        i = j
    return out, offs


_BLOCK = 1 << 19


@lru_cache(1)
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def trim() -> None:
    """Gives memory that is free back to the system: Python workers stay, and what one stage needed isn't there for the next."""
    pa.default_memory_pool().release_unused()
    if (give := _libc()) is not None:
        give(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), _ODD, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices, equal for equal slices wherever they lie."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    for long in np.flatnonzero(lengths > _LONG_WORD):  # so the table of powers stays small
        import xxhash

        out[long] = xxhash.xxh64_intdigest(data[starts[long] : ends[long]].tobytes())
    short = lengths <= _LONG_WORD
    every = short.all()
    s, n = (starts, lengths) if every else (starts[short], lengths[short])
    got = np.empty(len(s), np.uint64)
    step = 1 << 17
    for i in range(0, len(s), step):  # in blocks, as the arrays below take 24 bytes a byte
        a, b = s[i : i + step], n[i : i + step]
        x, offs = gather(data, a, b)
        place = np.arange(len(x)) - np.repeat(offs[:-1], b)
        v = (x.astype(np.uint64) + np.uint64(1)) * _powers(int(b.max(initial=0)) + 1)[place]
        full = b > 0
        h = np.zeros(len(b), np.uint64)
        if full.any():
            h[full] = np.add.reduceat(v, offs[:-1][full])
        got[i : i + step] = mix(h ^ (b.astype(np.uint64) * _ODD))
    if every:
        return got
    out[short] = got
    return out


def windows(word_hashes: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie in one text, and where each starts (as a word index)."""
    total = len(word_hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(total, np.uint64)
    for j in range(n):
        acc *= _ODD
        acc += word_hashes[j : j + total]
    ok = np.ones(total, bool)
    for_text = np.diff(word_offsets)
    # the last n - 1 words of each text start no window in it
    tails, offs = gather(np.arange(len(word_hashes)), word_offsets[1:] - np.minimum(for_text, n - 1), np.minimum(for_text, n - 1))
    ok[tails[tails < total]] = False
    at = np.flatnonzero(ok)
    return mix(acc[at]), at


def binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte slices as an Arrow binary array."""
    x, offs = gather(data, starts, ends - starts)
    return from_parts(x, offs)


def from_parts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if len(offsets) == 1:
        return pa.array([], pa.large_binary())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values, in order of first appearance."""
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary
