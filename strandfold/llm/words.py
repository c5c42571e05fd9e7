"""Words, shingles and MinHash signatures of Arrow text columns, vectorised over their bytes.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z. Words and
shingles are 64-bit codes: sums of random byte values times powers of an odd number, mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE = 5
EMPTY = np.empty(0, np.uint64)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BYTE[~_IS_WORD] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit sways every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def release() -> None:
    """Gives freed memory back to the system: a worker lives on for the next stage, beside others on its machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and the n + 1 offsets of its texts in them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together (one text may be longer)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; none reaches over the end of a text."""
    word = _IS_WORD[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(word), np.empty_like(word)
    before[:1], after[-1:] = False, False
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def codes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The 64-bit code of every word."""
    if not len(starts):
        return EMPTY
    longest = int((np.append(starts[1:], len(body)) - starts).max())
    power = np.full(longest, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sizes = np.diff(starts, append=len(body))
    place = np.arange(starts[0], len(body)) - np.repeat(starts, sizes)
    values = (_LOWER if lower else _BYTE)[body[starts[0] :]] * power[place]
    return mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64) * _BASE)


def word_codes(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, codes of their words, n + 1 bounds of the texts among the codes), chunk by chunk."""
    body, offsets = raw(texts)
    for lo, hi in chunks(offsets):
        part, at = body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends = spans(part, at)
        yield lo, hi, codes(part, starts, ends, lower), np.searchsorted(starts, at)


def shingle_sets(words: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of five words; of fewer words, the whole sequence is one."""
    n = max(0, len(words) - SHINGLE + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        rolled += mix(words[j : j + n] + _PLACE[j])
        rolled *= _BASE
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(mix(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for j in range(b - a):
                whole = (whole + mix(words[a + j : a + j + 1] ^ _PLACE[j])) * _BASE
            yield mix(whole + np.array([b - a], np.uint64))
        else:
            yield EMPTY


class MinHash:
    """Least values of a set under n universal hash functions x -> (a x + b) mod 2^64, each mixed down to 32 bits."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.n = n
        self.a = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)[:, None]

    def __call__(self, items: np.ndarray, block: int = 1024) -> np.ndarray:
        """uint32 signature; all empty sets have the same."""
        least = np.full(self.n, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(items), block):
            values = items[None, i : i + block] * self.a
            values += self.b
            np.minimum(least, values.min(axis=1), out=least)
        return (mix(least) >> np.uint64(32)).astype(np.uint32)
