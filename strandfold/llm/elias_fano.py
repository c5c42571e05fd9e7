"""Monotone sequences in Elias-Fano form, and an n-gram trie made of them, memory-mapped.

Arrays are queried in batches: one call answers many positions or many searches.
"""

from __future__ import annotations

import tempfile

import numpy as np

_STEP = 1 << 15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1, dtype=np.uint8)  # of each byte
_PLACES = np.argsort(1 - _BITS.astype(np.int8), axis=1, kind="stable")  # of each byte's ones, in order


class EliasFano:
    """n non-decreasing values below 2^64: low bits packed side by side, high parts as a bit vector in unary."""

    def __init__(self, values: np.ndarray, bits: int):
        """values: uint64, below 2^bits."""
        self.n = n = len(values)
        self.low_bits = low = max(0, min(57, bits - max(1, n).bit_length()))
        self.highs = (1 << (bits - low)) if n else 0
        packed = [np.empty(0, np.uint8)]
        step = _STEP  # whole bytes whatever the width
        for i in range(0, n if low else 0, step):
            part = np.ascontiguousarray(values[i : i + step], "<u8").view(np.uint8).reshape(-1, 8)
            packed.append(np.packbits(np.unpackbits(part, axis=1, count=low, bitorder="little").ravel(), bitorder="little"))
        self.low = np.concatenate([*packed, np.zeros(8, np.uint8)])
        high = (values >> np.uint64(low)).astype(np.int64)
        top = int(high[-1]) + 1 if n else 0
        bit = np.zeros(-(-(n + top + 1) // 64) * 64, np.uint8)
        bit[high + np.arange(n)] = 1
        self.top = top
        self.high = np.packbits(bit, bitorder="little")
        ones = bit.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])

    def arrays(self) -> list[str]:
        return ["low", "high", "ones"]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        words = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))
        return words[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, one: int) -> np.ndarray:
        """Positions of the k-th ones (or zeros) of the high part, from 0."""
        before = self.ones if one else np.arange(len(self.ones)) * 64 - self.ones
        out = np.empty(len(k), np.int64)
        rows = self.high.reshape(-1, 8)
        for i in range(0, len(k), _STEP):
            q = k[i : i + _STEP]
            word = np.searchsorted(before, q, "right") - 1
            row = rows[word] if one else ~rows[word]
            ones = _ONES[row]
            upto = np.cumsum(ones, axis=1, dtype=np.uint8)
            rank = (q - before[word]).astype(np.uint8)
            byte = (upto > rank[:, None]).argmax(axis=1)
            each = np.arange(len(q))
            inside = rank - (upto[each, byte] - ones[each, byte])
            out[i : i + _STEP] = word * 64 + byte * 8 + _PLACES[row[each, byte], inside]
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        high = (self._select(i, 1) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the least position whose value is x or more; n if there is none."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        known = np.minimum(high, self.top)
        lo = np.where(known > 0, self._select(np.maximum(known - 1, 0), 0) - known + 1, 0) if self.n else np.zeros(len(x), np.int64)
        hi = np.where(high < self.top, self._select(np.minimum(known, max(self.top - 1, 0)), 0) - known, lo) if self.n else lo
        target = x & np.uint64((1 << self.low_bits) - 1)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < target[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo


class Level:
    """What follows each node of the level above: monotone pointers to it, keys relative to the node, 16-bit codes.

    The node's number is put above the bits of a key, which keeps the keys of the whole level monotone.
    """

    def __init__(self, each: np.ndarray, keys: np.ndarray, codes: np.ndarray, key_bits: int):
        """each: followers of every node; keys, codes: of all followers, node after node, keys ascending within a node."""
        self.key_bits = key_bits
        ends = np.concatenate([[0], np.cumsum(each)]).astype(np.uint64)
        self.pointers = EliasFano(ends, max(1, int(ends[-1]).bit_length()))
        owner = np.repeat(np.arange(len(each), dtype=np.uint64), each)
        self.keys = EliasFano(owner << np.uint64(key_bits) | keys.astype(np.uint64), max(1, len(each)).bit_length() + key_bits)
        self.codes = codes

    def find(self, node: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Positions of (node, key) in this level; -1 where unseen or where the node is -1."""
        out = np.full(len(node), -1)
        known = np.flatnonzero(node >= 0)
        above = node[known]
        wanted = above.astype(np.uint64) << np.uint64(self.key_bits) | keys[known].astype(np.uint64)
        i = self.keys.successor(wanted)
        inside = i < self.pointers[above + 1].astype(np.int64)
        known, i, wanted = known[inside], i[inside], wanted[inside]
        same = self.keys[i] == wanted
        out[known[same]] = i[same]
        return out


class Trie:
    """Words with their counts, and levels of what follows them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, levels: list[Level]):
        """words: sorted codes; counts: of each; the first level follows the words, each next one the level before it."""
        self.words, self.counts, self.levels = EliasFano(words, 64), counts, levels
        self._map()

    def _map(self) -> None:
        """Moves every level into one unnamed file of this task and maps it; it goes with the trie."""
        self.file = tempfile.TemporaryFile()
        sequences = [self.words, *(x for level in self.levels for x in (level.pointers, level.keys))]
        slots = [(x, name) for x in sequences for name in x.arrays()] + [(self, "counts"), *((level, "codes") for level in self.levels)]
        places = []
        for owner, name in slots:
            level = np.ascontiguousarray(getattr(owner, name))
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places.append((self.file.tell(), level.dtype, level.shape))
            self.file.write(level.tobytes())
        self.file.flush()
        for (owner, name), (at, dtype, shape) in zip(slots, places, strict=True):
            setattr(owner, name, np.memmap(self.file, dtype, "r", at, shape) if shape[0] else np.empty(shape, dtype))

    def find_words(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers in the first level; -1 where unknown."""
        i = self.words.successor(words)
        inside = np.flatnonzero(i < self.words.n)
        out = np.full(len(words), -1)
        same = self.words[i[inside]] == words[inside]
        out[inside[same]] = i[inside[same]]
        return out
