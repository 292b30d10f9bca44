"""The words of many texts at once, as arrays.

A word of at most 16 bytes is its own key: two 64-bit numbers and its length,
so short words are told apart exactly without a Python object for each. Longer
ones, few in any text, are handled one by one.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

SHORT = 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31, S32 = np.uint64(27), np.uint64(30), np.uint64(31), np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> S30) * M1
    h = (h ^ h >> S27) * M2
    return h ^ h >> S31


@cache
def parting(blanks: bytes = b" \t\n\v\f\r") -> bytes:
    """A translation that lower-cases A-Z and makes every byte of blanks a space."""
    return bytes(32 if b in blanks else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Spans:
    """start and length of each span in `joined`, which has SHORT bytes after the last; those of text i are first[i] to first[i + 1]."""

    def __init__(self, joined: bytes, start: np.ndarray, length: np.ndarray, first: np.ndarray):
        self.joined, self.start, self.length, self.first = joined, start, length, first

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first and the next eight bytes of each span as numbers, and its length."""
        eight = np.ndarray((len(self.joined) - 7,), "<u8", self.joined, 0, (1,))
        n = self.length
        one = eight[self.start] & _MASKS[np.minimum(n, 8)]
        two = np.zeros(len(n), np.uint64)
        more = np.flatnonzero(n > 8)
        two[more] = eight[self.start[more] + 8] & _MASKS[np.minimum(n[more], SHORT) - 8]
        return one, two, n

    def word(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.start[i] + self.length[i]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each span, the same in every process."""
        one, two, n = self.keys()
        h = mixed(one * A + n.astype(np.uint64) * C)
        some = np.flatnonzero(n > 8)
        h[some] = mixed(h[some] ^ mixed(two[some] * B))
        for i in np.flatnonzero(n > SHORT).tolist():
            h[i] = xxhash.xxh64_intdigest(self.word(i))
        return h


class Words(Spans):
    """The runs of bytes that `table` makes no space of."""

    def __init__(self, texts: list[bytes], table: bytes):
        joined = b" ".join(texts).translate(table) + b" " * SHORT
        raw = np.frombuffer(joined, np.uint8)
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        first = np.searchsorted(start, begins)
        first[-1] = len(start)
        super().__init__(joined, start, end - start, first)
