"""Covering codes for 64-bit fingerprints, and the anchors to which a fingerprint is replicated.

The 64 bits are cut in three parts: two of 23 bits, covered by the perfect binary Golay code (every word has one
codeword within 3), and one of 18 bits, covered by the sum of the [15, 11] Hamming code and the [3, 1] repetition
code (one codeword within 1 each). If two fingerprints differ in at most 4 bits, then in some pair of the parts
they differ in at most 2 (the three pairs count every bit twice, 8 / 3 < 3). Some word lies within 1 of both of
them there, and its nearest codewords are then within covering radius plus 1 of both. So with the codeword pairs
of two parts as anchors, and each fingerprint replicated to all anchors within the covering radius of each code
plus 1 in all, the two meet at an anchor: at most 11 + 14 + 14 replicas of 3 * 2**24 anchors.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Bits by which linked fingerprints may differ.
THRESHOLD = 4


def _remainders(generator: int, n: int) -> list[int]:
    """x**i modulo the generator polynomial, for i below n: the syndrome of each bit of a cyclic code."""
    out, x, top = [], 1, generator.bit_length() - 1
    for _ in range(n):
        out.append(x)
        x <<= 1
        if x >> top & 1:
            x ^= generator
    return out


class Code:
    """A linear code given by the syndrome of each bit; the first bits are the parity bits."""

    def __init__(self, syndromes: list[int], radius: int):
        self.n, self.radius, self.parity = len(syndromes), radius, max(syndromes).bit_length()
        near: list[list[tuple[int, int]]] = [[] for _ in range(1 << self.parity)]
        for weight in range(radius + 2):
            for bits in combinations(range(self.n), weight):
                s = e = 0
                for b in bits:
                    s, e = s ^ syndromes[b], e | 1 << b
                near[s].append((e, max(0, weight - radius)))
        if any(not x or x[0][1] for x in near):
            raise ValueError("the code has words outside its covering radius")
        most = max(map(len, near))
        #: By syndrome: the differences to the codewords within radius + 1, and how far each is beyond the radius (9: none).
        self.errors = np.zeros((len(near), most), dtype=np.uint32)
        self.excess = np.full((len(near), most), 9, dtype=np.uint8)
        for s, found in enumerate(near):
            for k, (e, x) in enumerate(found):
                self.errors[s, k], self.excess[s, k] = e, x
        self.tables = []
        for shift in range(0, self.n, 8):
            t = np.zeros(256, dtype=np.uint32)
            for v in range(256):
                for b in range(min(8, self.n - shift)):
                    if v >> b & 1:
                        t[v] ^= syndromes[shift + b]
            self.tables.append(t)

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, the message numbers of the codewords within radius + 1 and their excess, padded with excess 9."""
        s = np.zeros(len(words), dtype=np.uint32)
        for k, t in enumerate(self.tables):
            s ^= t[words >> np.uint32(8 * k) & np.uint32(255)]
        return (words[:, None] ^ self.errors[s]) >> np.uint32(self.parity), self.excess[s]


def _both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of the sum of two codes with a total excess of at most 1."""
    numbers = (a[0][:, :, None] << np.uint32(shift) | b[0][:, None, :]).reshape(len(a[0]), -1)
    excess = np.minimum(a[1][:, :, None].astype(np.int16) + b[1][:, None, :], 9).astype(np.uint8).reshape(len(a[0]), -1)
    used = (excess <= 1).any(axis=0) if len(excess) else np.zeros(excess.shape[1], dtype=bool)
    return numbers[:, used], excess[:, used]


class Anchors:
    """Maps fingerprints to their anchors."""

    def __init__(self):
        self.golay = Code(_remainders(0b101011100011, 23), 3)
        self.hamming = Code(_remainders(0b10011, 15), 1)
        self.repetition = Code([1, 2, 3], 1)

    def of(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the fingerprint, anchor) for every replica of an array of uint64."""
        cut = lambda at, n: (fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32)
        a, b = self.golay.near(cut(0, 23)), self.golay.near(cut(23, 23))
        c = _both(self.hamming.near(cut(46, 15)), self.repetition.near(cut(61, 3)), 1)
        rows, keys = [], []
        for k, pair in enumerate(((a, b), (a, c), (b, c))):
            numbers, excess = _both(*pair, 12)
            row, col = np.nonzero(excess <= 1)
            rows.append(row)
            keys.append(numbers[row, col].astype(np.int64) | k << 24)
        return np.concatenate(rows), np.concatenate(keys)
