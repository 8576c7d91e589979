"""64-bit hashes of all words of many texts at once, with array operations only.

A word is a run without the characters [\\x20\\x09-\\x0D], with A-Z in lower case. The hash of a word is a polynomial in
its bytes modulo 2^64, taken from running sums over the whole buffer, then mixed with its length.
"""

from __future__ import annotations

import functools

import numpy as np

#: Bytes hashed at once; a longer word is hashed at once all the same.
PIECE = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, with the characters between words as spaces.
_PLAIN = bytes(32 if 9 <= c <= 13 else c for c in _LOWER)
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of one piece, with spaces between them."""
    b = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], b == 32, [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    size = PIECE
    while size < len(b):
        size *= 2
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)])])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def piece_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each piece data[start:end]; pieces are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        b = np.frombuffer(data, np.uint8, int(ends[stop - 1]) - begin, begin)
        size = PIECE
        while size < len(b):
            size *= 2
        up, down = _powers(size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)])])
        s, e = starts[at:stop] - begin, ends[at:stop] - begin
        out[at:stop] = mixed((sums[e] - sums[s]) * down[np.minimum(s, size - 1)] + (e - s).astype(np.uint64))
        at = stop
    return out


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): of every word of data the hash and the place of its first byte, in order."""
    data, hashes, places, begin = data.translate(_PLAIN), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while begin < len(data):
        end = begin + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        h, starts = _hashed(data[begin:end])
        hashes.append(h)
        places.append(starts + begin)
        begin = end
    return np.concatenate(hashes), np.concatenate(places)


def hashed_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the words of all texts in a row, and how many each text has."""
    hashes, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(x) + 1 for x in texts])
    at = np.searchsorted(starts, ends)
    return hashes, np.diff(np.concatenate([[0], at])).astype(np.int64)
