"""Words of many texts at once, as 64-bit hashes, straight from UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = _rng.integers(1, 1 << 63, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Kinds of words, after A-Z are lower-cased: runs without white space; runs of 0-9, a-z and everything beyond ASCII.
KINDS = {"spaced": _SPACE, "letters": _LETTER}


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for k, r in enumerate((_R, _R_INVERSE)):
            p = _powers[k]
            step = np.uint64(pow(int(r), len(p), 1 << 64))
            _powers[k] = np.concatenate([p, p * step])
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    hashes: np.ndarray
    #: first word of each text, and the number of all at the end
    first: np.ndarray
    #: bytes at which words start and end
    start: np.ndarray
    end: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of every n words in a row, also across texts."""
        return gram_hashes(self.hashes, n)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size] * _GRAM[0]
    for k in range(1, n):
        out += hashes[k : k + size] * _GRAM[k]
    return mix(out)


def words_of(data: np.ndarray, off: np.ndarray, kind: str) -> Words:
    """Words of the texts data[off[i]:off[i + 1]]; none reaches from one text into the next."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z)
    low = _LOWER[data]
    inside = KINDS[kind][low]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = off[(off > 0) & (off < n)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * power, out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _M2)
    return Words(hashes, np.searchsorted(start, off), start, end)
