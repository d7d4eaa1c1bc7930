"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes outside 0x20 and 0x09 to 0x0D; A-Z count as a-z. All functions take the
bytes of neighbouring texts and their offsets, as `common.raw` returns them.
"""

from __future__ import annotations

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 mod 8, so that 1 - base loses one bit only
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(20240301).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
MOST_POWERS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int) -> list[np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    return [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 and their inverses, modulo 2**64; tables for very long texts are not kept."""
    if n > MOST_POWERS:
        power, inverse = _power_tables(n)
        return power, inverse
    if not _powers or len(_powers[0]) < n:
        _powers[:] = _power_tables(1 << max(16, (n - 1).bit_length()))
    return _powers[0][:n], _powers[1][:n]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n + 1 offsets of each text's words among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each lower-cased word, and the offsets of each text's words."""
    starts, ends, word_off = word_bounds(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), word_off
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * power, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), word_off


def shingle_sets(words: np.ndarray, word_off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words has one."""
    n, total = len(word_off) - 1, len(words)
    sums = np.zeros(max(0, total - width + 1), np.uint64)
    for k in range(width):
        sums += words[k : k + len(sums)] * _PLACE[k]
    sums = mix(sums)
    out = []
    for i in range(n):
        a, b = word_off[i], word_off[i + 1]
        if b - a >= width:
            s = np.sort(sums[a : b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) ^ _PLACE[32 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sequence_prints(words: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each text's whole word sequence."""
    power, _ = _power(int(np.diff(word_off).max(initial=1)) + 1)
    place = power[np.arange(len(words)) - np.repeat(word_off[:-1], np.diff(word_off))]
    counts = np.diff(word_off).astype(np.uint64)
    out = []
    for salt in (np.uint64(0x632BE59BD9B4E019), np.uint64(0xD1342543DE82EF95)):
        terms = mix(words ^ salt) * place
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        out.append(mix(total[word_off[1:]] - total[word_off[:-1]] + counts * salt))
    return out[0], out[1]
