"""Word hashes, shingle sets and MinHash signatures of UTF-8 texts, in numpy.

Words are runs of bytes other than space and \\t..\\r; A-Z count as a-z. A word's hash is a polynomial
over a table of random 64-bit values, taken from prefix sums, then mixed. All hashes have 64 bits and
fixed seeds, so they agree between tasks and runs.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import SPACE_BYTES

_rng = np.random.Generator(np.random.PCG64(20240607))
_LETTER = _rng.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; kept up to the usual chunk size."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = max(n, (1 << 20) + 4096)
    tables = []
    for b in (_BASE, _BACK):
        p = np.full(size, np.uint64(b), dtype=np.uint64)
        p[0] = 1
        tables.append(np.cumprod(p, dtype=np.uint64))
    if size <= 1 << 22:
        _powers[:] = tables
    return tables


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, for each text the bounds of its words among them, and where each word begins."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    begins = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, back = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64))
    return hashes, np.searchsorted(begins, offs, "left"), begins


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on (the last width - 1 are of no use)."""
    n = len(hashes) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(_BASE) + hashes[j : j + n]
    return mix(out + np.uint64(width))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words has its whole sequence as one, none if it has no word."""
    hashes, bounds, _ = word_hashes(data, offs)
    windows = _windows(hashes, width) if len(hashes) >= width else np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(windows[lo : hi - width + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif hi > lo:
            s = _windows(hashes[lo:hi], hi - lo)
        else:
            s = windows[:0]
        out.append(s)
    return out


def repeated_share(hashes: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """For each text the share of its windows of ``width`` words that repeat an earlier one."""
    windows = hashes if width == 1 else _windows(hashes, width) if len(hashes) >= width else hashes[:0]
    out = np.zeros(len(bounds) - 1)
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        n = hi - lo - width + 1
        if n > 1:
            s = np.sort(windows[lo : lo + n])
            out[i] = 1 - (1 + np.count_nonzero(s[1:] != s[:-1])) / n
    return out


def digest(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a set; equal sets only have equal digests."""
    return hashlib.blake2b(shingles.astype("<u8", copy=False).tobytes(), digest_size=16).digest()


class MinHash:
    """Signatures of ``size`` 32-bit minima."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 2**31, size=size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, size=size, dtype=np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row for each set, which must not be empty."""
        out = np.empty((len(sets), len(self.a)), dtype=np.uint32)
        if not sets:
            return out
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        for k in range(len(self.a)):
            v = x * self.a[k]
            v ^= v >> np.uint32(15)
            v += self.b[k]
            out[:, k] = np.minimum.reduceat(v, starts)
        return out
