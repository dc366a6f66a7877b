"""Vectorised words, hashes and n-grams over the byte buffers of Arrow text columns.

All functions work on a run of whole texts that lie side by side in one uint8 buffer. Offsets say where each text
begins; a text is never cut. Runs hold about CHUNK bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(str(base))
    if have is None or len(have) <= n:
        step = np.full(max(n + 1, CHUNK + 1), base, np.uint64)
        step[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(step)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if column.null_count:  # what lies under a null does not count: Arrow allows anything there
        column = pa.array(column.fill_null(""))
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts."""
    data, at = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a run of texts: start, end (bytes), doc (row in the run), hash and first (words before each text)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, space: np.ndarray = IS_SPACE):
        inside = ~space[data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            filled = at[:-1][at[1:] > at[:-1]]
            before[filled] = False
            after[at[1:][at[1:] > at[:-1]] - 1] = False
        self.start, self.end = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~after)[0] + 1
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.n = len(self.start)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * _power(_BASE, n)[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _power(_INVERSE, n)[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, ok) of the k words from each word on; ok where all k lie in one text."""
        out = np.zeros(self.n, np.uint64)
        ok = np.arange(self.n) + k <= self.first[1:][self.doc] if self.n else np.zeros(0, bool)
        m = self.n - k + 1
        if m > 0:
            for j in range(k):
                out[:m] += self.hash[j : j + m] * _power(np.uint64(0xD6E8FEB86659FD93), k)[j]
        return mix(out + np.uint64(k)), ok

    def spans(self, lo: np.ndarray, hi: np.ndarray, other: bool = False) -> np.ndarray:
        """Hash of the word sequences lo .. hi (word numbers), by prefix sums; other gives a second, independent one."""
        total = np.zeros(self.n + 1, np.uint64)
        np.cumsum((mix(self.hash ^ np.uint64(0x8A5CD789635D2DFF)) if other else self.hash) * _power(_BASE, self.n)[: self.n], out=total[1:])
        return mix((total[hi] - total[lo]) * _power(_INVERSE, self.n)[lo] + (hi - lo).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
