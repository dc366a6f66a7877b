"""A compressed FM-index over word numbers, in numpy: suffix order, wavelet matrix, backward search for many texts at once.

Beside the bit vectors of the wavelet matrix the index keeps seven integers a word (shared words and owners with their
minima by block, nearest smaller values), so its memory grows linearly.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Rank of any symbol in a prefix of a sequence: one packed bit vector with counts by 64-bit word for each level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, 64 - len(bit) % 64)), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]]).astype(np.int32)
            self.levels.append((level, packed, ones, int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.begin = self._walk(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, packed, ones, zeros in self.levels:
            word = i >> 6
            rank = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, zeros + rank, i - rank)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before i."""
        return self._walk(symbol, i) - self.begin[symbol]


class Minima:
    """Minimum of any range: minima from both ends of each block, and a table of powers of two over whole blocks."""

    BLOCK = 32

    def __init__(self, values: np.ndarray):
        grid = np.full((-(-len(values) // self.BLOCK), self.BLOCK), np.iinfo(np.int32).max, np.int32)
        grid.reshape(-1)[: len(values)] = values
        self.values = grid.reshape(-1)
        self.from_left = np.minimum.accumulate(grid, 1).reshape(-1)
        self.from_right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
        rows = [grid.min(1)]
        while 2 << (len(rows) - 1) <= len(grid):
            half = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
        self.table = np.zeros((len(rows), len(grid)), np.int32)
        for j, row in enumerate(rows):
            self.table[j, : len(row)] = row

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo:hi], hi > lo."""
        last = hi - 1
        first_block, last_block = lo // self.BLOCK, last // self.BLOCK
        out = np.minimum(self.from_right[lo], self.from_left[last])
        far = np.nonzero(last_block - first_block > 1)[0]
        a, b = first_block[far] + 1, last_block[far]
        j = np.frexp((b - a).astype(np.float64))[1] - 1
        out[far] = np.minimum(out[far], np.minimum(self.table[j, a], self.table[j, b - (1 << j)]))
        near = np.nonzero(first_block == last_block)[0]
        out[near] = self.values[lo[near]]
        step = 1
        while len(near := near[lo[near] + step <= last[near]]):
            out[near] = np.minimum(out[near], self.values[lo[near] + step])
            step += 1
        return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the last earlier one with a smaller value, by following pointers; the first value is the least of all."""
    found = np.arange(-1, len(values) - 1, dtype=np.int32)
    open_ = np.arange(1, len(values))
    while len(open_ := open_[(found[open_] > 0) & (values[found[open_]] >= values[open_])]):
        found[open_] = found[found[open_]]
    return np.maximum(found, 0)


class FMIndex:
    """Index of segments of one shard: tokens (numbers from 1) with bounds, and the owner (a rank) of each segment.

    Separators are distinct and smaller than all words, so no match runs across segments.
    """

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, owner: np.ndarray):
        count, sizes = len(bounds) - 1, np.diff(bounds)
        n = len(tokens) + count
        self.at = bounds[:-1] + np.arange(count)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[bounds[1:] + np.arange(count)] = False
        text[inside] = tokens
        rank = text + count - 1
        rank[~inside] = np.arange(count)
        rank = np.unique(rank, return_inverse=True)[1]
        same, width = [rank], 1
        while rank.max() < n - 1:  # the order of suffixes by twice as many words each time
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            same.append(rank)
            width *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        common, left, right = np.zeros(n - 1, np.int64), order[:-1].copy(), order[1:].copy()
        for j in range(len(same) - 2, -1, -1):
            inside_both = (left < n) & (right < n)
            equal = inside_both & (same[j][np.minimum(left, n - 1)] == same[j][np.minimum(right, n - 1)])
            common[equal] += 1 << j
            left[equal] += 1 << j
            right[equal] += 1 << j
        self.n, self.text, self.sizes, self.owner = n, text, sizes, owner
        self.common = np.concatenate([[-1], common, [-1]])
        self.common = self.common.astype(np.int32)
        self.before_smaller = nearest_smaller(self.common)
        self.after_smaller = n - nearest_smaller(self.common[::-1])[::-1]
        segment = np.searchsorted(self.at, order, "right") - 1
        self.owner_minima = Minima(owner[segment])
        last = text[order - 1]
        self.wavelet = Wavelet(last, int(text.max()) + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.wavelet.depth))])

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest wider interval: its suffixes share fewer words."""
        a, b = self.common[lo], self.common[hi]
        size = np.maximum(a, b)
        return np.where(a == size, self.before_smaller[lo], lo), np.where(b == size, self.after_smaller[hi], hi), size

    def matching_statistics(self, segments: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token of each given segment, the longest match from there in a segment whose owner is `below`; and its bounds.

        All segments are searched backwards side by side: extend to the left while such an owner stays in the interval,
        else go to the parent interval and try again.
        """
        sizes = self.sizes[segments]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(bounds[-1], np.int32)
        query, at = np.arange(len(segments)), sizes - 1
        lo, hi, size = np.zeros(len(query), np.int64), np.full(len(query), self.n), np.zeros(len(query), np.int64)
        while len(query := query[keep := at >= 0]):
            at, lo, hi, size = at[keep], lo[keep], hi[keep], size[keep]
            word = self.text[self.at[segments[query]] + at]
            new_lo, new_hi = self.before[word] + self.wavelet.rank(np.concatenate([word, word]), np.concatenate([lo, hi])).reshape(2, -1)
            good = new_lo < new_hi
            good[good] = self.owner_minima.of(new_lo[good], new_hi[good]) < below[query[good]]
            out[bounds[query[good]] + at[good]] = size[good] + 1
            lo, hi, size = np.where(good, new_lo, lo), np.where(good, new_hi, hi), size + good
            up = ~good & (size > 0)
            if up.any():
                lo[up], hi[up], size[up] = self._parent(lo[up], hi[up])
                size[up] = np.maximum(size[up], 0)
            at = at - (good | (~good & ~up))
        return out, bounds
