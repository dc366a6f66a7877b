"""Cuckoo filters over 128-bit keys (two int64 arrays), vectorised: 16-bit fingerprints, four slots a bucket.

A filter never denies a key that it holds. It supports removal, but only of keys that were added: the caller has to know
that exactly. Filters of several shards are probed together as one flat array.
"""

from __future__ import annotations

import numpy as np

from stratalith.llm.text import mix

SLOTS = 4
_ROUNDS = 400


def _marks(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place (all bits) and fingerprint (1 .. 65535) of keys."""
    return mix(h1.astype(np.int64).view(np.uint64)), (h2.astype(np.int64).view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _other(bucket: np.ndarray, mark: np.ndarray, buckets) -> np.ndarray:
    """The second bucket of a fingerprint, from either of its two."""
    return bucket ^ (mix(mark.astype(np.uint64)).astype(np.int64) & (buckets - 1))


def buckets_for(keys: int) -> int:
    """A power of two that these keys load to three quarters at most."""
    return 1 << max(0, int(np.ceil(np.log2(max(keys, 1) / (0.75 * SLOTS)))))


def _firsts(x: np.ndarray) -> np.ndarray:
    """A mask of the first of each value."""
    out = np.zeros(len(x), bool)
    out[np.unique(x, return_index=True)[1]] = True
    return out


class Filter:
    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def of(cls, data: bytes) -> Filter:
        slots = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        return cls(len(slots), slots)

    def to_bytes(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.slots))

    def _places(self, h1, h2) -> tuple[np.ndarray, np.ndarray]:
        place, mark = _marks(h1, h2)
        return (place & np.uint64(self.buckets - 1)).astype(np.int64), mark

    def add(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Adds distinct keys that aren't held; False if some found no place, then the filter has to be built anew, larger."""
        at, mark = self._places(h1, h2)
        tried = np.zeros(len(at), bool)
        rng = np.random.default_rng(len(at))
        for _ in range(_ROUNDS):
            if not len(at):
                return True
            turn = np.nonzero(_firsts(at))[0]
            free = self.slots[at[turn]] == 0
            fits = free.any(1)
            into = turn[fits]
            self.slots[at[into], free[fits].argmax(1)] = mark[into]
            full = turn[~fits]
            fresh, old = full[~tried[full]], full[tried[full]]
            at[fresh] = _other(at[fresh], mark[fresh], self.buckets)
            tried[fresh] = True
            victim = rng.integers(0, SLOTS, len(old))  # buckets of a turn differ, so each victim is moved once
            out = self.slots[at[old], victim].copy()
            self.slots[at[old], victim] = mark[old]
            mark[old], at[old] = out, _other(at[old], out, self.buckets)
            left = np.ones(len(at), bool)
            left[into] = False
            at, mark, tried = at[left], mark[left], tried[left]
        return not len(at)

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Removes distinct keys, all of which were added."""
        at, mark = self._places(h1, h2)
        while len(at):
            second = _other(at, mark, self.buckets)
            turn = _firsts(np.minimum(at, second))  # pairs of buckets of a turn differ, so no slot is cleared twice
            for bucket in (at, second):
                rest = np.nonzero(turn)[0]
                hit = self.slots[bucket[rest]] == mark[rest][:, None]
                has = hit.any(1)
                self.slots[bucket[rest[has]], hit[has].argmax(1)] = 0
                turn[rest[has]] = False
            if turn.any():
                raise ValueError("a key was removed that the filter doesn't hold")
            left = ~_firsts(np.minimum(at, second))
            at, mark = at[left], mark[left]


class Shards:
    """The filters of shards 0 .. n - 1, probed together."""

    def __init__(self, filters: dict[int, bytes], n: int):
        slots = [np.frombuffer(filters[i], "<u2").reshape(-1, SLOTS) if i in filters else np.zeros((1, SLOTS), np.uint16) for i in range(n)]
        self.n, self.buckets = n, np.array([len(s) for s in slots], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.buckets)[:-1]])
        self.slots = np.concatenate(slots)

    def may_hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        place, mark = _marks(h1, h2)
        shard = shard_of(h1, self.n)
        buckets = self.buckets[shard]
        at = (place & (buckets - 1).astype(np.uint64)).astype(np.int64)
        found = np.zeros(len(at), bool)
        for bucket in (at, _other(at, mark, buckets)):
            found |= (self.slots[self.begin[shard] + bucket] == mark[:, None]).any(1)
        return found


def shard_of(h1: np.ndarray, n: int) -> np.ndarray:
    """As pmod(h1, n) in Spark."""
    return h1 % n
