"""A cuckoo filter on numpy arrays: bulk insert, membership and removal of 64-bit hashes.

Two buckets of four 16-bit fingerprints per key. What finds no place after
``KICKS`` rounds goes to an exact stash, so that a key which was inserted is
always found. Only keys that were inserted may be removed.
"""

from __future__ import annotations

import pickle

import numpy as np

from tandem.llm.words import mix

SLOTS, KICKS, LOAD = 4, 64, 0.85
_U = np.uint64


class CuckooFilter:
    def __init__(self, capacity: int):
        need = max(1, int(capacity / (SLOTS * LOAD)) + 1)
        self.n = 1 << (need - 1).bit_length()
        self.capacity = max(capacity, int(self.n * SLOTS * LOAD))
        self.table = np.zeros((self.n, SLOTS), np.uint16)
        self.stash = np.zeros(0, _U)
        self.size = 0

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(h.astype(_U))
        mark = ((h >> _U(48)) % _U(65535) + _U(1)).astype(np.uint16)
        return mark, (h & _U(self.n - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(mark.astype(_U)) & _U(self.n - 1)).astype(np.int64)

    def insert(self, h: np.ndarray) -> None:
        h = np.asarray(h).astype(_U)
        self.size += len(h)
        mark, at = self._places(h)
        rng = np.random.default_rng(len(h))
        for turn in range(KICKS):
            at = at if turn == 0 else self._other(mark, at)
            for s in range(SLOTS):
                free = np.flatnonzero(self.table[at, s] == 0)
                if len(free):
                    _, first = np.unique(at[free], return_index=True)
                    put = free[first]
                    self.table[at[put], s] = mark[put]
                    keep = np.ones(len(mark), bool)
                    keep[put] = False
                    mark, at = mark[keep], at[keep]
            if not len(mark):
                return
            if turn:  # both buckets of these were full: swap one key of a bucket with what it holds
                _, one = np.unique(at, return_index=True)
                slot = rng.integers(0, SLOTS, len(one))
                mark[one], self.table[at[one], slot] = self.table[at[one], slot], mark[one]
        low = np.minimum(at, self._other(mark, at)).astype(_U)
        self.stash = np.concatenate((self.stash, (low << _U(16)) | mark.astype(_U)))

    def _stashed(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = np.minimum(at, self._other(mark, at)).astype(_U)
        return (low << _U(16)) | mark.astype(_U)

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, at = self._places(np.asarray(h))
        found = (self.table[at] == mark[:, None]).any(1) | (self.table[self._other(mark, at)] == mark[:, None]).any(1)
        return found | np.isin(self._stashed(mark, at), self.stash) if len(self.stash) else found

    def remove(self, h: np.ndarray) -> None:
        """Takes out one fingerprint for each (inserted) key."""
        mark, at = self._places(np.asarray(h))
        self.size -= len(mark)
        for m, a, b in zip(mark.tolist(), at.tolist(), self._other(mark, at).tolist(), strict=True):
            for place in (a, b):
                hit = np.flatnonzero(self.table[place] == m)
                if len(hit):
                    self.table[place, hit[0]] = 0
                    break
            else:
                gone = np.flatnonzero(self.stash == (min(a, b) << 16 | m))
                if not len(gone):
                    raise KeyError("a key that was never inserted")
                self.stash = np.delete(self.stash, gone[0])

    def dump(self) -> bytes:
        return pickle.dumps((self.n, self.capacity, self.size, self.table.tobytes(), self.stash.tobytes()))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        f = cls.__new__(cls)
        f.n, f.capacity, f.size, t, s = pickle.loads(blob)
        f.table = np.frombuffer(t, np.uint16).reshape(f.n, SLOTS).copy()
        f.stash = np.frombuffer(s, _U).copy()
        return f
