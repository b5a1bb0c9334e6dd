"""A counting quotient filter over 64-bit fingerprints: no loss, mergeable by its sorted remainders."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class CountingQuotientFilter:
    """Fingerprints split into a quotient of ``q`` bits (the slot) and a remainder (what the slot stores).

    The remainders of a quotient form a sorted run. ``occupieds`` marks quotients that have a run, ``runends``
    the last entry of each run (the rank-and-select layout of quotient filters); ``counts`` has how often each
    remainder was inserted. As quotient and remainder together are the whole fingerprint, nothing is lost, and
    walking two filters in (quotient, remainder) order merges them as sorted lists.
    """

    def __init__(self, q: int, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.remainders, self.counts = q, remainders, counts
        self.occupieds = np.zeros(1 << q, bool)
        self.occupieds[quotients] = True
        self.runends = np.append(quotients[1:] != quotients[:-1], True)[: len(quotients)]

    @classmethod
    def of(cls, fingerprints: np.ndarray, q: int) -> CountingQuotientFilter:
        found, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls._from_sorted(q, found, counts.astype(np.int64))

    @classmethod
    def _from_sorted(cls, q: int, found: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        shift = np.uint64(64 - q)
        return cls(q, (found >> shift).astype(np.int64), found & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    def fingerprints(self) -> np.ndarray:
        """All fingerprints in order, from the bit vectors and remainders."""
        run = np.cumsum(np.append(0, self.runends[:-1])) if len(self.runends) else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupieds)[run].astype(np.uint64)
        return (quotients << np.uint64(64 - self.q)) | self.remainders

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filters' sorted lists of (quotient, remainder) become one; equal entries add their counts.

        The stable sort of 64-bit numbers is a natural merge sort: it takes the presorted lists as runs and merges them.
        """
        filters = list(filters)
        lists = [f.fingerprints() for f in filters]
        every = np.sort(np.concatenate(lists), kind="stable")
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        found, counts = every[first], np.diff(np.append(first, len(every)))
        for own, f in zip(lists, filters, strict=True):
            many = np.flatnonzero(f.counts > 1)
            counts[np.searchsorted(found, own[many])] += f.counts[many] - 1
        return cls._from_sorted(filters[0].q, found, counts)

    def to_bytes(self) -> bytes:
        """Header, the bit vectors, the remainders in as many bytes as they need, and the counts above one with their
        positions."""
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.q, len(self.remainders), len(many)], np.int64)
        occupied = np.flatnonzero(self.occupieds).astype(np.uint32)
        dense = len(occupied) * 32 > len(self.occupieds)  # a sparse filter lists its occupied quotients
        parts = [head, np.array([len(occupied), dense], np.int64)]
        width = -(-(64 - self.q) // 8)
        packed = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        parts += [np.packbits(self.occupieds) if dense else occupied, np.packbits(self.runends), packed]
        return b"".join(p.tobytes() for p in [*parts, many.astype(np.int64), self.counts[many].astype(np.int64)])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n, n_many, n_occupied, dense = np.frombuffer(data, np.int64, 5)
        at = 40

        def take(kind, size):
            nonlocal at
            out = np.frombuffer(data, kind, size, at)
            at += out.nbytes
            return out

        if dense:
            occupied = np.flatnonzero(np.unpackbits(take(np.uint8, (1 << q) + 7 >> 3))[: 1 << q])
        else:
            occupied = take(np.uint32, n_occupied).astype(np.int64)
        runends = np.unpackbits(take(np.uint8, n + 7 >> 3))[:n].astype(bool)
        width = -(-(64 - int(q)) // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take(np.uint8, n * width).reshape(n, width)
        remainders = wide.reshape(-1).view("<u8").astype(np.uint64)
        many, above = take(np.int64, n_many), take(np.int64, n_many)
        counts = np.ones(n, np.int64)
        counts[many] = above
        run = np.cumsum(np.append(0, runends[:-1])) if n else np.zeros(0, np.int64)
        return cls(int(q), occupied[run], remainders, counts)

    def repeated(self) -> np.ndarray:
        """Fingerprints with a count above one."""
        return self.fingerprints()[self.counts > 1]
