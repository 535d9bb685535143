"""Run-length index of a shard: which of its texts' strings occur twice.

The suffixes are sorted, the Burrows-Wheeler transform is compressed to its runs, and only the ends of runs are
sampled: their text positions and the match length with the neighbouring suffix. Everywhere else a suffix and its
neighbour are preceded by the same byte, so their match is one shorter than that of the position before. Matching
statistics are therefore streamed from the samples in text order.
"""

from __future__ import annotations

import numpy as np

_FIRST = 7  # symbols of base 257 that fit in 64 bits
_FILL = np.zeros(_FIRST, dtype=np.uint8)


class RunIndex:
    """texts: byte strings; no match crosses from one to another."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = int(self.lengths.sum())
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.rest = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(n)
        self.ranks: list[tuple[int, np.ndarray]] = []
        order = self._sorted(n)
        before = np.zeros(n, dtype=np.int16)  # 0 starts a text and never continues a run
        before[1:] = self.data[:-1].astype(np.int16) + 1
        before[self.starts[self.lengths > 0]] = 0
        bwt = before[order]
        cut = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)) + 1  # heads of runs after the first
        self.runs = len(cut) + 1 if n else 0
        match = self._match(order[cut - 1], order[cut])
        #: sampled positions and match lengths: run heads with the suffix before, run tails with the one after
        self.heads, self.tails, self.match = order[cut], order[cut - 1], match

    def _sorted(self, n: int) -> np.ndarray:
        padded = np.concatenate([self.data, _FILL]).astype(np.uint64) + np.uint64(1)
        key = np.zeros(n, dtype=np.uint64)
        for j in range(_FIRST):
            key = key * np.uint64(257) + np.where(self.rest > j, padded[j : n + j], 0)
        rank, order = self._ranked(key, None, None)
        depth, longest = _FIRST, int(self.lengths.max(initial=0))
        self.ranks.append((depth, rank))
        while depth < longest:
            size = np.bincount(rank, minlength=n + 1)
            open_ = order[size[rank[order]] > 1]  # only ties are sorted further, each within its place
            if not len(open_):
                break
            follow = np.where(self.rest[open_] > depth, rank[np.minimum(open_ + depth, n - 1)].astype(np.int64) + 1, 0)
            key = rank[open_].astype(np.int64) << 32 | follow
            place = np.argsort(key, kind="stable")
            key, moved = key[place], open_[place]
            order = order.copy()
            order[np.flatnonzero(size[rank[order]] > 1)] = moved
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.r_[True, (key[1:] >> 32) != (key[:-1] >> 32)]
            at = np.arange(len(key))
            offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            rank = rank.copy()
            rank[moved] = (key >> 32).astype(np.int32) + offset.astype(np.int32)
            depth *= 2
            self.ranks.append((depth, rank))
        return order

    @staticmethod
    def _ranked(key: np.ndarray, *_) -> tuple[np.ndarray, np.ndarray]:
        """Rank by key: the number of smaller keys, and the order (ties by position)."""
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]] if len(key) else np.empty(0, bool)
        rank = np.empty(len(key), dtype=np.int32)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else 0
        return rank, order

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at a and b, from the ranks that sorting left."""
        most = np.minimum(self.rest[a], self.rest[b])
        a, b, got = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        last = max(len(self.data) - 1, 0)
        for depth, rank in reversed(self.ranks):
            same = (got < most) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
            for x in (a, b, got):
                x[same] += depth
        for _ in range(_FIRST - 1):
            same = (got < most) & (self.data[np.minimum(a, last)] == self.data[np.minimum(b, last)])
            for x in (a, b, got):
                x[same] += 1
        return np.minimum(got, most)

    def statistics(self) -> np.ndarray:
        """For every position of the joined texts, the longest match that starts there and elsewhere too."""
        reach = np.zeros(len(self.data), dtype=np.int64)
        np.maximum.at(reach, self.heads, self.match + self.heads)
        np.maximum.at(reach, self.tails, self.match + self.tails)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(len(reach)), 0)
