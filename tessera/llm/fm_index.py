"""A compressed FM-index over word ids, searched for many patterns at once.

What is kept: the Burrows-Wheeler sequence in a wavelet matrix (one bit vector for each bit of the
word id, with block ranks), longest common prefixes capped at ``depth`` in a byte a row, and one
suffix position in ``SAMPLE``, with those of sequence starts. The longest common prefixes
let a search drop its last word by widening its interval, so matching statistics go up to ``depth`` words.
``locate`` walks LF steps to the next sampled position; it never has to cross a separator.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 64
#: One suffix position in so many is kept.
SAMPLE = 32


class WaveletMatrix:
    """rank(c, i): how often symbol c is among the first i; for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.n = len(symbols)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        x = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            b = (x >> level & 1).astype(np.uint8)
            padded = np.zeros((self.n // _BLOCK + 1) * _BLOCK, np.uint8)
            padded[: self.n] = b
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            flag = b.astype(bool)
            self.zeros.append(self.n - int(flag.sum()))
            x = np.concatenate([x[~flag], x[flag]])
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))  # where each symbol's run begins below the last level

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = (c >> (self.levels - 1 - k) & 1).astype(bool)
            ones = self._ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block, off = i >> 6, (i & 63).astype(np.uint64)
        below = (np.uint64(1) << off) - np.uint64(1)
        return self.ranks[level][block].astype(np.int64) + np.bitwise_count(self.bits[level][block] & below)

    def rank2(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank(c, lo), rank(c, hi))."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        m, base = len(c), self.base[c]
        return both[:m] - base, both[m:] - base

    def symbols(self, i: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        at, out = i.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = (self.bits[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
            out = out << 1 | one
        return out

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.bits, *self.ranks, self.base))


class FMIndex:
    """Index of sequences of word ids (1..sigma-1), concatenated with separators (0)."""

    def __init__(self, sequence: np.ndarray, sigma: int, depth: int = 16) -> None:
        n = len(sequence)
        self.n, self.sigma, self.depth = n, sigma, depth
        ranks = [sequence.astype(np.int32)]  # of runs of 1, 2, 4, ... symbols
        length, last = 1, ranks[0]
        while length < depth or int(last.max(initial=0)) + 1 < n:
            prev = last.astype(np.int64)
            after = np.zeros(n, np.int64)
            after[: max(0, n - length)] = prev[length:] + 1
            last = np.unique(prev * (int(prev.max(initial=0)) + 2) + after, return_inverse=True)[1].astype(np.int32)
            length *= 2
            if length <= depth:
                ranks.append(last)
        sa = np.argsort(last, kind="stable")
        lcp = np.zeros(n, dtype=np.uint8)  # of neighbours in suffix order, capped at depth
        a, b = sa[:-1].copy(), sa[1:].copy()
        got = np.zeros(max(0, n - 1), dtype=np.int64)
        whole = ranks[-1][sa[:-1]] == ranks[-1][sa[1:]]
        for step in range(len(ranks) - 2, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(len(a), dtype=bool)
            same[inside] = ranks[step][a[inside]] == ranks[step][b[inside]]
            got += np.where(same, 1 << step, 0)
            a, b = np.where(same, a + (1 << step), a), np.where(same, b + (1 << step), b)
        if n:
            lcp[1:] = np.where(whole, depth, got)
        self.lcp = lcp
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=sigma))]).astype(np.int64)
        self.wavelet = WaveletMatrix(sequence[sa - 1], sigma)  # position -1 wraps to the last separator
        self.sampled = np.flatnonzero((sa % SAMPLE == 0) | (sequence[sa - 1] == 0)).astype(np.int32)
        self.position = sa[self.sampled].astype(np.int32)
        self._edges: dict[int, np.ndarray] = {}

    def nbytes(self) -> int:
        return self.wavelet.nbytes() + self.lcp.nbytes + self.sampled.nbytes + self.position.nbytes + self.first.nbytes

    def edges(self, d: int) -> np.ndarray:
        """First rows of the groups of suffixes that share their first ``d`` words."""
        if d not in self._edges:
            edge = self.lcp < d
            if self.n:
                edge[0] = True
            self._edges[d] = np.flatnonzero(edge).astype(np.int32)
        return self._edges[d]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: intervals of c followed by what [lo, hi) stands for."""
        a, b = self.wavelet.rank2(c, lo, hi)
        return self.first[c] + a, self.first[c] + b

    def widen(self, lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``d`` words of what [lo, hi) stands for."""
        new_lo, new_hi = lo.copy(), hi.copy()
        for depth in np.unique(d):
            at = np.flatnonzero(d == depth)
            if depth == 0:
                new_lo[at], new_hi[at] = 0, self.n
            else:
                edges = self.edges(int(depth))
                g = np.searchsorted(edges, lo[at], side="right")
                new_lo[at] = edges[g - 1]
                new_hi[at] = np.where(g < len(edges), edges[np.minimum(g, len(edges) - 1)], self.n)
        return new_lo, new_hi

    def matching_statistics(self, words: np.ndarray, begin: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the streamed sequences: (length of the longest match that starts
        there, at most ``cap``; the first row of that match's interval, -1 for none).

        ``words``: word ids, 0 for a word that the index lacks; ``begin``: where each
        sequence starts (with the total at the end). All sequences advance together, from right to left.
        """
        size = np.diff(begin)
        length, row = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        active = order[size[order] > 0]
        lo, hi, have = np.zeros(len(active), np.int64), np.full(len(active), self.n), np.zeros(len(active), np.int64)
        sizes = size[active]
        for t in range(int(sizes.max(initial=0))):
            k = int(np.searchsorted(-sizes, -t, side="left"))  # those longer than t; sizes descend
            active, sizes, lo, hi, have = active[:k], sizes[:k], lo[:k], hi[:k], have[:k]
            at = begin[active + 1] - 1 - t
            c = words[at]
            full = have >= cap
            if full.any():
                f = np.flatnonzero(full)
                lo[f], hi[f] = self.widen(lo[f], hi[f], np.full(len(f), cap - 1))
                have[f] = cap - 1
            new_lo, new_hi = self.extend(np.maximum(c, 1), lo, hi)
            ok = (new_hi > new_lo) & (c > 0)
            todo = np.flatnonzero(~ok & (c > 0))
            while len(todo):
                todo = todo[have[todo] > 0]
                have[todo] -= 1
                lo[todo], hi[todo] = self.widen(lo[todo], hi[todo], have[todo])
                x, y = self.extend(c[todo], lo[todo], hi[todo])
                good = y > x
                new_lo[todo[good]], new_hi[todo[good]] = x[good], y[good]
                ok[todo[good]] = True
                todo = todo[~good]
            lo, hi = np.where(ok, new_lo, 0), np.where(ok, new_hi, self.n)
            have = np.where(ok, have + 1, 0)
            length[at], row[at] = have, np.where(have > 0, lo, -1)
        return length, row

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of these rows' suffixes (rows that start with a word, not with a separator)."""
        rows = rows.astype(np.int64).copy()
        out = np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        steps = np.zeros(len(rows), np.int64)
        while len(todo):
            r = rows[todo]
            g = np.minimum(np.searchsorted(self.sampled, r), len(self.sampled) - 1)
            hit = self.sampled[g] == r
            out[todo[hit]] = self.position[g[hit]] + steps[todo[hit]]
            todo, r = todo[~hit], r[~hit]
            c = self.wavelet.symbols(r)
            lo, _ = self.extend(c, r, r)
            rows[todo] = lo
            steps[todo] += 1
        return out
