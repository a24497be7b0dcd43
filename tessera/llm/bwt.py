"""Which positions of a byte sequence share a long prefix with another one, by interval expansion on its Burrows-Wheeler transform.

Intervals of suffixes are expanded backward, breadth first: those of strings of length 1, then 2, and so on. An interval of a
string of length l + 1 whose right end has no value yet sets the common prefix there to l (of the two suffixes that meet at that end) and goes
into the next round; any other interval is dropped, since its end was reached by a shorter string. So common prefixes are derived by
increasing value, each once, and the expansion stops at the wanted length: ends without a value by then are the
places where neighbours share at least that many bytes. No value beyond the length is ever computed.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.fm_index import WaveletMatrix

#: Symbols that the first sorting key holds, 9 bits each.
_PACKED = 7


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols (0..511) at least; ties in any order.

    Keys double in length; suffixes that are alone in their group are not sorted again.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(_PACKED, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(_PACKED):
        key = key << 9 | padded[i : n + i]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is the place where it begins
    rank = np.zeros(n + 1, np.int64)
    rank[order] = first + 1  # 0: past the end
    length = _PACKED
    left = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of suffixes that are not alone
    while length < depth and len(left):
        suffix = order[left]
        key = rank[suffix] << 32 | rank[np.minimum(suffix + length, n)]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[left] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))] + 1
        left = left[~(new & np.append(new[1:], True))]
        length *= 2
    return order


class Branching(WaveletMatrix):
    """A wavelet matrix that lists the symbols of an interval."""

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, rank before lo, rank before hi) of every distinct symbol in each of the intervals."""
        code = np.zeros(len(lo), np.int64)
        for level in range(self.levels):
            both = self._ones(level, np.concatenate([lo, hi]))
            one_lo, one_hi = both[: len(lo)], both[len(lo) :]
            zero = np.flatnonzero(hi - lo > one_hi - one_lo)
            one = np.flatnonzero(one_hi > one_lo)
            z = self.zeros[level]
            code = np.concatenate([code[zero] << 1, code[one] << 1 | 1])
            lo, hi = np.concatenate([lo[zero] - one_lo[zero], z + one_lo[one]]), np.concatenate([hi[zero] - one_hi[zero], z + one_hi[one]])
        base = self.base[code]
        return code, lo - base, hi - base


def long_repeats(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each position whether the ``length`` symbols from it on also start elsewhere. Symbol 0 separates texts: positions
    with fewer than ``length`` symbols before the next 0 are False."""
    if len(symbols) <= length:
        return np.zeros(len(symbols), bool)
    if symbols[-1]:
        return long_repeats(np.append(symbols, 0), length)[:-1]
    n = len(symbols)
    out = np.zeros(n, bool)
    order = suffix_order(symbols, length)
    last = symbols[order - 1]  # what comes before each suffix; -1 wraps round
    alphabet, codes = np.unique(last, return_inverse=True)
    codes = codes.astype(np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(alphabet)))])
    back = np.zeros(n, np.int64)  # the row of the suffix that is one symbol longer
    back[np.argsort(codes.astype(np.uint16), kind="stable")] = np.arange(n)
    tree = Branching(codes, max(2, len(alphabet)))
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = first[:-1], first[1:]
    new = ~known[hi]  # strings of one symbol: common prefixes of 0
    known[hi] = True
    lo, hi = lo[new | (hi == n)], hi[new | (hi == n)]
    for _ in range(1, length):
        if not len(lo):
            break
        alone = hi - lo == 1
        at = lo[alone]
        at = at[codes[at] > 0]  # a string that begins with a separator leads to no string without one
        one = back[at]
        symbol, a, b = tree.branches(lo[~alone], hi[~alone])
        keep = symbol > 0
        symbol, a, b = symbol[keep], a[keep], b[keep]
        lo, hi = np.concatenate([one, first[symbol] + a]), np.concatenate([one + 1, first[symbol] + b])
        new = ~known[hi]
        lo, hi = lo[new], hi[new]
        known[hi] = True
    shared = ~known
    row = shared[:-1] | shared[1:]
    out[order[row]] = True
    stop = np.flatnonzero(symbols == 0)
    nearest = np.append(stop, n)[np.searchsorted(stop, np.arange(n))]
    return out & (nearest - np.arange(n) >= length)
