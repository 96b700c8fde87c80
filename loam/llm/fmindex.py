"""FM-index over integer sequences in numpy: suffix array, wavelet tree, vectorised backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes still tied are sorted again.

    A 0 ends comparison: each 0 is a symbol of its own, ordered by position, so ties never run past one.
    """
    n = len(text)
    rank = text.astype(np.int64) + n + 1
    zero = np.flatnonzero(text == 0)
    rank[zero] = np.arange(len(zero)) + 1
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    step = 1
    while True:
        single = new & np.concatenate([new[1:], [True]])
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        pos = order[open_]
        after = np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)] + 1, 0)
        g = group[open_]
        again = np.lexsort((after, g))
        pos, after, g = pos[again], after[again], g[again]
        order[open_] = pos
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (after[1:] != after[:-1])])
        new[open_] = fresh
        group[open_] = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[pos] = group[open_]
        step *= 2


class Wavelet:
    """A wavelet tree in level order (bit planes with the zeros of each level moved first): ranks of many symbols at once."""

    def __init__(self, text: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (text >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(text) - int(self.ones[-1][-1]))
            text = np.concatenate([text[bit == 0], text[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(upto), upto
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = (symbol >> level) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a = ones[at]
            bit = ones[at + 1] - a
            out = 2 * out + bit
            at = np.where(bit == 1, zeros + a, at - a)
        return out


class FMIndex:
    """Finds phrases of non-zero symbols in ``text``, which holds symbols 0..top; 0 separates and matches nothing."""

    def __init__(self, text: np.ndarray, top: int):
        text = np.concatenate([text, [0]]).astype(np.int64)  # ends with a separator
        order = suffix_array(text)
        before = text[order - 1]  # of position 0: the last, a separator
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])[: top + 2]
        self.tree = Wavelet(before, max(1, int(top).bit_length()))
        #: Every SAMPLE-th position is kept, and whatever follows a separator, so that no walk passes one.
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
        self.position = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of suffixes that begin with each phrase (left-aligned in a matrix); backward, all at once."""
        n = int(self.count[-1])
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            i = np.flatnonzero((lengths >= back) & (lo < hi))
            s = phrases[i, lengths[i] - back]
            lo[i] = self.count[s] + self.tree.rank(s, lo[i])
            hi[i] = self.count[s] + self.tree.rank(s, hi[i])
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by walking back to a sampled one."""
        out, at, steps, todo = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            a = self.kept[at]
            there = self.kept[at + 1] > a
            out[todo[there]] = self.position[a[there]] + steps
            todo, at = todo[~there], at[~there]
            s = self.tree.get(at)
            at = self.count[s] + self.tree.rank(s, at)
            steps += 1
        return out
