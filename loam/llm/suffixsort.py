"""Suffix arrays by two-stage sorting, and adjacent common prefixes, in numpy.

Texts are sequences of symbols 1..256 in which 0 ends a segment. A suffix is compared up to and with its first 0; equal ones
stand in any order. Suffixes smaller than their successor are sorted directly; all others are induced: the predecessors of a
bucket's suffixes, taken in order, fall into their own buckets in order.
"""

from __future__ import annotations

import numpy as np

#: Symbols of 9 bits in one 63-bit key.
PACK = 7


def packed(text: np.ndarray) -> np.ndarray:
    """For each place its next PACK symbols in one number; after a 0 only zeros."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(PACK, np.int64)])
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(PACK):
        s = np.where(alive, padded[j : j + n], 0)
        key = key << 9 | s
        alive = s > 0
    return key


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a place later."""
    after = np.append(text[1:], 0).astype(np.int64)
    sign = np.sign(after - text.astype(np.int64))
    where = np.flatnonzero(sign)
    k = np.searchsorted(where, np.arange(len(text)))
    return np.where(k < len(where), sign[where[np.minimum(k, len(where) - 1)]], -1) > 0 if len(where) else np.zeros(len(text), bool)


def dense(key: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]])) if len(key) else 0
    return out


class Blocks:
    """For each place the rank of its next BLOCK symbols (after a 0: zeros), and whether a 0 is among them."""

    BLOCK = 4 * PACK

    def __init__(self, text: np.ndarray):
        self.key = packed(text)
        n, step = len(text), PACK
        self.rank, self.ended = dense(self.key), self.key & 511 == 0
        while step < self.BLOCK:
            at = np.minimum(np.arange(n) + step, n - 1)
            self.rank = dense(self.rank << 32 | np.where(self.ended, 0, self.rank[at] + 1))
            self.ended = self.ended | self.ended[at]
            step *= 2


def sort_directly(places: np.ndarray, blocks: Blocks) -> np.ndarray:
    """The given suffixes in order; after the first block only ties are looked at, a block further each time."""
    rank, ended, n = blocks.rank, blocks.ended, len(blocks.rank)
    order = places[np.argsort(rank[places])]
    k = rank[order]
    same = k[1:] == k[:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    open_ = np.flatnonzero(tied & ~ended[order])  # a block with a 0 is all of a suffix
    g, depth = group[open_], Blocks.BLOCK
    while len(open_):
        p = order[open_]
        at = np.minimum(p + depth, n - 1)
        both = g << 32 | rank[at]
        again = np.argsort(both)
        p, both, at = p[again], both[again], at[again]
        order[open_] = p
        new = np.concatenate([[True], both[1:] != both[:-1]])
        still = ~(new & np.concatenate([new[1:], [True]])) & ~ended[at]
        g = np.cumsum(new)[still]
        open_ = open_[still]
        depth += Blocks.BLOCK
    return order


def two_stage(text: np.ndarray, blocks: Blocks | None = None) -> np.ndarray:
    """The suffix array of ``text``, which ends with 0."""
    blocks = blocks or Blocks(text)
    n, top = len(text), int(text.max(initial=0))
    if not n:
        return np.zeros(0, np.int64)
    zeros = np.flatnonzero(text == 0)
    direct = sort_directly(np.flatnonzero(smaller_than_next(text) & (text > 0)), blocks)
    cut = np.searchsorted(text[direct], np.arange(top + 2))
    pending: list[list[np.ndarray]] = [[] for _ in range(top + 1)]
    out: list[np.ndarray] = []
    for c in range(top + 1):
        if c == 0:
            content = zeros
        else:
            part = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
            pending[c] = []
            parts = [part]
            while len(part):  # runs of c
                part = part[part > 0] - 1
                part = part[text[part] == c]
                parts.append(part)
            content = np.concatenate([*parts, direct[cut[c] : cut[c + 1]]])
        out.append(content)
        before = content[content > 0] - 1
        symbol = text[before]
        larger = symbol > c
        before, symbol = before[larger], symbol[larger]
        if len(before):
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            starts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(before)], strict=True):
                pending[symbol[a]].append(before[a:b])
    return np.concatenate(out)


def share_prefix(order: np.ndarray, blocks: Blocks, length: int) -> np.ndarray:
    """For each suffix but the first in order: whether its common prefix with the one before has ``length`` symbols or more.

    Both must have so many symbols before their 0.
    """
    a, b = order[:-1], order[1:]
    live, out, n, depth = np.arange(len(a)), np.zeros(len(a), bool), len(blocks.key) - 1, 0
    while depth + Blocks.BLOCK <= length:
        x, y = np.minimum(a[live] + depth, n), np.minimum(b[live] + depth, n)
        live = live[(blocks.rank[x] == blocks.rank[y]) & ~blocks.ended[x]]
        depth += Blocks.BLOCK
    while depth < length:
        x, y = blocks.key[np.minimum(a[live] + depth, n)], blocks.key[np.minimum(b[live] + depth, n)]
        cut = 9 * max(0, depth + PACK - length)
        live = live[((x ^ y) >> cut == 0) & ((x >> cut) & 511 > 0)]
        depth += PACK
    out[live] = True
    return out
