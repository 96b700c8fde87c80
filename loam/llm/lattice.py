"""The marginal probability of words over all their segmentations into vocabulary pieces, in log space, and its re-estimation."""

from __future__ import annotations

import math

import numpy as np

from .common import mix64

#: Longer pieces are few; they are looked up only where their first STEM bytes occur.
STEM = 16
#: Words of this length or more are scored one by one, in chunks of CHUNK places.
LONG_WORD, CHUNK = 64, 1 << 16
STEP = np.uint64(0x9E3779B97F4A7C15)
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64))


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a SentencePiece model as bytes (a word begins with a space) and log weights from their scores.

    A unigram vocabulary's scores would be log probabilities; those of a merge vocabulary are negative ranks, and a piece of rank
    r gets a probability in proportion to 1 / (r + 10), as words of that rank have by Zipf's law. Every byte is a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 1e-4 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        score = model.get_score(i)
        weight[piece] = 1 / (10 - score) if score <= 0 else 1.0
    pieces = sorted(weight)
    logs = np.log([weight[p] for p in pieces])
    return pieces, logs - np.logaddexp.reduce(logs)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Lattice:
    """Scores words (with their leading space) under piece log probabilities."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(h)
        self.sorted, self.logs = h[self.order], logs[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.longest = max(map(len, pieces))
        self.stems = np.unique(np.array([self._hash(p[:STEM]) for p in pieces if len(p) > STEM], np.uint64))
        self.size = len(pieces)
        # Open addressing: most substrings are no piece and meet an empty place at once.
        self.bits = max(8, (8 * self.size).bit_length())
        self.places = np.full(1 << self.bits, -1, np.int32)
        for slot, x in enumerate(self.sorted):
            at = int(x) >> (64 - self.bits)
            while self.places[at] >= 0:
                at = (at + 1) % len(self.places)
            self.places[at] = slot

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(STEP) + int(BYTE_HASH[b])) & (2**64 - 1)
        return h

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h that are pieces, their slots)."""
        at = (h >> np.uint64(64 - self.bits)).view(np.int64)
        slot = self.places[at]
        todo = np.flatnonzero(slot >= 0)
        slot, at, found = slot[todo], at[todo], []
        while len(todo):
            hit = self.sorted[slot] == h[todo]
            found.append((todo[hit], slot[hit]))
            todo, at = todo[~hit], (at[~hit] + 1) % len(self.places)
            slot = self.places[at]
            go = slot >= 0
            todo, at, slot = todo[go], at[go], slot[go]
        if len(found) == 1:
            return found[0]
        return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (todo, slot)

    def _same_length(self, text: np.ndarray, expect: np.ndarray | None) -> np.ndarray:
        """Log probability of each row; adds expected piece counts to ``expect``."""
        rows, n = text.shape
        coded = BYTE_HASH[text.T]
        ahead = np.full((n + 1, rows), -np.inf)
        ahead[0] = 0
        arcs = []
        for i in range(n):
            h = np.zeros(rows, np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * STEP + coded[j]
                on, slot = self._find(h)
                if len(on):
                    ahead[j + 1, on] = np.logaddexp(ahead[j + 1, on], ahead[i, on] + self.logs[slot])
                    if expect is not None:
                        arcs.append((i, j + 1, on, slot))
                if j - i + 1 == STEM and not np.isin(h, self.stems).any():
                    break
        if expect is not None:
            behind = np.full((n + 1, rows), -np.inf)
            behind[n] = 0
            for i, j, on, slot in reversed(arcs):
                p = behind[j, on] + self.logs[slot]
                behind[i, on] = np.logaddexp(behind[i, on], p)
                np.add.at(expect, slot, np.exp(ahead[i, on] + p - ahead[n, on]))
        return ahead[n]

    def _arcs(self, text: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, slots) of the pieces that start at first..last-1 of the word, by start."""
        n = len(text)
        h, found = np.zeros(last - first, np.uint64), []
        for k in range(min(self.longest, n - first)):
            h = h[: min(last, n - k) - first]
            h = h * STEP + text[first + k : first + k + len(h)]
            on, slot = self._find(h)
            found.append((on + first, on + first + k + 1, slot))
            if k + 1 == STEM and not np.isin(h, self.stems).any():
                break
        i, j, slot = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(i, kind="stable")
        return i[order], j[order], slot[order]

    def _long(self, word: bytes, expect: np.ndarray | None = None) -> float:
        """One word, in memory linear in its length; adds expected piece counts to ``expect``."""
        text = BYTE_HASH[np.frombuffer(word, np.uint8)]
        n = len(text)
        ahead = [-math.inf] * (n + 1)
        ahead[0] = 0.0
        for first in range(0, n, CHUNK):
            i, j, slot = self._arcs(text, first, min(n, first + CHUNK))
            for x, y, p in zip(i.tolist(), j.tolist(), self.logs[slot].tolist(), strict=True):
                ahead[y] = _add(ahead[y], ahead[x] + p)
        if expect is None or ahead[n] == -math.inf:
            return ahead[n]
        behind = [-math.inf] * (n + 1)
        behind[n] = 0.0
        for first in reversed(range(0, n, CHUNK)):
            last = min(n, first + CHUNK)
            i, j, slot = self._arcs(text, first, last)
            for x, y, p in zip(i[::-1].tolist(), j[::-1].tolist(), self.logs[slot[::-1]].tolist(), strict=True):
                behind[x] = _add(behind[x], behind[y] + p)
            a, z = np.array(ahead[first:last]), np.array(behind[first : last + self.longest])
            np.add.at(expect, slot, np.exp(a[i - first] + self.logs[slot] + z[j - first] - ahead[n]))
        return ahead[n]

    def score(self, words: list[bytes], expect: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word. ``expect``: gets expected piece counts by slot."""
        out = np.zeros(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            if n >= LONG_WORD:
                out[of] = [self._long(b" " + words[i], expect) for i in of.tolist()]
                continue
            for k in range(0, len(of), 8192):
                part = of[k : k + 8192]
                text = np.frombuffer(b"".join([b" " + words[i] for i in part.tolist()]), np.uint8).reshape(len(part), n + 1)
                out[part] = self._same_length(text, expect)
        return out

    def by_piece(self, expect: np.ndarray) -> np.ndarray:
        """Counts by slot, in the order of the pieces given."""
        out = np.zeros(self.size)
        out[self.order] = expect
        return out
