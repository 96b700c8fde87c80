"""Packing against whole-text tokenisation, exhaustive optima and the rules of a packing."""

import collections
import functools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loam.llm import packing

TOKENIZER = Tokenizer.from_file(packing.VOCABULARY)
ODD = ["a b", "é x", " ́a", "don't 's 't", "A b c", "x\u0085y", "İstanbul ΣΑΣ Σ", "<|endoftext|> a<|startoftext|>b", "\x1c a\x1cb", "日本語 テキスト", "", " \t\n\x0b\x0c\r ", "\x00 \x00", "😀😀 👩‍👩‍👧", "H̱a, Ab.C!? x.y 'Tis,", "<|ENDOFTEXT|>", "ﬀ ǅ ß ſ.", "İ İstanbul", "word,word.word;Word:WORD!word?'s", "a\u0345b", "ᾳ Σ. ΑΣ,"]


def brute(docs, capacity):
    out = []
    for doc, text in docs:
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            held = ids[a : a + capacity]
            out.append((doc, k, a, len(held), zlib.crc32(held.tobytes())))
    return sorted(out, key=repr)


def check(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity."""
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for held in at.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def documents():
    rng = np.random.default_rng(3)
    words = ["token", "packing", "Élan", "zweite", "x1", "...", "don't"]
    docs = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate(rng.integers(0, 120, 300).tolist())]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (5, "again"), (7, None), (8, "w " * 5000), (9, "y" * 3000)]
    return docs


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_and_places(spark, monkeypatch, capacity):
    docs = documents()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, LENGTH int").repartition(3)
    packed = packing.pack_documents(df, capacity=capacity, keep_ids=True)
    rows = packed.collect()
    want = brute(docs, capacity)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == want
    n = check(rows, capacity)
    total = sum(w[3] for w in want)
    assert -(-total // capacity) <= n <= -(-total // capacity) * 1.03 + 1
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert len(joined) == n and all(joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) for r in rows)


def test_long_text_in_slices(spark, monkeypatch):
    texts = [("ab c\n" * 700, 1), ("z" * 5000 + " end", 2), ("é ü" * 900, 3)]
    run = packing._pieces(packing.VOCABULARY, 64, False)
    monkeypatch.setattr(packing, "SLICE", 1000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for _, d in texts]), pa.array([t for t, _ in texts])], ["doc_id", "text"])
    got = [tuple(r.values())[:5] for b in run(iter([batch])) for r in b.to_pylist()]
    assert sorted(got, key=repr) == brute([(d, t) for t, d in texts], 64)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def optimum(counts):
    """The least number of bins, by trying every maximal way to fill the bin of the largest piece."""
    capacity = len(counts) - 1

    @functools.cache
    def best(left):
        j = next((w for w in range(capacity, 0, -1) if left[w]), 0)
        if not j:
            return 0

        def fills(left, room, most):
            yield left
            for w in range(min(room, most), 0, -1):
                if left[w]:
                    yield from fills(left[:w] + (left[w] - 1,) + left[w + 1 :], room - w, w)

        return 1 + min(best(x) for x in set(fills(left[:j] + (left[j] - 1,) + left[j + 1 :], capacity - j, j)))

    return best(tuple(counts))


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(11)
    fixed = rules = 0
    for _ in range(400):
        capacity = int(rng.integers(6, 25))
        low = int(rng.integers(1, max(2, capacity // 3)))
        counts = np.bincount(rng.integers(low, capacity + 1, rng.integers(1, 10)), minlength=capacity + 1)
        p = packing.Packing(counts)
        packing.reduce(p)
        assert p.fixed + optimum(p.left.tolist()) == optimum(counts.tolist()), counts
        fixed += p.fixed
        rules += any(len(g.entries) == 3 or sum(e[1] for e in g.entries) == 3 for g in p.groups)
        packing.best_fit(p)
        assert not p.left.any() and p.handed.tolist() == counts.tolist()
        assert all(g.room >= 0 and sum(e[0] * e[1] for e in g.entries) == capacity - g.room for g in p.groups)
    assert fixed > 400 and rules > 5


def plain_best_fit(counts):
    """Piece by piece."""
    rooms = []
    for w in range(len(counts) - 1, 0, -1):
        for _ in range(counts[w]):
            k = min((k for k, r in enumerate(rooms) if r >= w), key=lambda k: rooms[k], default=None)
            if k is None:
                rooms.append(len(counts) - 1)
                k = len(rooms) - 1
            rooms[k] -= w
    return sorted(rooms)


def test_best_fit_by_counts_is_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = np.bincount(rng.integers(1, 41, rng.integers(1, 200)), minlength=101)
        p = packing.Packing(counts)
        packing.best_fit(p)
        assert sorted(g.room for g in p.groups for _ in range(g.bins)) == plain_best_fit(counts.tolist())
        places = sorted((length, first + i) for g in p.groups for length, k, first, _ in g.entries for i in range(k * g.bins))
        assert places == [(w, i) for w in range(101) for i in range(counts[w])]
