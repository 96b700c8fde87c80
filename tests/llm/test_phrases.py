"""Phrase mining against a version that counts every run of words."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, support, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            f.update((lang or "und", w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(g == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in found.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def documents(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "New", "york", "É", "a-b", "ß", "\x1c", "x y", "to", "be", "The"] + [f"w{i}" for i in range(30)]
    fixed = ["the quick brown fox", "New York City", "to be or not to be", "la la la la la la"]
    docs = []
    for _ in range(250):
        words = []
        for _ in range(rng.randrange(0, 40)):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocab[:6]) if rng.random() < 0.6 else rng.choice(vocab))
            words.append(rng.choice([" ", " ", "  ", "\t", "\t ", ". ", ",", "\n", "\x0b", "\r\n", "!"]))
        docs.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(words)))
    return docs + [("en", None), ("fr", ""), (None, "...")] + docs[:20]


@pytest.mark.parametrize("support,top", [(5, 2000), (12, 7)])
def test_equals_brute_force(spark, support, top):
    docs = documents(support)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, H1 long, word string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, support, top).collect())
    assert got == brute(docs, support, top) and len(got) > 20


def test_nothing_frequent(spark):
    for rows in ([], [("en", "one two"), (None, None)]):
        assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_long_text_in_parts(monkeypatch):
    docs = documents(9)
    text = " . ".join(t or "" for _, t in docs)
    monkeypatch.setattr(phrases, "SLICE", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", None, "en"]), pa.array([text, "", text[:300]])], ["lang", "text"])
    assert len(list(phrases.parts_of(iter([batch])))) > 10
    want, n = collections.Counter(), collections.Counter()
    for lang, t in (("en", text), ("en", text[:300])):
        for p in re.split(r"[.,;:!?\x0A-\x0D]", t.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", p)
            want.update(zip(w, w[1:], strict=False))
            n.update(w)
    hashes, counted = {}, collections.Counter()
    for b in phrases._count(iter([batch])):
        for r in b.to_pylist():
            hashes[r["h"] % 2**64] = r["word"].decode()
            counted[r["word"].decode()] += r["c"]
    assert counted.pop("") == sum(n.values()) and counted == n
    stream, pairs = phrases.Stream(), collections.Counter()
    for h, lang in stream.parts(iter([batch])):
        k = len(h) - 3
        whole = (h[:k] != phrases.CLOSING) & (h[1 : k + 1] != phrases.CLOSING)
        pairs.update((hashes[x], hashes[y]) for x, y in zip(h[:k][whole].tolist(), h[1 : k + 1][whole].tolist(), strict=True))
    assert pairs == want


def test_prefix_over_several_tasks_and_batches(monkeypatch):
    """Whatever the cuts, what the tasks count adds up to all phrases of the support."""
    rng = np.random.default_rng(4)
    rows = sorted({("en" if a else "de", int(b), int(c), int(d), int(e)): int(n) for a, b, c, d, e, n in zip(*(rng.integers(0, k, 4000) for k in (2, 3, 3, 6, 9, 5)), strict=True)}.items())
    rows = [(*k[:4], k[4] or None, n + 1) for k, n in rows]
    rows = [(lang, h1 + 1, h2 + 1, h3 + 1, h4, c) for lang, h1, h2, h3, h4, c in rows]
    rows.sort(key=lambda r: (*r[:4], -1 if r[4] is None else r[4]))
    want = collections.Counter()
    for lang, h1, h2, h3, h4, c in rows:
        want[lang, h1, h2, h3, None] += c
        if h4 is not None:
            want[lang, h1, h2, h3, h4] += c
    monkeypatch.setattr(phrases, "MOST_HELD", 40)
    for size, tasks in ((7, 1), (50, 3), (10_000, 4)):
        total = collections.Counter()
        for part in np.array_split(np.arange(len(rows)), tasks):
            own = [rows[i] for i in part]
            batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own[i : i + size], strict=True), (pa.string(), *[pa.int64()] * 5), strict=True)], ["lang", "h1", "h2", "h3", "h4", "c"]) for i in range(0, len(own), size)]
            for b in phrases._grow(20)(iter(batches)):
                for r in b.to_pylist():
                    total[r["lang"], r["h1"], r["h2"], r["h3"], r["h4"]] += r["c"]
        assert {k: v for k, v in total.items() if v >= 20} == {k: v for k, v in want.items() if v >= 20}


def test_equal_mixes_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases, "_rotated", lambda x, by: x * np.uint64(0))
    a, b = np.array([1, 1, 1, 2], np.uint64), np.array([5, 6, 5, 5], np.uint64)
    columns, n = phrases.summed([a, b])
    assert sorted(zip(columns[0].tolist(), columns[1].tolist(), n.tolist())) == [(1, 5, 2), (1, 6, 1), (2, 5, 1)]
