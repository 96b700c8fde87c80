"""Null and repeated ids, broken media, benchmarks of many blocks, frequent passages."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import decontaminate, jpeg, lm, media, substring, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_with_one_signature(n):
    """Texts of other words that share the 20 bits by which rows were once told apart."""
    import xxhash

    seen = collections.defaultdict(list)
    for k in range(10**6):
        text = " ".join(f"w{k}x{j}" for j in range(41 + k % 20))
        seen[xxhash.xxh64_intdigest(text.encode()) & 0xFFFFF].append(text)
        if len(seen[xxhash.xxh64_intdigest(text.encode()) & 0xFFFFF]) == n:
            return seen[xxhash.xxh64_intdigest(text.encode()) & 0xFFFFF]


def rows_of_shared_ids():
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(None, " ".join(f"u{k}x{j}" for j in range(20)) + (" " + " ".join(passage) if k % 40 == 0 else "")) for k in range(3000)]
    rows += [(7, "the same row " * 20)] * 3000 + [(8, " ".join(passage[:50]) + f" {k}") for k in range(5)]
    rows += [(None, t) for t in texts_with_one_signature(2)] + [(None, None), (None, None), (9, "")]
    rng.shuffle(rows)
    return rows


def brute3(rows):
    said = [WORD.findall(t or "") for _, t in rows]
    n = collections.Counter(tuple(w[i : i + 35]) for w in said for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(rows, said, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if n[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def brute9(rows):
    """Documents in the order of id (null first), then of their text's SHA-256; equal rows are one place."""
    order = {k: i for i, k in enumerate(sorted({(d, t or "") for d, t in rows}, key=lambda x: (-math.inf if x[0] is None else x[0], hashlib.sha256(x[1].encode()).hexdigest())))}
    first: dict[bytes, tuple] = {}
    for (d, t), i in sorted(order.items(), key=lambda x: x[1]):
        b = t.encode()
        for j in range(len(b) - 99):
            first.setdefault(b[j : j + 100], (i, j))
    out = []
    for d, t in rows:
        b, i = (t or "").encode(), order[d, t or ""]
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - 99):
            if first[b[j : j + 100]] != (i, j):
                gone[j : j + 100] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_null_and_repeated_ids(spark):
    rows = rows_of_shared_ids()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, doc int").repartition(6)
    assert sorted((tuple(r) for r in substring.without_repeats(df).collect()), key=repr) == brute3(rows)
    assert sorted((tuple(r) for r in suffix_dedup.without_later_copies(df).collect()), key=repr) == brute9(rows)


def test_scores_of_shared_ids(spark):
    rows = rows_of_shared_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = lm.score_documents(df).collect()
    # The same texts under ids of their own, none of them held out, have the same scores.
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 10)
    apart = {next(ids): t for _, t in rows}
    alone = lm.score_documents(spark.createDataFrame(list(apart.items()), "doc_id long, text string")).collect()
    said = lambda found: sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found)
    assert not any(r.held_out for r in got) and said(got) == said(alone)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((d, len((t or "").split()) + 1) for d, t in rows), key=repr)


def jpeg_of_many_kinds():
    rng = np.random.default_rng(1)
    return jpeg.store_payloads([rng.integers(0, 256, 64 * n, dtype=np.uint8) for n in (1, 6)])


def looked(files):
    batch = pa.RecordBatch.from_arrays([pa.array(files, pa.binary())], ["media"])
    return [r for b in media._look(iter([batch])) for r in b.to_pylist()]


def test_no_bytes_break_the_job():
    """Every prefix of a file, and random changes of it, give nulls or an image."""
    rng = random.Random(3)
    for file in jpeg_of_many_kinds():
        files = [file[:n] for n in range(len(file))]
        for _ in range(1500):
            b = bytearray(file)
            for _ in range(rng.randrange(1, 4)):
                b[rng.randrange(len(b))] = rng.randrange(256)
            files.append(bytes(b))
        rows = looked([*files, file, None, b""])
        assert len(rows) == len(files) + 3 and rows[-3]["width"] and rows[-1]["width"] is None and rows[-2]["width"] is None
        assert all(r["width"] is None for r in rows[:130])


def test_clashing_names_of_media(spark):
    file = jpeg_of_many_kinds()[0]
    df = spark.createDataFrame([(1, file, "a", "b", 2.0)], "WIDTH int, pic binary, width_in string, media string, Thumbnail double")
    got = media.image_features(df, "pic")
    assert got.columns == ["WIDTH_in_", "pic", "width_in", "media", "Thumbnail_in", "width", "height", "thumbnail", "thumbnail_sha256", "thumbnail_dhash"]
    r = got.first()
    assert (r["WIDTH_in_"], bytes(r["pic"]), r["width_in"], r["media"], r["Thumbnail_in"]) == (1, file, "a", "b", 2.0) and r["width"] >= 8


@pytest.mark.parametrize("block", [60, 300, 10**7])
def test_benchmark_in_passes(spark, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(None, None), (3, "")]
    items = [(f"i{k}", " ".join(docs[k][1].split()[2:14])) for k in range(0, 30, 2)] + [("x", "w1 w2"), ("x", None), (None, "w3")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = sorted((tuple(r) for r in decontaminate.find_contamination(d, b).drop("items", "spans").collect()), key=repr)
    got = sorted((tuple(r) for r in decontaminate.find_contamination(d, b, block_bytes=block).drop("items", "spans").collect()), key=repr)
    assert got == want and any(r[-1] for r in got)
    clean = sorted((tuple(r) for r in decontaminate.decontaminated(d, b, block_bytes=block).collect()), key=repr)
    assert [r[0] for r in clean] == [r[0] for r in want if not r[-1]]
