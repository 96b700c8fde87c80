"""SimHash near-dedup with pivot distance tables.

Fingerprints of 64 bits; two link when at most ``radius`` = 2 bits differ. Copies share a fingerprint and are one node from the
start. Two fingerprints within 2 bits agree in at least two of four 16-bit blocks, so six tables, keyed by two blocks each, bring
all pairs together. In each bucket the distances to PIVOTS reference fingerprints are computed; by the triangle inequality a pair
whose coordinates differ by more than 2 anywhere is discarded unseen; what survives is verified. A bucket yields a spanning
forest of its links, never all pairs. Buckets with more than BUCKET fingerprints are split by a coordinate first: into intervals
of WIDTH distances, each with the 2 distances that follow it, so that every pair within reach shares an interval; those still
too large by the next coordinate, and so on.

Cases: a text without words (null, empty, blank) has fingerprint 0 and is linked like any other; fewer words than a shingle are
one shingle; repeated rows and copies share a component; an empty table gives an empty table; a null doc_id is no component's
smallest unless all are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, held, table, text_chunks, written
from .components import components

WORDS, RADIUS, PIVOTS, BUCKET, WIDTH = 3, 2, 16, 4000, 4
STEP = 4 << 20
#: Reference fingerprints.
REFERENCES = np.random.default_rng(7).integers(0, 2**64, PIVOTS, np.uint64)


def fingerprint(words: list[bytes], size: int) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    cuts = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.array([digest(view[a:b], 42) for a, b in cuts], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, STEP):
            raw = data.tobytes().translate(LOWER)
            fp = [fingerprint(raw[a:b].split(), size) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """``root`` after joining the trees of each a[i] and b[i]; every entry then names its tree's least member."""
    for x, y in zip(root[a].tolist(), root[b].tolist(), strict=True):
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def survivors(far: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a[i], b[i]) those whose rows of the pivot table differ by ``radius`` at most in every coordinate from ``first`` on."""
    for j in range(first, far.shape[1]):
        ok = np.abs(far[a, j] - far[b, j]) <= radius
        a, b = a[ok], b[ok]
    return a, b


def links_in_buckets(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as pairs of fingerprints) of the links inside buckets, through the pivot table."""
    far = np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    order = np.lexsort((far[:, 0], key))
    key, fp, far = key[order], fp[order], far[order]
    root, live, step, n = np.arange(len(fp)), np.arange(len(fp)), 1, len(fp)
    while len(live):
        live = live[live + step < n]
        other = live + step
        near = (key[live] == key[other]) & (far[other, 0] - far[live, 0] <= radius)  # sorted: none further on either
        live = live[near]
        other = live + step
        a, b = live[root[live] != root[other]], other[root[live] != root[other]]
        a, b = survivors(far, a, b, radius, 1)
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if ok.any():
            root = roots(a[ok], b[ok], root)
        step += 1
    child = np.flatnonzero(root != np.arange(n))
    return fp[child], fp[root[child]]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key; a bucket is kept until it is whole."""

        def pairs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = links_in_buckets(key, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows in batches:
            key = np.concatenate([key, np.asarray(rows.column("key"))])
            fp = np.concatenate([fp, np.asarray(rows.column("fp"))])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield pairs(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield pairs(key, fp)

    return run


def split(buckets: DataFrame, pivot: int, radius: int) -> DataFrame:
    """Rows (key, fp) in intervals of their distance to a reference; a row also goes where the distance before it does."""
    far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(REFERENCES[pivot].view(np.int64)))))
    own = F.floor(far / WIDTH)
    cells = F.when(far % WIDTH < radius, F.array(own, own - 1)).otherwise(F.array(own))
    return buckets.select("key", "fp", F.explode(cells).alias("cell")).select(F.xxhash64("key", "cell").alias("key"), "fp")


def linked(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` of ``nodes`` within ``radius`` (at most 2) bits."""
    if radius > 2:
        raise ValueError("four blocks find pairs within 2 bits")
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    two = [(i, j) for i in range(4) for j in range(i)]
    keys = [F.lit(n << 32) + F.shiftleft(blocks[i], 16) + blocks[j] for n, (i, j) in enumerate(two)]
    buckets, links = nodes.select("fp", F.explode(F.array(*keys)).alias("key")), None
    for pivot in range(PIVOTS + 1):
        large = written(buckets.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > bucket).select("key"), "large")
        done = pivot == PIVOTS or large.isEmpty()
        fit = buckets if done else buckets.join(held(large), "key", "left_anti")
        found = fit.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if done:
            break
        buckets = written(split(buckets.join(held(large), "key", "left_semi"), pivot, radius), "split")
    return links


def with_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    prints = written(fingerprints(docs, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    star = components(linked(nodes, radius)).withColumnsRenamed({"u": "fp", "v": "root"})
    rooted = nodes.join(star, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
