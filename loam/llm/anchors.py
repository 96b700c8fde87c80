"""Finding all repeated windows of a corpus without shuffling every window.

A window is L consecutive units (words or bytes). Its anchor is the k-gram inside it with the least hash, leftmost on ties, so
equal windows have equal anchors at equal offsets. A maximal run of windows with one anchor occurrence is an edge of the
compacted de Bruijn graph: the anchor (node) with one context around it. Edges are few (about 2 in L-k+2 units). Only anchors that
occur twice matter; where all their contexts are equal, the path does not branch and its windows are repeated as a whole.
Where contexts differ, one representative of each is looked at window by window, at its source coordinates.

Hashes are 64 bits and are compared only among rows with the same 64-bit anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, powers, text_chunks, written
from .scan import prefix_sums

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Windows that are looked at together: what is computed of them stays in the processor's cache.
BLOCK = 1 << 14
#: Places are start << SIG | bits of the text's hash: a check of ``keyed``, by which texts of one key are equal.
SIG = 20

#: Makes units (uint64 hashes) and each row's first unit from (bytes, offsets).
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

#: ``nxt``: the context of the edge that follows in the same text, 0 for the last.
EDGES = "m long, ctx long, doc long, at long, n int"
LINKED = EDGES + ", nxt long"


class Ranges:
    """64-bit hashes of ranges of a unit sequence."""

    def __init__(self, x: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(BASE, len(x)), dtype=np.uint64)])
        self.back = powers(INVERSE, len(x) + 1)

    def __call__(self, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.back[a])


def anchor_runs(ranges: Ranges, windows: int, gram: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: (first window, place of the anchor, its hash).

    The anchor is the least of a window's ``w`` grams, the leftmost on ties (of their hashes' leading 44 bits).
    """
    low = np.uint64((1 << SIG) - 1)
    number = np.arange(BLOCK + w - 1, dtype=np.uint64)
    starts, places, hashes = [], [], []
    for i in range(0, windows, BLOCK):
        count = min(BLOCK, windows - i) + w - 1
        grams = ranges(slice(i, i + count), slice(i + gram, i + gram + count))
        v = (grams & ~low) | number[:count]
        size = 1
        while 2 * size <= w:
            v = np.minimum(v[: len(v) - size], v[size:])
            size *= 2
        if size < w:
            v = np.minimum(v[: len(v) - (w - size)], v[w - size :])
        new = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        at = (v[new] & low).view(np.int64)
        starts.append(new + i)
        places.append(at + i)
        hashes.append(grams[at])
    start, place, h = (np.concatenate(x) for x in (starts, places, hashes))
    new = np.append(True, place[1:] != place[:-1])
    return start[new], place[new], h[new]


def edges_of(x: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """The edges of rows whose units are x[first[i]:first[i+1]]: anchor, context, row, start in the row, number of windows."""
    rows = np.flatnonzero(np.diff(first) >= window)
    if not len(rows):
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    ranges = Ranges(x)
    start, place, h = anchor_runs(ranges, len(x) - window + 1, gram, window - gram + 1)
    begin, end = first[rows], first[rows + 1] - window + 1  # a row's windows; runs are cut there
    cut = np.unique(np.concatenate([start, begin]))
    run = np.searchsorted(start, cut, "right") - 1
    of = np.searchsorted(begin, cut, "right") - 1
    inside = (of >= 0) & (cut < end[of])
    s, run, of = cut[inside], run[inside], of[inside]
    n = np.minimum(np.append(cut[1:], len(x))[inside], end[of]) - s
    at = place[run]
    ctx = mix64(ranges(s, s + n + window - 1) + (at - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + n.astype(np.uint64))
    return h[run], ctx, rows[of], s - begin[of], n


def sigs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    view = memoryview(data)
    return np.array([xxhash.xxh64_intdigest(view[a:b]) & ((1 << SIG) - 1) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], np.int64)


def _edges(units: Units, window: int, gram: int, step: int, linked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, step):
            x, first = units(data, offsets)
            m, ctx, row, start, n = edges_of(x, first, window, gram)
            doc = np.asarray(rows.column("doc"))[row]
            at = start << SIG | sigs(data, offsets)[row]
            cols = [pa.array(m.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc), pa.array(at), pa.array(n.astype(np.int32))]
            if linked:
                follows = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
                cols.append(pa.array(np.where(follows, np.append(ctx[1:], np.uint64(0)) if len(ctx) else ctx, np.uint64(0)).view(np.int64)))
            yield pa.RecordBatch.from_arrays(cols, ["m", "ctx", "doc", "at", "n", "nxt"][: len(cols)])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text: ``doc`` is the same for rows of one doc_id and one text only, and in the order of doc_id, null first.

    It is the doc_id itself unless some id is null or repeated; then it is the rank of (doc_id, SHA-256 of the text) among the
    distinct ones, from a scan over all tasks, and the rows are stored with it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("doc_id is null or c > 1")
    if again.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    rows = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    ranks = prefix_sums(rows.select("doc_id", "digest").distinct(), [], ["doc_id", "digest"], tag="keys").select(F.col("at").alias("doc"), F.col("doc_id").alias("id"), F.col("digest").alias("d"))
    return written(rows.join(ranks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))).select("doc", "doc_id", "text"), "keyed")


def join_apart(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with an aggregate ``found`` over the same keys; ``found`` has ``same``, the maximum of the last key.

    Joined on the keys alone, the aggregate's own shuffle would serve the join, and Spark could not split a hot key's partition.
    The additional condition makes both sides be shuffled for the join, which is then split where it is skewed.
    """
    found = found.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in found.columns if c not in keys])
    on = [F.col(k) == F.col(f"{k}_") for k in keys] + [F.col(keys[-1]) == F.col("same")]
    return rows.join(found, on).drop("same", *[f"{k}_" for k in keys])


def repeated_edges(docs: DataFrame, units: Units, window: int, gram: int, step: int, linked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges whose anchor occurs more than once, their contexts), both stored.

    Anchors are counted with map-side sums; the join that follows is a plain sort-merge join of two shuffled sides, so a hot
    anchor's partition is split at run time. ``docs`` is ``keyed``. Contexts: m, ctx, copies, first (doc, at, n); if ``linked`` also
    nxt, the context that follows all copies (null if there are several, or none).
    """
    edges = docs.mapInArrow(_edges(units, window, gram, step, linked), LINKED if linked else EDGES)
    often = edges.groupBy("m").agg(F.count("*").alias("c"), F.max("m").alias("same")).where("c > 1").drop("c")
    edges = written(join_apart(edges, often, ["m"]), "edges")
    same = [F.when((F.min("nxt") == F.max("nxt")) & (F.min("nxt") != 0), F.min("nxt")).alias("nxt")] if linked else []
    contexts = edges.groupBy("m", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "at", "n")).alias("first"), *same)
    contexts = written(contexts, "contexts")
    return edges.drop("nxt"), contexts


def branching(contexts: DataFrame) -> DataFrame:
    """One place for each context of an anchor that has several: m, copies, contexts (of the anchor), doc, at, n."""
    several = contexts.groupBy("m").agg(F.count("*").alias("contexts"), F.max("m").alias("same")).where("contexts > 1")
    return join_apart(contexts, several, ["m"]).select("m", "copies", "contexts", "first.*")


def with_places(docs: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with the distinct ``places`` of each; those of a key are in one text, so a list is no longer than that.

    Every caller's text shuffle is the same one.
    """
    listed = places.groupBy("doc").agg(F.collect_set(F.struct(*columns)).alias("places"))
    return docs.join(listed.hint("shuffle_hash"), "doc", "left")


def place_lists(rows: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each place, the places) of a batch with a column ``places``."""
    lists = rows.column("places")
    count = np.asarray(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(rows.num_rows), count), lists.flatten()
