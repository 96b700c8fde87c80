"""Suffix-array dedup on bytes: what an earlier 100-byte string repeats is removed, the earliest copy stays.

Only text around 20-grams that occur twice can hold a repeated string. Such text is cut into segments by its anchors (see
``anchors``), so that equal strings stand in segments of one anchor, at equal distances from it. Equal segments of one anchor are
sorted once, for all of them. The others are brought together by anchor and suffix-sorted in pieces of about a MB by two-stage
sorting; adjacent common prefixes of 100 bytes or more give the groups of equal strings, and a group's earliest place decides
which of them go. Each removed string is one that a suffix array found, or an equal segment's at the same offset.

An anchor with more than SORTED segments is dealt into several pieces. Each piece's groups are represented by their earliest
string, and the representatives of all pieces are merged by their hashes.

Order: by doc_id, then by start; a null doc_id comes first. Cases: null and empty texts have no bytes; texts under 100 bytes lose
nothing; repeated rows (same doc_id and text) are one place, so neither is earlier than the other; rows with one doc_id, or none, and
different texts are different documents, in the order of their texts' SHA-256; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import SIG, Ranges, join_apart, keyed, place_lists, repeated_edges, sigs, with_places
from .common import raw_bytes, table, text_chunks, written
from .decontaminate import spread
from .substring import mask_of
from .suffixsort import Blocks, share_prefix, two_stage

WINDOW, GRAM, STEP = 100, 20, 1 << 19
#: Contexts of one anchor that are sorted in one piece: some 180 bytes each, so 3 MB of text and 60 times that while sorting.
SORTED = 16_000
PIECE = 1 << 20
SEGMENTS = "m long, part int, ctx long, copies long, doc long, at long, n int, segment binary"
#: Runs of a context's windows: ``later`` ones repeat an earlier string; others repeat none, but the context has copies. A row with
#: ``h`` is a single window's, the earliest of its group in a piece of several.
RUNS = "m long, ctx long, copies long, doc long, at long, off int, n int, later boolean, h long"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

#: A fixed random number for each byte.
BYTE_HASH = np.random.default_rng(2024).integers(0, 2**64, 256, np.uint64)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_HASH[data], offsets


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed places."""
    for batch in batches:
        for rows, data, offsets in text_chunks(iter([batch.filter(batch.column("places").is_valid())]), STEP):
            sig, (row, places) = sigs(data, offsets), place_lists(rows)
            at, n = np.asarray(places.field("at")), np.asarray(places.field("n")).astype(np.int64)
            mine = np.flatnonzero((at & ((1 << SIG) - 1)) == sig[row])
            row, at, n = row[mine], at[mine], n[mine]
            s, raw = offsets[row] + (at >> SIG), data.tobytes()
            cut = pa.array([raw[a:b] for a, b in zip(s.tolist(), (s + n + WINDOW - 1).tolist(), strict=True)], pa.binary())
            known = {"doc": pa.array(np.asarray(rows.column("doc"))[row]), "segment": cut}
            names = [c.split()[0] for c in SEGMENTS.split(", ")]
            yield pa.RecordBatch.from_arrays([known[c] if c in known else places.field(c).take(pa.array(mine)) for c in names], names)


def equal_windows(doc: np.ndarray, at: np.ndarray, n: np.ndarray, segments: pa.Array) -> np.ndarray:
    """For each window (in order of segment and offset) whether it repeats an earlier one among the segments; by suffix array."""
    data, offsets, _ = raw_bytes(segments)
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(int(first[-1]), np.uint16)
    text[spread(first[:-1], size)] = data[offsets[0] : offsets[-1]].astype(np.uint16) + 1
    blocks = Blocks(text)
    order = two_stage(text, blocks)
    equal = share_prefix(order, blocks, WINDOW)
    group = np.concatenate([[0], np.cumsum(~equal)])
    some = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
    p, group = order[some], group[some]
    seg = np.searchsorted(first, p, "right") - 1
    offset = p - first[seg]
    place = at[seg] + (offset << SIG)
    by = np.lexsort((place, doc[seg], group))
    seg, offset, group, place = seg[by], offset[by], group[by], place[by]
    earliest = np.concatenate([[True], group[1:] != group[:-1]])
    lead = np.maximum.accumulate(np.where(earliest, np.arange(len(group)), 0))
    again = (doc[seg] != doc[seg[lead]]) | (place != place[lead]) if len(group) else np.zeros(0, bool)
    later = np.zeros(int(n.sum()), bool)
    later[(np.cumsum(n) - n)[seg[again]] + offset[again]] = True
    return later


def _decided(t: pa.Table) -> pa.RecordBatch:
    """RUNS of the segments of a piece. Of anchors dealt into parts (``part`` >= 0) the windows that are not later have an h."""
    m, part, ctx, copies, doc, at, n = (np.asarray(t.column(c)) for c in ("m", "part", "ctx", "copies", "doc", "at", "n"))
    segments, n = t.column("segment").combine_chunks(), n.astype(np.int64)
    later = equal_windows(doc, at, n, segments)
    seg, off = np.repeat(np.arange(len(n)), n), spread(np.zeros(len(n), np.int64), n)
    open_ = (part[seg] >= 0) & ~later
    kind = np.where(later, 1, np.where(open_, 3, np.where(copies[seg] > 1, 2, 0)))
    new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 3)]) if len(seg) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(seg)))
    start, length = start[kind[start] > 0], length[kind[start] > 0]
    s, k = seg[start], kind[start]
    h = np.zeros(len(start), np.int64)
    if (k == 3).any():
        data, offsets, _ = raw_bytes(segments)
        i = (offsets[s] + off[start])[k == 3] - offsets[0]
        h[k == 3] = Ranges(BYTE_HASH[data[offsets[0] : offsets[-1]]])(i, i + WINDOW).view(np.int64)
    cols = [m[s], ctx[s], copies[s], doc[s], at[s], off[start].astype(np.int32), length.astype(np.int32)]
    cols = [pa.array(c) for c in cols] + [pa.array(np.where(k == 3, False, k == 1), mask=k == 3), pa.array(h, mask=k != 3)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in RUNS.split(", ")])


def _sorted_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of m and part; all with one m and part go into one piece."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:  # pieces of a batch, so that no piece grows with the batch size
            some = batch.slice(start, 4096)
            start += 4096
            held.append(some)
            size += some.num_rows * 2 * WINDOW
            if size >= PIECE:
                t = pa.Table.from_batches(held)
                m, part = np.asarray(t.column("m")), np.asarray(t.column("part"))
                differs = np.flatnonzero((m != m[-1]) | (part != part[-1]))
                cut = int(differs[-1]) + 1 if len(differs) else 0
                if cut:
                    yield _decided(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    size = (t.num_rows - cut) * 2 * WINDOW
    if held:
        yield _decided(pa.Table.from_batches(held))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc, at, n: runs of n windows that stand somewhere earlier too. ``docs`` is ``keyed``."""
    edges, contexts = repeated_edges(docs, byte_units, WINDOW, GRAM, STEP)
    sizes = contexts.groupBy("m").agg(F.count("*").alias("c"), F.max("m").alias("same"))
    parts = F.ceil(F.col("c") / SORTED)
    part = F.when(parts > 1, F.pmod("ctx", parts)).otherwise(-1).cast("int").alias("part")
    probes = join_apart(contexts, sizes, ["m"]).select("m", "ctx", "copies", part, "first.*")
    listed = with_places(docs, probes, "at", "n", "m", "ctx", "copies", "part").select("doc", "text", "places")
    segments = listed.mapInArrow(_segments, SEGMENTS).repartition("m", "part").sortWithinPartitions("m", "part")
    runs = written(segments.mapInArrow(_sorted_pieces, RUNS), "runs")
    of_parts = runs.where("h is not null").withColumn("place", F.col("at") + F.shiftleft(F.col("off").cast("long"), SIG))
    earliest = of_parts.groupBy("m", "h").agg(F.min(F.struct("doc", "place")).alias("lead"), F.max("h").alias("same"))
    merged = join_apart(of_parts, earliest, ["m", "h"]).withColumn("later", F.struct("doc", "place") != F.col("lead"))
    decided = runs.where("h is null").unionByName(merged.select(*runs.columns)).where("later or copies > 1")
    decided = decided.select("m", "ctx", F.col("doc").alias("d"), F.col("at").alias("a"), "off", F.col("n").alias("windows"), "later")
    gone = edges.join(decided, ["m", "ctx"]).where("later or doc != d or at != a")
    return gone.select("doc", (F.col("at") + F.shiftleft(F.col("off").cast("long"), SIG)).alias("at"), F.col("windows").alias("n"))


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, 2 << 20):
            sig, out = sigs(data, offsets), []
            for i, (doc, places) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("places").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                n, spans, kept = len(text), 0, text
                if places:
                    gone = mask_of(n, places, int(sig[i]), WINDOW)
                    spans, kept = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), text[~gone]
                kept = kept.tobytes()
                out.append((doc, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()][: 1 + with_text]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(types)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def without_later_copies(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each document: bytes, bytes and spans removed, digest of what is kept, and on demand the kept bytes."""
    docs = keyed(docs)
    listed = with_places(docs, repeated_bytes(docs), "at", "n").select("doc_id", "text", "places")
    return listed.mapInArrow(_kept(with_text), KEPT + ", kept binary" * with_text)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_later_copies(table(spark, sf_dir, "documents"))


#: The same in DuckDB: every string of 100 bytes, as hexadecimal digits, against the first place of its hash.
ORACLE = r"""
with t as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
win as (select r, doc_id, i, hash(substr(x, 2 * i + 1, 200)) as k from (select r, doc_id, x, unnest(range(0, length(x) // 2 - 99)) as i from t where length(x) >= 200) y),
first_ as (select k, min({'d': coalesce(doc_id, -9223372036854775808), 'i': i}) as f from win group by k having count(*) > 1),
later as (select r, i, lag(i) over (partition by r order by i) as before from win join first_ on win.k = first_.k where {'d': coalesce(doc_id, -9223372036854775808), 'i': i} <> f),
runs as (select r, g, min(i) as a, max(i) + 100 as b from (select r, i, sum(case when before is null or i > before + 100 then 1 else 0 end) over (partition by r order by i) as g from later) z group by r, g),
gaps as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as from_ from runs),
kept as (select g.r, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' order by a) || substr(max(x), 2 * max(b) + 1) as x from gaps g join t on g.r = t.r group by g.r)
select t.doc_id, cast(length(t.x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.x, t.x))) as kept_sha256
from t left join kept on t.r = kept.r
"""
