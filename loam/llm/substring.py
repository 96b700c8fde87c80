"""Substring dedup on words: a De Bruijn graph of word k-mers, compacted and verified (see ``anchors``).

Every word that lies in a window of 35 words occurring anywhere else is removed, all copies alike. Windows are judged on the
input. The graph's nodes are 8-grams, of which only each window's least one, its anchor, is kept; its edges are the words around an
anchor, runs of windows already. Only text around anchors that occur twice takes part.

An edge that occurs more than once, and after all of whose copies the same edge follows, as often, does not branch: such edges are
compacted into paths by joins that double the distance looked back at (``paths``). A path stands as a whole at each place of its
first edge. Its words are read at the source coordinates of its first copy and digested, and every other place is verified
against that digest before its words go. Where edges of one anchor branch, one of each is looked at window by window, at its
source coordinates; windows are compared by 64-bit hashes among those of one anchor.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; repeated rows (same doc_id, same text) count
as two places, so both lose what they share; rows with one doc_id, or none, and different texts are different documents (see
``keyed``); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import SIG, Ranges, branching, join_apart, keyed, place_lists, repeated_edges, sigs, with_places
from .common import table, text_chunks, word_hashes, written
from .decontaminate import spread

WINDOW, GRAM, STEP = 35, 8, 2 << 20
#: Windows of branching edges; or, with a digest, paths: their first edge's anchor and context (h).
WINDOWS = "m long, h long, doc long, at long, copies long, digest binary"
#: Doublings; a path of 2 ** 60 edges is longer than any corpus.
MOST_DOUBLINGS = 60
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text."""
    raw, counts, parts = data.tobytes(), [0], []
    get = word_hashes.__getitem__
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        words = raw[a:b].split()
        parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
        counts.append(len(words))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)


def span_digest(words: list[bytes], start: int, windows: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[start : start + windows + WINDOW - 1]))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the listed places: paths (those with a ``ctx``) are digested, of all others every window is hashed."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    for batch in batches:
        batch = batch.filter(batch.column("places").is_valid())
        for rows, data, offsets in text_chunks(iter([batch]), STEP):
            x, first = word_units(data, offsets)
            sig, (row, places) = sigs(data, offsets), place_lists(rows)
            doc, is_path = np.asarray(rows.column("doc")), np.asarray(places.field("ctx").is_valid())
            at, n, m, copies = (np.asarray(places.field(k)) for k in ("at", "n", "m", "copies"))
            ctx = np.asarray(places.field("ctx").fill_null(0))
            mine = (at & ((1 << SIG) - 1)) == sig[row]
            some = mine & ~is_path
            back = np.repeat(np.flatnonzero(some), n[some])
            s = spread(first[row[some]] + (at[some] >> SIG), n[some].astype(np.int64))
            h = Ranges(x)(s, s + WINDOW).view(np.int64)
            place = (s - first[row[back]]) << SIG | sig[row[back]]
            cols = [m[back], h, doc[row[back]], place, copies[back]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.nulls(len(h), pa.binary())], names)
            some = np.flatnonzero(mine & is_path)
            raw, words, digests = data.tobytes(), {}, []
            for i in some.tolist():
                r = int(row[i])
                if r not in words:
                    words = {r: raw[offsets[r] : offsets[r + 1]].split()}  # places come text by text
                digests.append(span_digest(words[r], int(at[i]) >> SIG, int(n[i])))
            cols = [m[some], ctx[some], doc[row[some]], at[some], copies[some]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(digests, pa.binary())], names)


def mask_of(size: int, places: list, sig: int, window: int, words: list[bytes] | None = None) -> np.ndarray:
    """Which units the places' windows cover; with ``words``, places that have a digest count only if theirs is the same."""
    change = np.zeros(size + 1, np.int64)
    for x in places:
        if x["at"] & ((1 << SIG) - 1) == sig:
            s = x["at"] >> SIG
            if words is not None and x["digest"] is not None and span_digest(words, s, x["n"]) != x["digest"]:
                continue
            change[s] += 1
            change[s + x["n"] + window - 1] -= 1
    return np.cumsum(change)[:-1] > 0


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, STEP):
            raw, sig = data.tobytes(), sigs(data, offsets)
            out = []
            for i, (doc, places) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("places").to_pylist(), strict=True)):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n = len(words)
                if places:
                    gone = mask_of(n, places, int(sig[i]), WINDOW, words)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] * with_text)))
            types = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: len(types)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def paths(contexts: DataFrame) -> DataFrame:
    """m, ctx, doc, at (of the first copy), n: the first edge of each path of repeated edges, and the windows of all of it.

    Edge y follows x on a path if it follows all copies of x and has no others. So each has one edge before it at most, and a path
    has an end, as texts do. Each edge looks back at one before it, in each round at twice the distance, until it sees the first.
    """
    named = contexts.where("copies > 1").select("m", "ctx", "copies", "nxt", "first.doc", "first.at", F.col("first.n").cast("long").alias("n"))
    named = written(named.withColumn("id", F.monotonically_increasing_id()), "named")
    x = named.where("nxt is not null").select(F.col("id").alias("up"), F.col("n").alias("back"), F.col("nxt").alias("ctx"), "copies")
    pairs = x.join(named.select("id", "ctx", "copies"), ["ctx", "copies"]).where("id <> up")
    # Two contexts with one hash are no reason to go on.
    pairs = pairs.groupBy("up").agg(F.count("*").alias("c"), F.min("id").alias("id"), F.min("back").alias("back")).where("c = 1")
    seen = pairs.groupBy("id").agg(F.count("*").alias("c"), F.min("up").alias("up"), F.min("back").alias("back")).where("c = 1")
    seen = written(seen.select("id", "up", "back"), "path")
    for _ in range(MOST_DOUBLINGS):
        before = seen.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("back").alias("back2"))
        step = seen.join(before, "up", "left").withColumn("back", F.col("back") + F.coalesce("back2", F.lit(0)))
        step = written(step.select("id", F.coalesce("up2", "up").alias("up"), "back", F.col("up2").isNotNull().alias("moved")), "path")
        seen = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("a path without a first edge")
    ends = seen.join(named.select("id", "n"), "id").groupBy(F.col("up").alias("id")).agg(F.max(F.col("back") + F.col("n")).alias("whole"))
    heads = named.join(seen.select("id"), "id", "left_anti").join(ends, "id", "left")
    return heads.select("m", "ctx", "doc", "at", F.coalesce("whole", "n").alias("n"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc, at, n, digest: runs of n windows that occur elsewhere too; together they are all such windows. ``docs`` is ``keyed``."""
    edges, contexts = repeated_edges(docs, word_units, WINDOW, GRAM, STEP, linked=True)
    heads = written(paths(contexts), "paths")
    branches = branching(contexts).select("doc", "at", F.col("n").cast("long").alias("n"), "m", "copies", F.lit(None).cast("long").alias("ctx"))
    probes = branches.unionByName(heads.select("doc", "at", "n", "m", F.lit(0).cast("long").alias("copies"), "ctx"))
    probes = with_places(docs, probes, "at", "n", "m", "copies", "ctx")
    windows = written(probes.select("doc", "text", "places").mapInArrow(_windows, WINDOWS), "windows")
    known = heads.select("m", "ctx", "n").join(windows.where("digest is not null").select("m", F.col("h").alias("ctx"), "digest"), ["m", "ctx"])
    # Stored, so that both sides of the next join are shuffled for it and Spark can split the partition of a frequent passage.
    known = written(known, "known")
    whole = edges.select("m", "ctx", "doc", "at").join(known, ["m", "ctx"]).select("doc", "at", "n", "digest")
    windows = windows.where("digest is null")
    often = windows.groupBy("m", "h").agg(F.sum("copies").alias("c"), F.max("h").alias("same")).where("c > 1").drop("c")
    single = join_apart(windows.where("copies = 1"), often, ["m", "h"])
    return whole.unionByName(single.select("doc", "at", F.lit(1).cast("long").alias("n"), "digest"))


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each document: words, words removed, digest of what is kept, and on demand the kept text."""
    docs = keyed(docs)
    listed = with_places(docs, repeated_windows(docs), "at", "n", "digest")
    return listed.select("doc_id", "text", "places").mapInArrow(_kept(with_text), KEPT + ", text string" * with_text)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


#: The same in DuckDB: all windows grouped by their words.
ORACLE = r"""
with t as (select row_number() over () as r, doc_id, text from documents),
d as (select r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from t),
win as (select r, i, array_to_string(w[i:i + 34], ' ') as k from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35) x),
again as (select k from win group by k having count(*) > 1),
gone as (select r, list(distinct p) as ps from (select win.r, unnest(range(win.i, win.i + 35)) as p from win join again on win.k = again.k) x group by r),
kept as (select u.r, string_agg(u.x, ' ' order by u.i) as text from (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d) u
  left join (select r, unnest(ps) as p from gone) g on u.r = g.r and u.i = g.p where g.p is null group by u.r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone.ps), 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join gone on d.r = gone.r left join kept on d.r = kept.r
"""
