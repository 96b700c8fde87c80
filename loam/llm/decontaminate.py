"""Benchmark decontamination with one FM-index for each shard of the training text.

The phrases (windows of benchmark words) are the query set: they are few, their number of bytes is checked, and sets larger than
one block are searched block by block. Documents stream through: a shard of some hundred thousand words is indexed in memory,
all phrases of the block are searched backward in it, and occurrences come back as word positions whose spans are merged. Words
that no phrase holds cannot be part of an occurrence; they all become the separator symbol, which keeps the index small. No
shuffle of text, no state beyond a shard; a document is never split, so a shard has at most SHARD bytes or one document.

A benchmark of several blocks of BLOCK_BYTES takes a pass for each: passes are stored one in place of the other, so tasks hold one
block at a time however large the benchmark is, and the driver two.

Cases: null or empty texts have no words and n_words 0; an item without words is never found; items with equal windows are all
counted; rows of one item_id are one item with the windows of all of them; a null item_id is an item named by the empty text; repeated rows are each reported; an empty benchmark leaves every document clean; other columns are ignored (operator) or
kept (``decontaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, remove, stored, table, text_chunks
from .fmindex import FMIndex

WINDOW = 10
SHARD = 4 << 20
#: Bytes of phrase text held by the driver and every task at once; larger benchmarks are searched in several passes.
BLOCK_BYTES = 8 << 20

FOUND = "doc_id long, n_words long, items array<string>, spans array<struct<start:long,end:long>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class Phrases:
    """A block's distinct windows as rows of symbols, and the items that each comes from."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.symbols: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            s = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text)]
            for i in range(max(1, len(s) - window + 1) if s else 0):
                found.setdefault(tuple(s[i : i + window]), set()).add(number[name])
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            self.rows[i, : len(p)] = p
        self.least = int(self.lengths.min(initial=window))
        owners = [sorted(x) for x in found.values()]
        self.owner_at = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([x for o in owners for x in o], np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def shard_hits(parts: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in the documents of a shard: (index of the document's word in the shard, number of words, phrase)."""
    get = phrases.symbols.get
    text = np.fromiter((get(w, 0) for p in parts for w in [*p, b""]), np.int64)
    # Runs of phrase words shorter than the shortest phrase cannot hold one; they and all separators shrink to one 0.
    known = np.concatenate([[0], (text > 0).view(np.int8), [0]])
    edge = np.diff(known)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= phrases.least
    a, b = a[long], b[long]
    place = spread(a, b - a + 1)  # each run and the 0 after it
    none = np.zeros(0, np.int64)
    if not len(place) or not len(phrases.rows):
        return none, none, none
    reduced = text[np.minimum(place, len(text) - 1)]
    reduced[np.cumsum(b - a + 1) - 1] = 0
    index = FMIndex(reduced, len(phrases.symbols))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    which = np.repeat(np.arange(len(lo)), hi - lo)
    at = index.locate(spread(lo, hi - lo))
    return place[at], phrases.lengths[which], which


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _find(window: int, items, more: bool):
    """For mapInArrow (``items``: a broadcast block): adds what this block's phrases hit to what earlier blocks did; keeps the text if ``more`` follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items.value, window)
        for rows, data, offsets in text_chunks(batches, SHARD):
            clean = data.tobytes().translate(ALNUM)
            parts = [clean[a:b].split() for a, b in zip(offsets, offsets[1:], strict=False)]
            begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
            at, n, which = shard_hits(parts, phrases)
            change = np.zeros(int(begin[-1]) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            edge = np.diff(np.concatenate([[0], (np.cumsum(change)[:-1] > 0).view(np.int8), [0]]))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = np.searchsorted(begin, first, "right") - 1
            spans: dict[int, list[tuple[int, int]]] = {}
            for d, s, e in zip(of.tolist(), (first - begin[of]).tolist(), (last - begin[of]).tolist(), strict=True):
                spans.setdefault(d, []).append((s, e))
            pairs = np.stack([np.searchsorted(begin, at, "right") - 1, which], 1)
            pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
            count = phrases.owner_at[pairs[:, 1] + 1] - phrases.owner_at[pairs[:, 1]]
            owners = np.stack([np.repeat(pairs[:, 0], count), phrases.owners[spread(phrases.owner_at[pairs[:, 1]], count)]], 1)
            named: dict[int, list[str]] = {}
            for d, o in (np.unique(owners, axis=0) if len(owners) else owners).tolist():
                named.setdefault(d, []).append(phrases.names[o])
            items_before, spans_before = rows.column("items").to_pylist(), rows.column("spans").to_pylist()
            names_out = [sorted({*(old or ()), *named.get(i, ())}) for i, old in enumerate(items_before)]
            spans_out = [merged([(x["start"], x["end"]) for x in old or ()] + spans.get(i, [])) for i, old in enumerate(spans_before)]
            out = {
                "doc_id": rows.column("doc_id"), "n_words": pa.array([len(p) for p in parts], pa.int64()),
                "items": pa.array(names_out, pa.list_(pa.string())), "spans": pa.array(spans_out, SPAN),
            } | ({"text": rows.column("text")} if more else {})
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark's items in pieces of at most ``most`` bytes or one item; the driver holds one piece at a time."""
    held: list[tuple[str, bytes | None]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").cast("binary").alias("t")).toLocalIterator():
        n = len(r.t or b"") + 64
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r.i if r.i is not None else "", bytes(r.t) if r.t is not None else None))
        size += n
    yield held


def in_passes(rows: DataFrame, benchmark: DataFrame, block_bytes: int, step) -> DataFrame:
    """``rows`` after a pass for each block of the benchmark; ``step`` makes a pass (function, schema) of a broadcast and whether more follow.

    All passes but the last are stored, each in place of the one before, so no task holds more than one block's phrases and the driver
    holds two blocks, the next one to see that there is one.
    """
    spark, path, rest = rows.sparkSession, None, blocks(benchmark, block_bytes)
    block = next(rest)
    while block is not None:
        following = next(rest, None)
        sent = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(*step(sent, following is not None))
        if following is not None:
            before, (rows, path) = path, stored(rows, "pass")
            sent.unpersist()
            if before:
                remove(spark, before)
        block = following
    return rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: counts, items and merged spans (of word numbers) of benchmark windows in its text."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = found.withColumn("items", F.expr("cast(null as array<string>)")).withColumn("spans", F.expr("cast(null as array<struct<start:bigint,end:bigint>>)"))
    found = in_passes(found, benchmark, block_bytes, lambda sent, more: (_find(window, sent, more), FOUND + ", text string" * more))
    return found.select(
        "doc_id", "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items", "spans",
    )


def _drop(window: int, items, most: float):
    find = _find(window, items, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_chunks(batches, SHARD):
            n = rows.num_rows
            none = [pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, SPAN)]
            asked = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), rows.column("text"), *none], ["doc_id", "text", "items", "spans"])
            keep = []
            for out in find(iter([asked])):
                for words, spans in zip(out.column("n_words").to_pylist(), out.column("spans").to_pylist(), strict=True):
                    keep.append(sum(x["end"] - x["start"] for x in spans) <= most * words)
            yield rows.filter(pa.array(keep))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents of whose words more than the share ``most`` is hit; all columns stay."""
    return in_passes(docs, benchmark, block_bytes, lambda sent, more: (_drop(window, sent, most), docs.schema))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


#: The same in DuckDB: every window of every document against every window of every item.
ORACLE = r"""
with t as (select row_number() over () as r, doc_id, text from documents),
low as (select r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as k from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0) x),
dw as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from low cross join (select distinct n from bw) l where len(w) >= n) x),
hits as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.k = bw.k),
words as (select r, count(distinct p) as c from (select r, unnest(range(i, i + n)) as p from hits) x group by r),
items as (select r, count(*) as c, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from hits) x group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(words.c, 0) as bigint) as n_hit, cast(coalesce(items.c, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(words.c, 0) > 0 as contaminated
from low left join words on low.r = words.r left join items on low.r = items.r
"""
