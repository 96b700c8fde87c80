"""Near copies by similarity: texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``.

Operator 7's search with wider fingerprints, and an exact check after it. Of each distinct text's set of shingles several SimHash
fingerprints of 64 bits are taken and cut into bands; texts that agree in a band meet in a bucket. Distances to pivot fingerprints
and set sizes discard a bucket's pairs unseen, the bits of CARRIED fingerprints most others; a spanning forest of what is left
connects families, in which every pair of near copies lies. Each family's shingle sets are then brought together once, and all
its pairs are decided on them: a pair of the similarity shares one of either's rarest shingles (those beyond the share that both
must have), so an index of these finds the candidates, and counting over an index of all shingles gives their overlaps. What
leaves a task is a spanning forest of its links, never all pairs, however many are alike but under the similarity.

What can be missed: a pair that shares no band, and one whose fingerprints differ by four standard deviations more than they
should. At a similarity of 0.8 a bit agrees with probability 0.848 (SAME_BIT), and there are as many bands as it takes to share
one with probability RECALL = 0.99 (0.9996 at 0.85). Sets of at most SMALL shingles, whose bits agree less often, also meet by
their hash and the hashes of all their subsets of one shingle less, which no such pair misses. Keys get wider with the corpus, and
bands more, so that a bucket of unrelated texts stays small and the recall the same (``layout``).

Buckets of more than WHOLE rows, and families of more than PIECE shingles, are dealt into parts, first each for itself; then two
parts meet in a cell unless both are of what is by now the largest component (``in_cells``). Texts are shuffled compressed.

Cases: exact copies (same words) are one node from the start; texts with fewer words than a shingle have one shingle; texts
without words are all alike; rows are told apart by doc_id and text, so two texts with one doc_id are two rows; repeated rows
(same doc_id and text) are one; a row with a null doc_id belongs to no group and stays; an empty table gives an empty table;
columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import LOWER, fresh, give_back, held, mix64, text_chunks, word_hashes, written
from .components import components
from .decontaminate import spread
from .simhash import roots, survivors

WORDS, SIMILARITY = 5, 0.8
#: Probability that a bit agrees at a similarity of 0.8: 1 - acos(2 * 0.8 / 1.8) / pi. That some band then does.
SAME_BIT, RECALL = 0.848, 0.99
#: Shingles up to which a set also meets others by its subsets: two such sets of 0.8 differ in one shingle on either side at most.
SMALL = 9
#: The largest probability that a bit differs at 0.8 or more, for sets of at most TINY shingles and for larger ones (computed from
#: binomials for all sizes up to 120, where it has come down to 0.153); bits may differ by SIGMAS standard deviations more.
TINY, DIFFER_TINY, DIFFER, SIGMAS = 4, 0.188, 0.161, 4
#: Fingerprints that are compared inside a bucket.
CARRIED = 4
#: Rows of a bucket, and shingles of a family, that one task compares, about.
WHOLE, PIECE = 20_000, 1 << 19
PIVOTS = 4
STEP, BLOCK = 2 << 20, 4096


@dataclass(frozen=True)
class Layout:
    """Bits of a band's key, number of bands, and of fingerprints that these take."""

    bits: int
    bands: int
    prints: int


def layout(rows: int) -> Layout:
    """For a corpus of ``rows`` texts: 16 bits up to some 500 million; beyond, one more each time it doubles."""
    bits = min(32, max(16, max(1, rows).bit_length() - 13))
    bands = math.ceil(math.log(1 - RECALL) / math.log(1 - SAME_BIT**bits))
    return Layout(bits, bands, math.ceil(bands / (64 // bits)))


def most_differ(bits: int) -> tuple[int, int]:
    """Of so many bits, how many may differ: of tiny sets and of others."""
    return tuple(math.ceil(p * bits + SIGMAS * math.sqrt(bits * p * (1 - p))) for p in (DIFFER_TINY, DIFFER))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of runs of ``size`` words."""
    x = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    k = max(1, min(size, len(words)))
    h = np.zeros(max(1, len(x) - k + 1), np.uint64)
    for i in range(k if len(x) else 0):
        h = mix64(h + x[i : i + len(h)])
    return np.unique(h)


def ones(x: np.ndarray) -> np.ndarray:
    """How many of x[0], x[1], ... (a power of two of them) have each bit: uint64 (m, ...) to int32 (..., 64), little end first.

    Counters of all bits side by side are added in a tree, a plane of words for each digit.
    """
    planes = [x]
    while len(planes[0]) > 1:
        half, carry, sums = len(planes[0]) // 2, None, []
        for p in planes:
            a, b = p[:half], p[half:]
            either, both = a ^ b, a & b
            sums.append(either if carry is None else either ^ carry)
            carry = both if carry is None else both | (either & carry)
        planes = [*sums, carry]
    shape = planes[0].shape[1:]
    total = np.zeros((*shape, 64), np.int32)
    for digit, p in enumerate(planes):
        bits = np.unpackbits(np.ascontiguousarray(p[0]).view(np.uint8).reshape(*shape, 8), axis=-1, bitorder="little")
        total += bits.astype(np.int32) << digit
    return total


def prints(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` fingerprints of each set of hashes: a bit is set if more than half of the hashes, mixed anew, have it."""
    seeds = mix64(np.arange(1, count + 1, dtype=np.uint64))
    out = np.zeros((len(sets), count), np.uint64)
    many: dict[int, np.ndarray] = {}
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, h in enumerate(sets):
        for at in range(0, len(h), BLOCK):
            part = h[at : at + BLOCK]
            by_size.setdefault((len(part) - 1).bit_length(), []).append((i, part))
    for k, parts in by_size.items():
        together = max(1, (1 << 17) // (count << k))
        for at in range(0, len(parts), together):
            chosen = parts[at : at + together]
            x = np.zeros((1 << k, len(chosen), count), np.uint64)
            for j, (_, h) in enumerate(chosen):
                x[: len(h), j] = h[:, None]
            x = mix64(x ^ seeds)
            for j, (_, h) in enumerate(chosen):
                x[len(h) :, j] = 0
            total = ones(x)
            which = [i for i, _ in chosen]
            size = np.array([len(sets[i]) for i in which])
            out[which] = np.packbits(2 * total > size[:, None, None], axis=-1, bitorder="little").view(np.uint64)[..., 0]
            for j, i in enumerate(which):
                if len(sets[i]) > BLOCK:
                    many[i] = many.get(i, 0) + total[j]
    for i, total in many.items():
        out[i] = np.packbits(2 * total > len(sets[i]), axis=-1, bitorder="little").view(np.uint64)[..., 0]
    return out


def subsets(h: np.ndarray) -> list[int]:
    """Keys of a small set and of its subsets of one less; none of a larger set."""
    if len(h) > SMALL:
        return []
    whole = h.sum(dtype=np.uint64)
    return mix64(np.append(whole, whole - h)).view(np.int64).tolist()


def _prints(size: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, STEP):
            raw, same, sets = data.tobytes().translate(LOWER), [], []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                words = raw[a:b].split()
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sets.append(shingles(words, size))
            fp = pa.FixedSizeListArray.from_arrays(pa.array(prints(sets, count).view(np.int64).reshape(-1)), count).cast(pa.list_(pa.int64()))
            n, more = pa.array([len(h) for h in sets], pa.int64()), pa.array([subsets(h) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("h"), pa.array(same, pa.binary()), n, fp, more], ["doc_id", "h", "same", "n", "fp", "more"])

    return run


def _differ(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the rows a[i] and b[i] of ``fp`` differ."""
    out = np.zeros(len(a), np.int16)
    for k in range(fp.shape[1]):
        out += np.bitwise_count(fp[a, k] ^ fp[b, k])
    return out


def forest_of_near(key: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, fp: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all near rows of each bucket that have different ``root``: a spanning forest over the roots.

    Near: sizes ``n`` allow ``similarity``, and the fingerprints (columns of ``fp``) differ as little as they must then. Rows at
    PIVOTS places of the bucket are its pivots.
    """
    order = np.lexsort((root, key))
    key, node, root, n, fp = key[order], node[order], root[order], n[order], fp[order]
    rows = len(key)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(starts, rows))
    bucket = np.repeat(np.arange(len(starts)), size)
    pivots = [np.repeat(starts + size * k // PIVOTS, size) for k in range(PIVOTS)]
    far = np.stack([_differ(fp, np.arange(rows), p) for p in pivots], 1)
    most_tiny, most = most_differ(64 * fp.shape[1])
    # Within a bucket, rows of one root are one tree from the start.
    new = np.append(True, (key[1:] != key[:-1]) | (root[1:] != root[:-1]))
    tree = np.maximum.accumulate(np.where(new, np.arange(rows), 0))
    live, step, found = np.arange(rows), 0, []
    while len(live):
        step += 1
        live = live[live + step < rows]
        live = live[bucket[live] == bucket[live + step]]
        if step & (step - 1) == 0 or step % 512 == 0:  # buckets that are one tree are done
            several = np.zeros(len(starts), bool)
            several[bucket[tree != tree[starts[bucket]]]] = True
            live = live[several[bucket[live]]]
        a, b = live, live + step
        ok = tree[a] != tree[b]
        a, b = a[ok], b[ok]
        ok = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
        a, b = survivors(far, a[ok], b[ok], most_tiny)
        near = _differ(fp, a, b) <= np.where(np.minimum(n[a], n[b]) <= TINY, most_tiny, most)
        if near.any():
            a, b = a[near], b[near]
            found += _joining(tree, a, b)
            tree = roots(a, b, tree)
    i, j = np.array(found, np.int64).reshape(-1, 2).T
    return node[i], node[j]


def _joining(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join two trees when they are added one after the other."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for x, y, s, t in zip(a.tolist(), b.tolist(), tree[a].tolist(), tree[b].tolist(), strict=True):
        s, t = top(s), top(t)
        if s != t:
            up[max(s, t)] = min(s, t)
            out.append((x, y))
    return out


def _by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come in order of ``keys``; a group is kept until it is whole."""
    kept: list[pa.RecordBatch] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        same = np.logical_and.reduce([x == x[-1] for x in (np.asarray(rows.column(k)) for k in keys)])
        if kept and same.all() and all(kept[-1].column(k)[-1].as_py() == rows.column(k)[0].as_py() for k in keys):
            kept.append(rows)
            continue
        t = pa.Table.from_batches([*kept, rows])
        tail = np.logical_and.reduce([np.asarray(t.column(k)) == np.asarray(t.column(k))[-1] for k in keys])
        cut = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0
        if cut:
            yield t.slice(0, cut)
        kept = t.slice(cut).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)
    give_back()


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _near_in_buckets(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ("key", "part")):
            part = np.asarray(t.column("part")).astype(np.uint64)
            key = np.asarray(t.column("key")).view(np.uint64) ^ mix64(part)
            columns = [np.asarray(t.column(c)) for c in ("node", "root", "n")]
            fp = np.stack([np.asarray(t.column(f"fp{k}")) for k in range(CARRIED)], 1).view(np.uint64)
            yield _pairs(*forest_of_near(key, *columns, fp, similarity))

    return run


def forest_of_alike(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect all sets of at least ``similarity`` that have different ``root``; exact."""
    size = np.array([len(h) for h in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), size)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare = np.empty(len(count), np.int64)
    rare[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rare[token]
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]  # each set's rarest first
    first = np.concatenate([[0], np.cumsum(size)])
    # Two sets alike share ``must`` of either, hence one of either's rarest size - must + 1.
    prefix = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    in_prefix = np.arange(len(doc)) - first[doc] < prefix[doc]

    def index(t: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(t, kind="stable")  # sets in order within a token
        return np.searchsorted(t[by], np.arange(len(count) + 1)), of[by]

    at, holders = index(token, doc)
    at_prefix, starters = index(token[in_prefix], doc[in_prefix])
    label, out = np.unique(root, return_inverse=True)[1], []
    for i in range(1, len(sets)):
        mine = token[first[i] : first[i + 1]]
        head = mine[: prefix[i]]
        found = starters[spread(at_prefix[head], at_prefix[head + 1] - at_prefix[head])]
        found = np.unique(found[found < i])
        found = found[(label[found] != label[i]) & (np.minimum(size[found], size[i]) >= similarity * np.maximum(size[found], size[i]))]
        if not len(found):
            continue
        both = np.bincount(holders[spread(at[mine], at[mine + 1] - at[mine])], minlength=len(sets))[found]
        for j in found[both >= similarity * (size[found] + size[i] - both)].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _alike_in_families(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ("key", "part")):
            key, part, node, root = (np.asarray(t.column(c)) for c in ("key", "part", "node", "root"))
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").slice(a, b - a)]
                found = np.array(forest_of_alike(sets, root[a:b], similarity), np.int64).reshape(-1, 2) + a
                yield _pairs(node[found[:, 0]], node[found[:, 1]])

    return run


def _sets(size: int):
    """Of compressed texts, which are opened here and one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for rows, data, offsets in text_chunks(batches, STEP):
            view, sets = memoryview(data), []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                text = open_.decompress(view[a:b]) if b > a else b""  # a null text is no bytes
                sets.append(shingles(text.translate(LOWER).split(), size).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("key"), rows.column("part"), pa.array(sets, pa.binary())], ["node", "key", "part", "shingles"])

    return run


def _keys(plan: Layout) -> Column:
    """The keys of a node's bands and subsets."""
    per = 64 // plan.bits
    bands = [F.lit(k << plan.bits) + F.shiftrightunsigned(F.col("fp")[k // per], plan.bits * (k % per)).bitwiseAND(F.lit((1 << plan.bits) - 1)) for k in range(plan.bands)]
    return F.concat(F.array(*bands), F.col("more"))


def _tables(nodes: DataFrame, plan: Layout) -> DataFrame:
    """A row for each node and key, with CARRIED fingerprints: fp0, fp1, ..."""
    return nodes.select("node", "root", "n", *[F.col("fp")[k].alias(f"fp{k}") for k in range(CARRIED)], F.explode(_keys(plan)).alias("key"))


def in_parts(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` (key, node, ...) with ``part``: 0, or one of the ``parts`` of a key in ``large``."""
    dealt = rows.join(held(large.select("key", "parts")), "key", "left")
    return dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")


def in_cells(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of ``large`` keys (key, parts) in cells, numbered in ``part``: two parts in each, not both of the key's largest root.

    A key's parts are shared out between its largest root and the others by their numbers of rows.
    """
    rows = rows.join(held(large), "key")
    groups = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.first("parts").alias("parts"))
    info = groups.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("most"), F.first("parts").alias("parts"))
    share = lambda c: F.greatest(F.lit(1), F.ceil(F.col("parts") * c / F.col("all"))).cast("int")
    info = info.where(F.col("all") > F.col("most.c"))
    info = written(info.select("key", F.col("most.root").alias("major"), share(F.col("all") - F.col("most.c")).alias("p"), share(F.col("most.c")).alias("q")), "large")
    rows = rows.drop("parts").join(held(info), "key")
    h, p, q = F.xxhash64("node"), F.col("p"), F.col("q")
    of_major = F.col("root") == F.col("major")
    own = F.when(of_major, F.pmod(h, q)).otherwise(F.pmod(h, p)).cast("int")
    upto = lambda count: F.sequence(F.lit(0), count - 1)
    major_cells = F.transform(upto(p), lambda i: p * p + i * q + own)
    minor_cells = F.concat(F.transform(upto(p), lambda i: F.greatest(i, own) * p + F.least(i, own)), F.transform(upto(q), lambda j: p * p + own * q + j))
    return rows.withColumn("part", F.explode(F.when(of_major, major_cells).otherwise(minor_cells))).drop("p", "q", "major")


def _rooted(nodes: DataFrame, star: DataFrame | None) -> DataFrame:
    if star is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(star.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _links(star: DataFrame) -> DataFrame:
    return star.select(F.col("u").alias("a"), F.col("v").alias("b"))


def _dealt(rows: DataFrame, forest) -> DataFrame:
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(forest, "a long, b long").distinct()


def families(nodes: DataFrame, plan: Layout, similarity: float = SIMILARITY, whole: int = WHOLE) -> DataFrame:
    """(u, v): each node and the least one of its family, for nodes that are not; all near rows of a bucket are of one family."""
    tables = _tables(_rooted(nodes, None), plan)
    large = tables.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > whole)
    large = written(large.select("key", F.ceil(F.col("c") / whole).alias("parts")), "large_buckets")
    forest = _near_in_buckets(similarity)
    star = components(_dealt(in_parts(tables, large), forest))
    if large.isEmpty():
        return star
    more = _dealt(in_cells(_tables(_rooted(nodes, star), plan), large), forest)
    return components(_links(star).unionByName(more))


def near_links(rows: DataFrame, nodes: DataFrame, family: DataFrame, words: int, similarity: float, piece: int = PIECE) -> DataFrame:
    """(u, v): each node and the least one that links of at least ``similarity`` reach, for nodes that are not."""
    named = family.unionByName(family.select(F.col("v").alias("u"), "v").distinct()).withColumnsRenamed({"u": "node", "v": "key"})
    members = nodes.select("node", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")).join(named, "node")
    large = members.groupBy("key").agg(F.sum("n").alias("c")).where(F.col("c") > piece)
    large = written(large.select("key", F.ceil(F.col("c") / piece).alias("parts")), "large_families")
    members = in_parts(members, large).drop("n")
    texts = packed(rows).join(members.hint("merge"), ["doc_id", "h"]).dropDuplicates(["node"]).select("node", "key", "part", "text")
    sets = written(texts.mapInArrow(_sets(words), "node long, key long, part int, shingles binary"), "sets")
    forest = _alike_in_families(similarity)
    star = components(_dealt(_rooted(sets, None), forest))
    if large.isEmpty():
        return star
    more = _dealt(in_cells(_rooted(sets.drop("part"), star), large), forest)
    return components(_links(star).unionByName(more))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def near_copy_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """doc_id, h (a hash of the text), group and first: the row of a group with the smallest doc_id gives the group and is first.

    One row for each row of ``docs`` with a doc_id.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the limits of the search hold from a similarity of {SIMILARITY} on")
    rows = _rows(docs)
    plan = layout(docs.count())
    schema = "doc_id long, h long, same binary, n long, fp array<long>, more array<long>"
    printed = written(rows.mapInArrow(_prints(words, plan.prints), schema), "prints")
    nodes = printed.groupBy("same").agg(F.min(F.struct("doc_id", "h")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "more")])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    star = near_links(rows, nodes, families(nodes, plan, similarity, whole), words, similarity, piece)
    rooted = _rooted(nodes.select("same", "first", "node"), star)
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root").select("same", "least")
    return printed.select("doc_id", "h", "same").join(named, "same").select("doc_id", "h", F.col("least.doc_id").alias("group"), (F.struct("doc_id", "h") == F.col("least")).alias("first"))


def _zstd(pack: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for rows in batches:
            i = rows.schema.get_field_index("text")
            texts = rows.column(i).cast(pa.binary() if pack else rows.schema.field(i).type).to_pylist()
            if pack:
                press = zstandard.ZstdCompressor(level=3)
                new = pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())
            else:
                open_ = zstandard.ZstdDecompressor()
                new = pa.array([None if t is None else open_.decompress(t) for t in texts], pa.binary()).cast(pa.string())
            yield rows.set_column(i, "text", new)

    return run


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with a compressed text, for a shuffle."""
    return docs.mapInArrow(_zstd(True), StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in docs.schema]))


def unpacked(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_zstd(False), StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema]))


def one_of_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of its smallest doc_id; rows with a null doc_id all stay."""
    i, h = fresh("i", docs.columns), fresh("h", docs.columns)
    keep = near_copy_groups(docs, **options).where("first").select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    keyed = docs.where("doc_id is not null").withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64(F.col("text").cast("string"))})
    kept = unpacked(packed(keyed).join(keep.hint("merge"), [i, h], "left_semi").dropDuplicates([i, h]))
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
