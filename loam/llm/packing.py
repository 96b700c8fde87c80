"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

1. Tasks tokenise their documents and cut what is longer than a sequence; of every piece a short row is stored, and its tokens only if
   they are asked for.
2. Pieces of one length are alike, so the instance is a histogram: one count for each length, however many documents there are. That is
   what the driver packs: at most ``capacity`` numbers.
3. Reduction: a set of pieces is fixed as a full sequence if it provably dominates every other set that holds its largest piece j,
   that is, if whatever else could stand beside j can be exchanged for what stands there: (a) nothing fits beside j; (b) one piece
   fills what j leaves; (c) at most one fits, and it is the largest; (d) at most two fit, and the largest single piece is no smaller
   than any two; (e) at most two fit, the largest single piece r is in the best pair (r, b), and no two pieces larger than b fit
   together. Some optimal packing holds each fixed set, so the rest is a smaller instance with the same optimum less those sets.
   Passes over the lengths go on until nothing more is fixed.
4. The remainder goes by best fit, longest first: into the open sequences with the least room that is enough.
5. A packing is a list of (pattern, how many times), so each pattern takes a range of the numbers of a length's pieces. Pieces are numbered
   within their length by a distributed scan and look their sequence up in the broadcast plan: at most some hundred thousand ranges,
   bounded by the capacity alone (a pattern has at most 64 distinct lengths, for distinct lengths up to 64 sum to 2,080).

Cases: a null or empty text has the closing id alone, one token; repeated rows and ids are all packed, each on its own; an empty table
gives an empty table; other columns are ignored. Text that spells a special token is one, as the tokeniser has it by default.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, give_back, table, text_chunks, written
from .scan import prefix_sums

CAPACITY = 2048
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Id after each document.
END = 0
#: Bytes of text that are split into words at once.
SLICE = 1 << 21
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class Words:
    """Ids of words, remembered: the tokeniser never looks across white space, so a text's ids are those of its words."""

    MOST, MOST_BYTES = 1_000_000, 1 << 25
    CLOSING = b" "  # no word

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters, a digit or a run of others
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at, self.bytes = {self.CLOSING: 0}, 0
        self.lengths, self.ids = [np.ones(1, np.int64)], [np.full(1, END, np.uint32)]

    def add(self, words: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.at)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        self.lengths.append(lengths)
        self.ids.append(ids)
        self.bytes += sum(map(len, words))

    def learn(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self.at]
        if len(self.at) + len(fresh) > self.MOST or self.bytes > self.MOST_BYTES:
            self.clear()
            fresh = [w for w in words if w != self.CLOSING]
        spelt = [w.decode("utf-8", "replace") for w in fresh]
        letters, other = [], []
        for pair in zip(fresh, spelt, strict=True):
            (letters if pair[1].isalpha() else other).append(pair)
        for first in range(0, len(letters), 4096):
            some = letters[first : first + 4096]
            # A word of letters is one run, so of many at once each ends with the next closing id.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(t for _, t in some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) == len(some):
                self.add([w for w, _ in some], np.diff(ends, prepend=-1), ids)
            else:  # a letter that the tokeniser takes for something else
                other += some
        for first in range(0, len(other), 4096):
            some = other[first : first + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)]
            self.add([w for w, _ in some], np.fromiter(map(len, found), np.int64, len(some)), np.fromiter(chain.from_iterable(found), np.uint32))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many ids come before each word (one more at the end)."""
        self.learn(set(words))
        lengths, ids = self.lengths, self.ids = [np.concatenate(self.lengths)], [np.concatenate(self.ids)]
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        starts = np.cumsum(lengths[0]) - lengths[0]
        n = lengths[0][at]
        ends = np.r_[0, np.cumsum(n)]
        return ids[0][np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])], ends


_known: dict[str, Words] = {}


def words_by(path: str) -> Words:
    """One memory for all tasks of a worker."""
    if path not in _known:
        _known[path] = Words(path)
    return _known[path]


#: Between an ASCII letter and one of these the tokeniser always splits, so a word is remembered once, not with each of them.
_STOPS = re.compile(rb"(?<=[a-zA-Z])(?=[.,;:!?])")


def _split(text: bytes) -> bytes:
    """The text with more white space and lower case where that changes no id.

    A lower-case letter and a combining mark of U+0300 to U+036F (two bytes, the first CC or CD) can be one character where the
    upper-case letter is two, and special tokens are told by their case; texts with either keep theirs.
    """
    if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
        text = text.translate(LOWER)
    return _STOPS.sub(b" ", text)


def _slices(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space; a part without any is as long as it is."""
    first, spaces = 0, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
    while first < len(text):
        last = first + SLICE
        if last < len(text):
            near = [p for p in (text.find(s, last) for s in spaces) if p >= 0]
            last = min(near, default=len(text))
        yield text[first:last]
        first = last


def _pieces(path: str, capacity: int, keep_ids: bool):
    def rows(doc: int | None, ids: np.ndarray, piece: int, ended: bool) -> tuple[list[tuple], int]:
        """Pieces of ``ids``; unless the document ended, the last one is not made. And how many there are."""
        out, whole = [], ids.astype("<u4", copy=False)
        n = -(-len(ids) // capacity) if ended else (len(ids) - 1) // capacity
        for k in range(n):
            held = whole[k * capacity : (k + 1) * capacity].tobytes()
            out.append((doc, piece + k, (piece + k) * capacity, len(held) // 4, zlib.crc32(held), held if keep_ids else None))
        return out, n

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_by(path)
        try:
            for batch, data, offsets in text_chunks(batches, SLICE):
                docs, out = batch.column("doc_id").to_pylist(), []
                if len(docs) == 1 and len(data) > SLICE:
                    held, piece = np.zeros(0, np.uint32), 0
                    for part in _slices(data.tobytes()):
                        held = np.concatenate([held, words.encode(_split(part).split())[0]])
                        some, n = rows(docs[0], held, piece, False)
                        held, piece = held[n * capacity :], piece + n
                        if some:
                            yield batch_of(some)
                    out = rows(docs[0], np.r_[held, np.full(1, END, np.uint32)], piece, True)[0]
                else:
                    said, ends, text = [], [0], data.tobytes()
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                        said += _split(text[a:b]).split()
                        said.append(Words.CLOSING)
                        ends.append(len(said))
                    ids, before = words.encode(said)
                    cuts = before[ends]
                    for doc, a, b in zip(docs, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        out += rows(doc, ids[a:b], 0, True)[0]
                if out:
                    yield batch_of(out)
        finally:
            give_back()

    return run


def pieces_of(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit, null unless kept)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(path, capacity, keep_ids), PIECES)


@dataclass
class Group:
    """``bins`` sequences that are filled alike: of each entry (length, copies in a sequence, number of its first piece, offset)."""

    bins: int
    room: int
    entries: list[tuple[int, int, int, int]] = field(default_factory=list)


class Packing:
    """A packing of a histogram of lengths; pieces of one length are numbered from 0 and handed out in order."""

    def __init__(self, counts: np.ndarray):
        self.capacity, self.left = len(counts) - 1, counts.astype(np.int64).copy()
        self.handed = np.zeros(len(counts), np.int64)
        self.groups: list[Group] = []
        self.fixed = 0

    def put(self, group: Group, length: int, copies: int) -> None:
        group.entries.append((length, copies, int(self.handed[length]), self.capacity - group.room))
        self.handed[length] += group.bins * copies
        self.left[length] -= group.bins * copies
        group.room -= copies * length

    def fix(self, *lengths: int) -> None:
        """The set as often as there are pieces for it."""
        need = Counter(lengths)
        group = Group(min(int(self.left[w]) // n for w, n in need.items()), self.capacity)
        for w, n in need.items():
            self.put(group, w, n)
        self.groups.append(group)
        self.fixed += group.bins


def dominating(left: np.ndarray, j: int) -> tuple[int, ...] | None:
    """A set that holds a piece of length j and dominates all others that do, or None. ``left`` counts pieces by length, j's among them."""
    room = len(left) - 1 - j
    others = left.copy()
    others[j] -= 1
    there = np.flatnonzero(others[: room + 1])
    if not len(there):
        return (j,)
    r = int(there[-1])
    if r == room:
        return j, r
    least = np.repeat(there[:3], np.minimum(others[there[:3]], 3))[:3]  # what does not fit beside j makes no set larger
    if len(least) < 2 or least[:2].sum() > room:
        return j, r
    if len(least) == 3 and least.sum() <= room:
        return None
    # At most two: the best partner y <= x of each x.
    prior = np.maximum.accumulate(np.where(others[: room + 1] > 0, np.arange(room + 1), 0))
    y = prior[np.minimum(there, room - there)]
    alone = (y == there) & (others[there] < 2)
    y = np.where(alone, prior[np.maximum(there - 1, 0)], y)
    sums = np.where(y > 0, there + y, 0)
    best = int(sums.max())
    if best <= r:
        return j, r
    b = best - r
    if sums[-1] != best:
        return None
    larger = there[there > b]
    two = np.repeat(larger[:2], np.minimum(others[larger[:2]], 2))[:2]
    return (j, r, b) if len(two) < 2 or two.sum() > room else None


def reduce(packing: Packing) -> None:
    """Fixes dominating sets until there are none."""
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(packing.left)[::-1].tolist():
            while packing.left[j] and (found := dominating(packing.left, j)):
                packing.fix(*found)
                changed = True


def best_fit(packing: Packing) -> None:
    """Packs what is left, longest first, into the sequences with the least room that is enough."""
    open_: dict[int, list[Group]] = defaultdict(list)
    for w in np.flatnonzero(packing.left)[::-1].tolist():
        while n := int(packing.left[w]):
            room = min((r for r, groups in open_.items() if r >= w and groups), default=0)
            if room:
                group = open_[room].pop()
            else:
                room = packing.capacity
                group = Group(-(-n // (room // w)), room)
            each = room // w  # a sequence that was chosen stays the tightest one until it has no room
            full, rest = min(group.bins, n // each), 0
            if full < group.bins:
                rest = n - full * each
            cuts = [(full, each), (int(rest > 0), rest), (group.bins - full - (rest > 0), 0)]
            done = 0
            for bins, copies in cuts:
                if bins:
                    part = Group(bins, room, [(length, k, first + done * k, at) for length, k, first, at in group.entries])
                    if copies:
                        packing.put(part, w, copies)
                    open_[part.room].append(part)
                    done += bins
    packing.groups += [g for groups in open_.values() for g in groups]


def plan_packing(counts: np.ndarray) -> Packing:
    """Packs counts[w] pieces of each length w; the capacity is the last index."""
    packing = Packing(counts)
    reduce(packing)
    best_fit(packing)
    return packing


def _look_up(sent, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, copies, sequences, offsets = sent.value
        for batch in batches:
            length, at = (np.asarray(batch.column(c)) for c in ("length", "at"))
            k = np.searchsorted(keys, (length << bits) + at, "right") - 1
            past = (length << bits) + at - keys[k]
            found = [pa.array(sequences[k] + past // copies[k]), pa.array(offsets[k] + past % copies[k] * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *found], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset; one row for each piece."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, path, capacity, keep_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    packing = plan_packing(counts)
    bits = 62 - capacity.bit_length()
    if counts.max(initial=0) >= 1 << bits:
        raise ValueError("more pieces of one length than numbers for them")
    rows, sequence = [], 0
    for g in packing.groups:
        rows += [((length << bits) + first, k, sequence, at) for length, k, first, at in g.entries]
        sequence += g.bins
    plan = tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)
    sent = spark.sparkContext.broadcast(plan)
    numbered = prefix_sums(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], tag="numbered")
    return numbered.mapInArrow(_look_up(sent, bits), f"{PIECES}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, ids (little-endian unsigned 32-bit): the sequences, of pieces with their ids; at most a capacity each."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.unhex(F.array_join(parts, "")).alias("ids"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")
