"""Phrase collocations by contiguous pattern growth: occurrence pointers are projected for each frequent prefix and extended to the right.

1. Words are counted by language. A word below the support is in no candidate, so the next pass looks at neighbours of frequent words only.
2. Pairs of neighbouring frequent words are counted: the frequent prefixes.
3. Each occurrence of a frequent prefix that goes on with another one is projected: a pointer that carries the words that follow, up to
   four in all and no further than its pairs are frequent. Equal pointers are one row with a count.
4. Pointers are dealt out by prefix and sorted; a task extends each of its prefixes depth first, word by word, and leaves a branch as soon
   as it is below the support. A prefix with more pointers than a range holds lies over several tasks by its further words: what a
   task sees of such a prefix is counted without leaving branches, and the parts are added.
5. Cuts, containment in longer phrases and texts are equality joins of candidates; ranks come from a distributed scan.

In tasks a word is a 64-bit hash of its bytes, taken of all words of a part at once (differences of prefix sums), and that no two words
of a language share one is checked over all words (the job fails otherwise).
Whether a word or pair is frequent is looked up in a filter of 2 ** FILTER_BITS bits, whatever the vocabulary: more keys let more
infrequent ones through, whose exact counts drop them later. Counts are summed within tasks before they are shuffled.

Cases: a null or empty text has no words; null lang is ``und``, together with documents that say so; repeated rows all count; of equal
scores the larger count, then the smaller text in UTF-8 order comes first; an empty table, or one without a phrase of the support,
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Ranges
from .common import LOWER, give_back, table, text_chunks, written
from .scan import prefix_sums

SUPPORT, LONGEST, TOP = 30, 4, 2000
#: A candidate is dropped for a longer one that has this share (percent) of its occurrences.
SHARE = 80
FILTER_BITS = 26
#: Bytes of text that are split into words at once; pairs or pointers that are summed at once.
SLICE, GATHERED = (1 << 20) - 4096, 1 << 20
#: Between pieces; no byte of UTF-8.
BREAK = b"\xff"
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes(0xFF if b in _SEPARATORS else 32 if b == 9 else LOWER[b] for b in range(256))
_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")
#: 0: a word's byte, 1: between words, 2: between pieces.
_KIND = np.array([2 if b in _SEPARATORS else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)
#: A fixed random number for each byte, the same for A-Z and a-z.
_NUMBER = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64)[np.frombuffer(LOWER, np.uint8)]
#: What stands in a stream of hashes between pieces.
CLOSING = np.uint64(xxhash.xxh64_intdigest(BREAK, 42))


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, bool]]:
    """(languages, bytes, offsets, whether the last text ends): the texts in order, long ones in parts that end between words."""
    for batch, data, offsets in text_chunks(batches, SLICE):
        langs = batch.column("lang").to_pylist()
        if len(langs) > 1 or len(data) <= SLICE:
            yield langs, data, offsets, True
            continue
        text, first = data.tobytes(), 0
        while first < len(text):
            cut = _CUT.search(text, first + SLICE)
            last = cut.start() if cut else len(text)
            yield langs, data[first:last], np.array([0, last - first]), last == len(text)
            first = last


def word_hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hash, text's number, piece's number) of each word, and the last piece's number; pieces are numbered through all texts."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its text
    inside = kind == 0
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(kind == 2)
    return Ranges(_NUMBER[data])(starts, ends), row, breaks[starts] + row, (int(breaks[-1]) if len(data) else 0) + len(offsets) - 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, h, c; a language's number of words under the empty word."""
    counts: dict[str, Counter] = {}
    seen = 0

    def rows() -> pa.RecordBatch:
        langs, words, n = zip(*[(lang, w, c) for lang, words in counts.items() for w, c in words.items()], strict=True)
        ends = np.cumsum([0, *map(len, words)])
        h = Ranges(_NUMBER[np.frombuffer(b"".join(words), np.uint8)])(ends[:-1], ends[1:]) if ends[-1] else np.zeros(len(words), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "h", "c"])

    for langs, data, offsets, _ in parts_of(batches):
        text = data.tobytes().translate(_CLEAN)
        for lang, a, b in zip(langs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = counts.setdefault(lang, Counter())
            words = text[a:b].replace(BREAK, b" ").split()
            own.update(words)
            own[b""] += len(words)
        seen += len(data)
        if sum(map(len, counts.values())) > 200_000 or seen > 1 << 26:
            yield from in_slices(rows())
            counts, seen = {}, 0
    if counts:
        yield from in_slices(rows())
    give_back()


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def key_column(*words: str):
    """Where a phrase of a language is in the filter; ``Stream.keys`` is the same in numpy."""
    key = F.xxhash64("lang")
    for k, w in enumerate(words):
        c = F.col(w)
        key = key.bitwiseXOR(c if not k else F.shiftleft(c, 23 * k).bitwiseOR(F.shiftrightunsigned(c, 64 - 23 * k)))
    return key


def filter_of(keys: DataFrame) -> np.ndarray:
    """The set bits of the low FILTER_BITS of the keys (column ``key``), as 64-bit words: 8 MB at any size."""
    bit = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = keys.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast(key & 63 as int))").alias("bits"))
    found = rows.groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.asarray(found["at"])] = np.asarray(found["bits"])
    return out.view(np.uint64)


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


class Stream:
    """The words of a task's texts as hashes; the last ones of a part wait for the words that follow."""

    def __init__(self) -> None:
        self.langs: list[str] = []
        self.number: dict[str, int] = {}
        self.kept = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, language numbers); the first len - (LONGEST - 1) of them are places to start from."""
        wait = LONGEST - 1
        for langs, data, offsets, ended in parts_of(batches):
            hashes, row, piece, last = word_hashes_of(data, offsets)
            numbers = np.array([self._number(x) for x in langs], np.int32)
            at = np.arange(len(hashes)) + np.cumsum(np.diff(piece, prepend=0) > 0)
            # Unless the text or the last piece ends here, the next part goes on with it.
            after = ended or last > (piece[-1] if len(piece) else 0)
            size = (int(at[-1]) + 1 if len(at) else 0) + after
            own, lang_of = np.full(size, CLOSING), np.zeros(size, np.int32)
            own[at], lang_of[at] = hashes, numbers[row]
            h, lang = np.concatenate([self.kept[0], own]), np.concatenate([self.kept[1], lang_of])
            if len(h) > wait:
                yield h, lang
                self.kept = h[-wait:], lang[-wait:]
            else:
                self.kept = h, lang
        h, lang = self.kept
        yield np.concatenate([h, np.full(wait, CLOSING)]), np.concatenate([lang, np.zeros(wait, np.int32)])

    def _number(self, lang: str) -> int:
        if lang not in self.number:
            self.number[lang] = len(self.langs)
            self.langs.append(lang)
        return self.number[lang]

    def salts(self, lang: np.ndarray) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs] or [0], np.uint64)[lang]


def summed(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long columns, and how often each occurs."""
    mixed = columns[0].astype(np.uint64)
    for k, c in enumerate(columns[1:], 1):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) ^ _rotated(c.astype(np.uint64), 13 * k)
    _, first, inverse, n = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    if all((c[first][inverse] == c).all() for c in columns):
        return [c[first] for c in columns], n
    rows, n = np.unique(np.stack([c.astype(np.uint64) for c in columns], 1), axis=0, return_counts=True)  # two rows of one mix
    return [rows[:, k].astype(c.dtype) for k, c in enumerate(columns)], n


def in_slices(rows: pa.RecordBatch, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """What goes to the JVM at once stays small: it is held twice on the way."""
    for k in range(0, rows.num_rows, size):
        yield rows.slice(k, size)


def _gather(parts: Iterator[list[np.ndarray]], stream: Stream, width: int) -> Iterator[pa.RecordBatch]:
    """lang, h1.., c: rows of (language, hashes), summed GATHERED at a time; a hash of 0 becomes null."""
    held: list[list[np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        columns, n = summed([np.concatenate(c) for c in zip(*held, strict=True)])
        lang = pa.array(stream.langs, pa.string()).take(pa.array(columns[0]))
        hashes = [pa.array(c.view(np.int64), mask=c == 0) for c in columns[1:]]
        rows = pa.RecordBatch.from_arrays([lang, *hashes, pa.array(n.astype(np.int64))], ["lang", *[f"h{k + 1}" for k in range(width)], "c"])
        del columns, n, hashes
        yield from in_slices(rows)

    for columns in parts:
        if len(columns[0]):
            held.append(columns)
        if sum(len(c[0]) for c in held) >= GATHERED:
            yield from flush()
            held = []
    if held:
        yield from flush()
    give_back()


def _pairs(sent):
    """Neighbouring words that both pass the filter of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, bits = Stream(), sent.value

        def parts():
            for h, lang in stream.parts(batches):
                n = len(h) - (LONGEST - 1)
                often = _inside(bits, h ^ stream.salts(lang)) & (h != CLOSING)
                at = np.flatnonzero(often[:n] & often[1 : n + 1])
                yield [lang[at], h[at], h[at + 1]]

        yield from _gather(parts(), stream, 2)

    return run


def _pointers(sent):
    """Occurrences of frequent prefixes that go on: the words from there, the fourth null where the phrase stops being frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, bits = Stream(), sent.value

        def parts():
            for h, lang in stream.parts(batches):
                n = len(h) - (LONGEST - 1)
                key = stream.salts(lang[:-1]) ^ h[:-1] ^ _rotated(h[1:], 23)
                often = _inside(bits, key) & (h[:-1] != CLOSING) & (h[1:] != CLOSING)
                at = np.flatnonzero(often[:n] & often[1 : n + 1])
                yield [lang[at], h[at], h[at + 1], h[at + 2], np.where(often[at + 2], h[at + 3], np.uint64(0))]

        yield from _gather(parts(), stream, 4)

    return run


def extend(words: list[np.ndarray], c: np.ndarray, depth: int, support: int) -> Iterator[tuple[int, int, int]]:
    """(length, first row, count) of the phrases of at least ``support`` that begin as these sorted pointers, longer than ``depth``.

    ``words`` are the pointers' words by place, 0 for none. Depth first: all of a phrase's extensions before its next sibling.
    """
    if depth == len(words) or not len(c):
        return
    column = words[depth]
    starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    totals = np.add.reduceat(c, starts)
    for k in np.flatnonzero((totals >= support) & (column[starts] != 0)).tolist():
        a, b = int(starts[k]), int(starts[k + 1]) if k + 1 < len(starts) else len(c)
        yield depth + 1, a, int(totals[k])
        for length, at, total in extend([w[a:b] for w in words], c[a:b], depth + 1, support):
            yield length, a + at, total


#: Pointers of one prefix that a task holds at once.
MOST_HELD = 1 << 20


def _grow(support: int):
    """Sorted pointers (lang, h1..h4, c) -> lang, h1..h4, c of their phrases of three and four words."""
    names = ["lang", "h1", "h2", "h3", "h4", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def grown(rows: pa.Table, edge_first: bool, edge_last: bool) -> pa.RecordBatch:
            """Phrases of all prefixes in ``rows``; the first and the last prefix may have further pointers elsewhere."""
            rows = rows.combine_chunks()
            words = [np.asarray(rows[x].fill_null(0)) for x in names[1:5]]
            c, langs = np.asarray(rows["c"]), rows["lang"].to_pylist()
            new = np.r_[True, (words[0][1:] != words[0][:-1]) | (words[1][1:] != words[1][:-1]) | np.array([x != y for x, y in zip(langs[1:], langs[:-1], strict=True)], bool)]
            starts = np.flatnonzero(new)
            ends, found = np.r_[starts[1:], len(c)], []
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                whole = not (edge_first and k == 0) and not (edge_last and k == len(starts) - 1)
                found += [(langs[a], *[int(w[a + at]) for w in words[:n]], *[None] * (4 - n), total) for n, at, total in extend([w[a:b] for w in words], c[a:b], 2, support if whole else 1)]
            types = (pa.string(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 6, types, strict=True)], names)

        edge = True  # the first prefix of a task may begin in the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select(names)
            held = rows if held is None else pa.concat_tables([held, rows])
            last = [held[x][held.num_rows - 1].as_py() for x in names[:3]]
            h1, h2 = np.asarray(held["h1"]), np.asarray(held["h2"])
            other = np.flatnonzero((h1 != last[1]) | (h2 != last[2]) | np.array([x != last[0] for x in held["lang"].to_pylist()], bool))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield grown(held.slice(0, cut), edge, False)
                held, edge = held.slice(cut), False
            elif held.num_rows > MOST_HELD:
                yield grown(held, True, True)
                held, edge = None, True
        if held is not None and held.num_rows:
            yield grown(held, edge, True)
        give_back()

    return run


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(lang, h, word, c) of all words, and (lang, p, a) of the phrases of two to LONGEST words with ``support``: p lists hashes."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = docs.mapInArrow(_count, "lang string, word binary, h long, c long").groupBy("lang", "word", "h").agg(F.sum("c").alias("c"))
    words = written(words, "words")
    if words.groupBy("lang", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("two words of a language have one hash")
    often = words.where((F.col("c") >= support) & (F.length("word") > 0))
    sent = spark.sparkContext.broadcast(filter_of(often.select(key_column("h").alias("key"))))
    pairs = docs.mapInArrow(_pairs(sent), "lang string, h1 long, h2 long, c long").groupBy("lang", "h1", "h2").agg(F.sum("c").alias("c"))
    pairs = written(pairs.where(F.col("c") >= support), "pairs")
    sent2 = spark.sparkContext.broadcast(filter_of(pairs.select(key_column("h1", "h2").alias("key"))))
    sent.unpersist()
    keys = ["lang", "h1", "h2", "h3", "h4"]
    pointers = docs.mapInArrow(_pointers(sent2), "lang string, h1 long, h2 long, h3 long, h4 long, c long").groupBy(*keys).agg(F.sum("c").alias("c"))
    dealt = pointers.repartitionByRange(*keys).sortWithinPartitions(*keys)
    grown = dealt.mapInArrow(_grow(support), "lang string, h1 long, h2 long, h3 long, h4 long, c long").groupBy(*keys).agg(F.sum("c").alias("a"))
    longer = grown.where(F.col("a") >= support).select("lang", F.array_compact(F.array("h1", "h2", "h3", "h4")).alias("p"), "a")
    phrases = written(pairs.select("lang", F.array("h1", "h2").alias("p"), F.col("c").alias("a")).unionByName(longer), "phrases")
    sent2.unpersist()
    return words, phrases


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, p, a, l, r, score: by the cut of the lowest score, the first of equal ones."""
    counts = words.where(F.length("word") > 0).select("lang", F.array("h").alias("p"), F.col("c").alias("f")).unionByName(phrases.select("lang", "p", F.col("a").alias("f")))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("lang", "p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("x"), F.slice("p", F.col("k") + 1, F.size("p")).alias("y"))
    part = lambda side, name: counts.select("lang", F.col("p").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "p", "a", "cut.l", "cut.r", "cut.score")


def without_parts(found: DataFrame, phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """Leaves out what lies inside a longer phrase that has ``share`` percent of its occurrences."""
    spans = [F.slice("p", i + 1, n) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    whole = lambda s, n, i: F.when(F.size("p") >= i + n, s)
    sizes = [(n, i) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    inner = F.array_compact(F.array(*[F.when(F.size("p") > n, whole(s, n, i)) for s, (n, i) in zip(spans, sizes, strict=True)]))
    parts = phrases.where(F.size("p") > 2).select("lang", F.explode(inner).alias("p"), F.col("a").alias("longer")).groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    kept = F.expr(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {share}")
    return found.join(parts, ["lang", "p"], "left").where(kept).drop("longer")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language."""
    words, phrases = frequent_phrases(docs, support)
    found = without_parts(scored(words, phrases), phrases)
    spelt = found.select("lang", "p", F.posexplode("p").alias("k", "h")).join(words.where((F.col("c") >= support) & (F.length("word") > 0)).select("lang", "h", F.col("word").cast("string").alias("word")), ["lang", "h"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")
    found = found.join(spelt.groupBy("lang", "p").agg(text.alias("phrase")), ["lang", "p"])
    found = found.select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_count"))
    ranks = prefix_sums(found, ["lang"], ["by_score", "by_count", "phrase"], tag="ranks").where(F.col("at") < top)
    totals = words.where(F.length("word") == 0).select("lang", F.col("c").alias("n"))
    return ranks.join(totals, "lang").select("lang", (F.col("at") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same in DuckDB, from all runs of up to four words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with d as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from d),
t as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, unnest(range(1, len(w) + 1)) as i, w from w),
x as (select lang, unnest([w[i : i], w[i : i + 1], w[i : i + 2], w[i : i + 3]]) as p, unnest([1, 2, 3, 4]) as m, len(w) - i + 1 as there from g),
f as (select lang, p, m, count(*)::hugeint as f from x where m <= there group by all),
c as (select * from f where m >= 2 and f >= {SUPPORT}),
k as (select lang, p, m, f as a, unnest(range(1, m)) as k from c),
s as (select k.lang, k.p, k.m, k.a, k.k, l.f as l, r.f as r, (2000000 * a) // (l.f + r.f) as score from k
  join f l on l.lang = k.lang and l.p = k.p[1 : k.k] join f r on r.lang = k.lang and r.p = k.p[k.k + 1 : k.m]),
b as (select * from s qualify row_number() over (partition by lang, p order by score, k) = 1),
i as (select lang, p[a : a + n - 1] as p, max(f) as longer from (select lang, p, m, f, unnest(range(1, m + 1)) as a from c where m > 2) y, (values (2), (3)) v(n) where n < m and a + n - 1 <= m group by all),
o as (select b.*, array_to_string(b.p, ' ') as phrase from b left join i on i.lang = b.lang and i.p = b.p where longer is null or 100 * longer < {SHARE} * b.a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from o)
select z.lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, t.n, score::bigint as score from z join t on t.lang = z.lang where rank <= {TOP}
"""


ORACLE = _oracle()
