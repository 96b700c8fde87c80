"""Language-model scoring by a subword lattice.

A word's lattice has an arc for each piece of an existing vocabulary at each place, and one arc for the whole word if the training
documents hold it; its probability is the marginal over all paths. The vocabulary's scores are the pieces' prior: they weight the
lattice from the first pass on and stay in as PRIOR pseudo-counts for each piece, beside the counts that expectation maximisation
over all distinct training words expects. The word arcs share 1 - new by their counts and the spellings share ``new``, the
Good-Turing estimate (words seen once, of all). All of this stays in logarithms (natural; log10 in the result), so words of any
length keep their probability. A document's score is the sum over its words and its end.

Scale: words are counted with partial sums on both sides of one shuffle. The most frequent words, at most HEAD, are
broadcast with their scores; the other tokens, one row for each document and distinct word, are joined with the table of counts,
and only sums go back to the documents. Text is never shuffled. Each document's own row has a join key that is no word, so these
rows are spread like the others.

Cases: null and empty texts are one end token; repeated rows are scored each; without training documents all counts are 0, the
vocabulary's own weights hold and an end has probability 1/2; a null doc_id belongs to the training documents; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import keyed
from .common import LOWER, table, text_chunks, written
from .lattice import Lattice, vocabulary

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD, STEP, ROUNDS = 100_000, 4 << 20, 2
#: Longer words are not broadcast.
HEAD_BYTES = 64
#: Pseudo-counts that the vocabulary's scores share, for each of its pieces.
PRIOR = 1.0
REMEMBERED = 300_000
LOG10 = math.log(10)
#: A document's own row has ``tokens``, and as its word a separator followed by the document's number; other rows a word.
TOKENS = "doc long, doc_id long, held_out boolean, tokens long, known long, base double, score double, word binary, times int, sub double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words; an empty word counts the ends."""

    def rows() -> pa.RecordBatch:
        cols = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["word", "c"])

    seen: Counter = Counter()
    for piece, data, offsets in text_chunks(batches, STEP):
        raw = data.tobytes().translate(LOWER)
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            seen.update(raw[a:b].split())
        seen[b""] += piece.num_rows
        if len(seen) > REMEMBERED or sum(map(len, seen)) > 16 * STEP:
            yield rows()
            seen.clear()
    if seen:
        yield rows()


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Small batches together, so that the lattice works on many words of one length at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _expect(pieces: list[bytes], logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logs)
        expect = np.zeros(len(pieces))
        for rows in gathered(batches):
            lattice.score(rows.column("word").to_pylist(), expect)
        expect = lattice.by_piece(expect)
        i = np.flatnonzero(expect)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(expect[i])], ["piece", "n"])

    return run


def _scored(pieces: list[bytes], logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logs)
        for rows in gathered(batches):
            sub = lattice.score(rows.column("word").to_pylist())
            yield from rows.append_column("sub", pa.array(sub)).to_batches()

    return run


@dataclass(frozen=True)
class Totals:
    """Of the training documents: tokens, distinct tokens, ends, words that occur once."""

    n: int
    v: int
    ends: int
    once: int

    @property
    def new(self) -> float:
        """The share of words that training has not seen."""
        words = self.n - self.ends
        return (self.once + 1) / (words + 2) if words else 1.0

    @property
    def end(self) -> float:
        return (self.ends + 1) / (self.n + 2)

    def base(self, c: float) -> float:
        return math.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def score(self, c: np.ndarray, sub: np.ndarray) -> np.ndarray:
        """log10 probability of words with counts c, and log probabilities of their spellings."""
        spelled = math.log(self.new) + sub
        if self.new < 1:
            with np.errstate(divide="ignore"):
                spelled = np.logaddexp(spelled, np.log(c) + math.log1p(-self.new) - math.log(self.n - self.ends))
        return (spelled + math.log1p(-self.end)) / LOG10

    def base_column(self, c: Column) -> Column:
        return F.log10((c + 0.1) / F.lit(self.n + 0.1 * (self.v + 1)))

    def score_column(self, c: Column, sub: Column) -> Column:
        """``score`` of columns."""
        spelled = sub + math.log(self.new)
        if self.new < 1:
            seen = F.log(c) + (math.log1p(-self.new) - math.log(self.n - self.ends))
            spelled = F.when(c > 0, F.greatest(spelled, seen) + F.log1p(F.exp(-F.abs(spelled - seen)))).otherwise(spelled)
        return (spelled + math.log1p(-self.end)) / LOG10


def _tokens(pieces: list[bytes], logs: np.ndarray, head, totals: Totals):
    """For each document one row with the sums over head words and the end, and one for each other word (``sub``: natural log)."""
    ends = totals.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base_of, score_of = head.value
        place = {w: i for i, w in enumerate(words)}
        lattice, remembered = Lattice(pieces, logs), {}
        base_end, score_end = totals.base(ends), math.log10(totals.end)
        for rows, data, offsets in text_chunks(batches, STEP):
            raw = data.tobytes().translate(LOWER)
            held_out, docs, ids = (rows.column(k).to_pylist() for k in ("held_out", "doc", "doc_id"))
            out: dict[str, list] = {k.split()[0]: [] for k in TOKENS.split(", ")}
            tail: list[tuple[int, bytes, int]] = []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                count = Counter(raw[a:b].split())
                base = score = 0.0
                known = 0
                for w, k in count.items():
                    j = place.get(w)
                    if j is None:
                        tail.append((i, w, k))
                    else:
                        base += k * base_of[j]
                        score += k * score_of[j]
                        known += k
                row = (docs[i], ids[i], held_out[i], sum(count.values()) + 1, known + (ends > 0), base + base_end, score + score_end, b" %d" % docs[i], None, None)
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
            new = list({w for i, w, _ in tail if held_out[i] and w not in remembered})
            if len(remembered) + len(new) > REMEMBERED:
                remembered.clear()
                new = list({w for i, w, _ in tail if held_out[i]})
            remembered.update(zip(new, lattice.score(new).tolist(), strict=True))
            m = len(tail)
            out["doc"] += [docs[i] for i, _, _ in tail]
            for k in ("doc_id", "held_out", "tokens", "known", "base", "score"):
                out[k] += [None] * m
            out["word"] += [w for _, w, _ in tail]
            out["times"] += [k for _, _, k in tail]
            out["sub"] += [remembered[w] if held_out[i] else None for i, w, _ in tail]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], list(out))

    return run


def estimate(words: DataFrame, pieces: list[bytes], prior: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece log probabilities after EM over all distinct words; what comes to the driver is one number for each piece.

    ``prior``: the log probabilities of the vocabulary's own scores, which the first round starts from and every round keeps.
    """
    logs = prior
    for _ in range(rounds):
        sums = words.mapInArrow(_expect(pieces, logs), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expect = PRIOR * len(pieces) * np.exp(prior)
        for r in sums.toLocalIterator():
            expect[r.piece] += r.n
        logs = np.log(expect / expect.sum())
    return logs


def head_count(words: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` words have it or a larger one; from a histogram of a few hundred bins."""
    each = 32
    bins = words.groupBy(F.floor(F.log2("c") * each).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    taken, least = 0, 2**62
    for r in sorted(bins, key=lambda r: -r.bin):
        taken += r.n
        if taken > head:
            break
        least = r.least
    return least


def score_documents(docs: DataFrame, vocabulary_path: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = keyed(docs).withColumn("held_out", held_out)
    counts = docs.where("not held_out").select("text").mapInArrow(_count, "word binary, c long")
    counts = written(counts.groupBy("word").agg(F.sum("c").alias("c")), "words")
    words = counts.where(F.length("word") > 0)
    total = counts.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends"),
        F.count(F.when((F.length("word") > 0) & (F.col("c") == 1), 1)).alias("once"),
    ).first()
    totals = Totals(total.n or 0, total.v, total.ends or 0, total.once)
    pieces, logs = vocabulary(vocabulary_path)
    logs = estimate(words, pieces, logs) if totals.new < 1 else logs
    short = words.where(F.length("word") <= HEAD_BYTES)
    top = short.where(F.col("c") >= head_count(short, head)).collect()
    top_words = [bytes(r.word) for r in top]
    score = totals.score(np.array([r.c for r in top], float), Lattice(pieces, logs).score(top_words))
    sent = spark.sparkContext.broadcast((top_words, [totals.base(r.c) for r in top], score.tolist()))
    tokens = docs.mapInArrow(_tokens(pieces, logs, sent, totals), TOKENS)
    scored = words.mapInArrow(_scored(pieces, logs), "word binary, c long, sub double").withColumnRenamed("sub", "sub_known")
    joined = tokens.join(scored, "word", "left")
    c, times, sub = F.coalesce("c", F.lit(0)), F.col("times"), F.coalesce("sub_known", "sub")
    base, score = F.coalesce("base", times * totals.base_column(c)), F.coalesce("score", times * totals.score_column(c, sub))
    known = F.coalesce("known", F.when(c > 0, times).otherwise(0))
    by_doc = joined.groupBy("doc").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("tokens").alias("n_tokens"), F.sum(known).alias("known"), F.sum(base).alias("base"),
        F.sum(score).alias("score"), F.count("tokens").alias("copies"),
    )
    each = by_doc.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
