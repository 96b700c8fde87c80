"""Language ID: a bidirectional GRU over bytes labels every position; a document's probabilities are pooled over all of them.

The network reads one word (at most PIECE bytes of it at a time) with the states reset in between, so a word's labels do not depend
on its neighbours and each task runs the network once for each distinct word that it meets, for whole texts of any length.
Training is on the driver, on a documented bounded sample: PER_LANGUAGE documents of each language (those with the least hashes of
doc_id; of a longer text LONGEST characters from a place that the hash picks, fewer if there are so many languages that the samples together
would have more than SAMPLED), and WORDS pieces of words drawn from them.

Cases: a null text, or one without any letter, is "und" with score 0; a table without labelled training rows gives "und"
everywhere; repeated rows get equal results; ties go to the label that sorts first; a null doc_id is never trained on nor held
out; other columns are ignored (operator) or kept (``in_known_language``); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bigru import BiGRU
from .common import LOWER, table, text_chunks, written

PIECE, STEP = 24, 4 << 20
PER_LANGUAGE, LONGEST, WORDS, STEPS, MAX_LANGUAGES = 300, 20_000, 40_000, 350, 200
#: Characters of all languages' samples together: what comes to the driver.
SAMPLED = 60_000_000
#: Distinct words whose results a task remembers.
REMEMBERED = 200_000


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(1))


def least_hashes(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """lang, h, t: distinct rows of each language up to a hash below which PER_LANGUAGE of them are, or all there are.

    Hashes are uniform, so a few times PER_LANGUAGE rows are below the share of the hashes that is tried first, whatever the language's
    size; where ids are repeated there may be fewer, and a larger share is tried.
    """
    share = {lang: min(1.0, 4 * PER_LANGUAGE / n) for lang, n in sizes.items()}
    while True:
        upto = [(lang, 2**63 - 1 if s >= 1 else -(2**63) + int(s * 2**64)) for lang, s in share.items()]
        bound = F.broadcast(rows.sparkSession.createDataFrame(upto, "lang string, upto long"))
        some = written(rows.join(bound, "lang").where(F.col("h") <= F.col("upto")).select("lang", "h", "t").distinct(), "least")
        found = {r.lang: r.n for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        short = [lang for lang, s in share.items() if s < 1 and found.get(lang, 0) < PER_LANGUAGE]
        if not short:
            return some
        share |= {lang: min(1.0, 8 * share[lang]) for lang in short}


def train(docs: DataFrame) -> tuple[list[str], BiGRU] | None:
    """The languages and the network, from documents of which the fold is not 1."""
    rows = docs.where((fold(F.col("doc_id")) != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    h, text = F.xxhash64(F.col("doc_id").cast("string")), F.col("text").cast("string")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), h.alias("h"), F.xxhash64(text).alias("t"), text.alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    names = sorted(sizes)
    # The least hashes of doc_id of each language, of equal ones the least of the text; equal rows are one.
    ranked = least_hashes(rows.select("lang", "h", "t"), sizes).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t")))
    chosen = F.broadcast(ranked.where(F.col("k") <= PER_LANGUAGE).drop("k"))  # PER_LANGUAGE * MAX_LANGUAGES short rows at most
    longest = min(LONGEST, SAMPLED // (PER_LANGUAGE * len(names)))
    place = F.pmod("h", F.greatest(F.length("text") - longest, F.lit(0)) + 1).cast("int")
    sample = rows.join(chosen, ["lang", "h", "t"]).select("h", "lang", F.substring("text", place + 1, F.lit(longest)).alias("text"))
    sample = sorted(sample.dropDuplicates().collect())
    rng = np.random.default_rng(3)
    words, labels = [], []
    for k, name in enumerate(names):
        own = [w[i : i + PIECE] for r in sample if r.lang == name for w in r.text.encode().translate(LOWER).split() for i in range(0, len(w), PIECE)]
        for i in rng.integers(0, len(own), WORDS // len(names) if own else 0).tolist():
            words.append(own[i])
            labels.append(k)
    net = BiGRU(len(names))
    if words:
        net.fit(words, np.array(labels), STEPS)
    return names, net


class Scores(dict):
    """Word -> row of ``table``, the sum over its positions of label probabilities; new words wait in ``new``."""

    def __init__(self, net: BiGRU, labels: int):
        super().__init__()
        self.net, self.labels = net, labels
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.table, self.new = np.zeros((0, self.labels), np.float32), []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.table) + len(self.new)
        self.new.append(word)
        return i

    def learn(self) -> None:
        if not self.new:
            return
        out = np.zeros((len(self.new), self.labels), np.float32)
        size = np.array([len(w) for w in self.new])
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            for i in range(0, len(of), 4096):
                part = of[i : i + 4096]
                seq = np.frombuffer(b"".join([self.new[j] for j in part.tolist()]), np.uint8).reshape(-1, n)
                out[part] = self.net.probabilities(seq).sum(0)
        self.table, self.new = np.concatenate([self.table, out]), []


def pieces(words: list[bytes]) -> list[bytes]:
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def has_letter(text: bytes) -> bool:
    if text.lower() != text.upper():
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predict(names: list[str], net: BiGRU | None, least: float | None):
    """Rows of doc_id, lang_pred, score; or with ``least`` the rows themselves that are in a language with that score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(net, len(names)) if net else None
        for rows, data, offsets in text_chunks(batches, STEP):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if known is not None and has_letter(t)]
            if asked:
                if len(known) > REMEMBERED:
                    known.forget()
                get, places, counts, sizes = known.__getitem__, [], [], []
                for i in asked:
                    words = pieces(texts[i].translate(LOWER).split())
                    places.append(np.fromiter(map(get, words), np.int64, len(words)))
                    counts.append(len(words))
                    sizes.append(sum(map(len, words)))
                known.learn()
                starts = np.cumsum([0, *counts[:-1]])
                pooled = np.add.reduceat(known.table[np.concatenate(places)], starts, axis=0, dtype=np.float64)
                pooled /= np.array(sizes)[:, None]
                best = pooled.argmax(1)
                for i, b, p in zip(asked, best.tolist(), pooled.max(1).tolist(), strict=True):
                    lang[i], score[i] = names[b], min(1.0, max(0.0, p))
            if least is None:
                cols = [rows.column("doc_id"), rows.column("held_out"), pa.array(lang), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])
            else:
                yield rows.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score.tolist(), strict=True)]))

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    names, net = train(docs) or ([], None)
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1) & F.col("doc_id").isNotNull()
    asked = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return asked.mapInArrow(_predict(names, net, None), "doc_id long, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are in a learned language with at least the score ``least``."""
    names, net = train(docs) or ([], None)
    return docs.mapInArrow(_predict(names, net, least), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
