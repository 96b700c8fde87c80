"""An inverted index of a corpus: questions read the postings of their words, not the facts or contents of every file.

Stored once below a folder, each table in hash buckets that are its partition folders, so that a lookup reads its buckets only:

* ``postings`` (word, field, path, lines): the words (runs of letters, digits and underscores, lower case) of what describes a file
  (field ``about``) and of its lines (field ``text``, with their numbers from 0).
* ``words`` (word, about, text): in how many files a word stands, by field.
* ``grams`` (gram, word): the runs of two and three characters of each distinct word. A term has no other characters than words have,
  so what contains it contains it inside a word: words that have all the term's grams are looked up and verified.
* ``lines`` (path, i, line): for the text around a hit.

A word that a third of all files hold is a third of the postings of its bucket and no group of any kind: postings are rows, summed by
path. Lists of line numbers are no longer than their file.

Cases: a term of one character or with other characters is refused (ValueError), as ``terms_of`` makes none; files without words
have no postings; an empty corpus gives an empty index that answers with nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.functions import extract as X
from loam.plans.dialect import SPARK
from loam.sources.store import work_dir, written

WORD = r"([\p{L}\p{N}_]+)"
BUCKETS = 32
#: Words that a task gathers at once.
AT_ONCE = 1 << 20
#: Spark's setting of how many partition folders a task writes at once before it sorts its rows by folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
TABLES = ("postings", "words", "grams", "lines")


def bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def bucket_of(value: str) -> int:
    """``bucket`` of one value."""
    h = xxhash.xxh64_intdigest(value.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


def about() -> Column:
    """What describes a file: its path, summary, symbols and imports."""
    return F.lower(F.concat_ws(" ", "path", "summary", F.array_join("symbols", " "), F.array_join("imports", " ")))


def grams_of(c: Column, n: int) -> Column:
    """The distinct runs of n characters; none of shorter texts."""
    places = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(n))))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, path, lines of rows (path, words: of each line its words): a file's words are gathered where the file is, so none is shuffled."""
    for rows in batches:
        lengths = pc.fill_null(pc.list_value_length(rows.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # Files of so many lines or words at once; a longer one alone.
        sizes = np.zeros(rows.num_rows + 1, np.int64)
        inner = rows.column("words").flatten()
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        sizes[1:] = at[np.cumsum(lengths)]
        start = 0
        while start < rows.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + AT_ONCE, "right")) - 1)
            yield from _postings_of(rows.slice(start, end - start), lengths[start:end])
            start = end


def _postings_of(rows: pa.RecordBatch, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    inner = rows.column("words").flatten()
    each = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = inner.flatten().dictionary_encode()
    if not len(found):
        return
    first = np.cumsum(lengths) - lengths
    line = np.repeat(np.arange(len(inner)) - np.repeat(first, lengths), each)
    n = len(found.dictionary)
    key = np.repeat(np.repeat(np.arange(rows.num_rows), lengths), each) * n + found.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")  # lines ascend already
    key, line = key[order], line[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])
    key, line = key[new], line[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    offsets, key = np.concatenate([starts, [len(line)]]), key[starts]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(line, pa.int32()))
    out = pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(key % n)), rows.column("path").take(pa.array(key // n)), lists], ["word", "path", "lines"])
    for i in range(0, out.num_rows, 1 << 16):
        yield out.slice(i, 1 << 16)


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 1)


def text_postings(rows: DataFrame) -> DataFrame:
    """word, path, lines of rows (path, rows: the file's lines)."""
    return rows.select("path", F.transform("rows", lambda x: words_of(F.lower(x))).alias("words")).mapInArrow(_postings, "word string, path string, lines array<int>")


def ranked(files: DataFrame, scores: DataFrame, limit: int = 8) -> DataFrame:
    """path, score, line_count: best first, then the shorter. Facts are joined to the files that have a hit (``scores``: path, s)."""
    rows = files.select("path", "line_count", "has_main", "has_function", "has_class").join(scores, "path")
    score = F.col("s") + F.col("has_main").cast("int") + (F.col("has_function") | F.col("has_class")).cast("int")
    return rows.select("path", score.alias("score"), "line_count").orderBy(F.desc("score"), "line_count", "path").limit(limit)


def scanned_scores(files: DataFrame, terms: Sequence[str], boosts: Sequence[str] = ()) -> DataFrame:
    """What ``TextIndex.scores`` says, by one pass over the facts: for one question, where there is no index."""
    each = [F.expr(X.term_score(SPARK, "hay", t)).alias(f"t{i}") for i, t in enumerate(terms)]
    each += [F.contains("hay", F.lit(t)).cast("int").alias(f"b{i}") for i, t in enumerate(boosts)]
    names = [f"t{i}" for i in range(len(terms))] + [f"b{i}" for i in range(len(boosts))]
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    # Rows of one path are one file.
    hits = files.select("path", about().alias("hay")).select("path", *each).where(total(F.col(c) for c in names) > 0).groupBy("path").agg(*[F.max(c).alias(c) for c in names])
    return hits.select("path", total(F.col(c) for c in names).cast("long").alias("s"))


SNIPPETS = "k int, n int, path string, start_line long, end_line long, text string"


def snippets(hits: DataFrame, lines: DataFrame, paths: Sequence[str], around: int = 2, each: int = 2, enough: int = 12) -> DataFrame:
    """The first lines of each file that hold a term, with lines around them; files after ``enough`` snippets are left out.

    k (place of the file in ``paths``), n (from 1 within the file), path, start_line, end_line, text. ``paths`` are the few
    files of one answer, ``hits`` (path, at) and ``lines`` (path, i, line) theirs only.
    """
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("at"))).where(F.col("n") <= each)
    place = F.array_position(F.array(*[F.lit(p) for p in paths]), F.col("path")).cast("int")
    # At most ``each`` rows for each of ``paths`` are left: how many come from the files before decides which are shown.
    before = F.coalesce(F.sum(F.lit(1)).over(Window.orderBy("k").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = first.withColumn("k", place).withColumn("before", before).where(F.col("before") < enough)
    near = lines.join(F.broadcast(shown), "path").where(F.abs(F.col("i") - F.col("at")) <= around)
    text = F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: F.concat((x["i"] + 1).cast("string"), F.lit(": "), x["line"]))
    found = near.groupBy("k", "n", "path").agg((F.min("i") + 1).cast("long").alias("start_line"), (F.max("i") + 1).cast("long").alias("end_line"), F.array_join(text, "\n").alias("text"))
    return found.select("k", "n", "path", "start_line", "end_line", "text")


def scanned_snippets(corpus: DataFrame, terms: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """What ``TextIndex.snippets`` says, from the contents of the few files: the lines of these are stored, no others are cut."""
    if not paths or not terms:
        return corpus.sparkSession.createDataFrame([], SNIPPETS)
    lines = written(corpus.where(F.col("path").isin(list(paths))).select("path", F.posexplode(F.expr(X.lines(SPARK, "content"))).alias("i", "line")), "lines")
    holds = reduce(lambda a, b: a | b, [F.contains(F.lower("line"), F.lit(t)) for t in terms])
    return snippets(lines.where(holds).select("path", F.col("i").alias("at")).distinct(), lines, paths)


class TextIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        for name in TABLES:
            setattr(self, name, spark.read.parquet(f"{root}/{name}"))

    @classmethod
    def build(cls, files: DataFrame, corpus: DataFrame, root: str | None = None) -> TextIndex:
        """``files`` has facts (path, summary, symbols, imports), ``corpus`` path and content, which are read once."""
        spark = files.sparkSession
        root = root or f"{work_dir(spark)}/index"

        def store(df: DataFrame, name: str, key: str) -> DataFrame:
            """Each task writes into the folders of its rows' buckets as they come: nothing is shuffled or sorted for it."""
            before = spark.conf.get(WRITERS)
            spark.conf.set(WRITERS, str(BUCKETS))
            try:
                df.withColumn("b", bucket(F.col(key))).write.partitionBy("b").parquet(f"{root}/{name}")
            finally:
                spark.conf.set(WRITERS, before)
            return spark.read.parquet(f"{root}/{name}")

        rows = corpus.select("path", F.expr(X.lines(SPARK, "content")).alias("rows"))
        store(rows.select("path", F.posexplode("rows").alias("i", "line")), "lines", "path")
        text = text_postings(rows)
        said = files.select(F.explode(F.array_distinct(words_of(about()))).alias("word"), "path").withColumn("lines", F.array().cast("array<int>"))
        every = said.withColumn("field", F.lit("about")).unionByName(text.withColumn("field", F.lit("text")))
        if files.groupBy("path").count().where("count > 1").take(1):
            # Rows of one path are one file.
            every = every.groupBy("word", "path", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
        postings = store(every, "postings", "word")
        counts = [F.count(F.when(F.col("field") == f, 1)).alias(f) for f in ("about", "text")]
        known = store(postings.groupBy("word").agg(*counts), "words", "word")
        store(known.select("word", F.explode(F.concat(grams_of(F.col("word"), 2), grams_of(F.col("word"), 3))).alias("gram")), "grams", "gram")
        return cls(spark, root)

    def _among(self, table: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
        """Rows of the few values; only their buckets are listed and read."""
        return table.where(F.col("b").isin(sorted({bucket_of(v) for v in values}))).where(F.col(column).isin(list(values)))

    def matching(self, terms: Sequence[str]) -> DataFrame:
        """term, word: every word that contains the term, by one look at the grams of all terms. Each distinct term once."""
        rows = []
        for t in dict.fromkeys(terms):
            if len(t) < 2 or not re.fullmatch("[a-z0-9_]+", t):
                raise ValueError(f"not a term: {t!r}")
            n = min(3, len(t))
            grams = {t[i : i + n] for i in range(len(t) - n + 1)}
            rows += [(t, g, len(grams)) for g in sorted(grams)]
        asked = self.spark.createDataFrame(rows, "term string, gram string, n int")
        some = self._among(self.grams, "gram", sorted({g for _, g, _ in rows})).select("gram", "word").join(F.broadcast(asked), "gram")
        some = some.groupBy("term", "word").agg(F.count("*").alias("held"), F.max("n").alias("n"))
        return some.where((F.col("held") == F.col("n")) & F.contains("word", F.col("term"))).select("term", "word")

    def postings_of(self, matched: DataFrame, field: str) -> DataFrame:
        """term, word, path, lines; by a join that prunes the buckets of other words."""
        return self.postings.where(F.col("field") == field).join(matched.withColumn("b", bucket(F.col("word"))), ["b", "word"]).select("term", "word", "path", "lines")

    def scores(self, terms: Sequence[str], boosts: Sequence[str] = ()) -> DataFrame:
        """path, s: for each of the terms (repeated ones count again) 4 for the word itself, 1 inside one; 1 for each boost inside."""
        times = {t: terms.count(t) for t in terms}
        extra = {t: boosts.count(t) for t in boosts}
        hits = self.postings_of(self.matching([*terms, *boosts]), "about").groupBy("path", "term").agg(F.max((F.col("word") == F.col("term")).cast("int")).alias("whole"))
        weight = lambda w: F.coalesce(*[F.when(F.col("term") == t, n) for t, n in w.items()], F.lit(0)) if w else F.lit(0)
        return hits.groupBy("path").agg(F.sum(weight(times) * F.when(F.col("whole") == 1, 4).otherwise(1) + weight(extra)).alias("s"))

    def rank(self, files: DataFrame, terms: Sequence[str], boosts: Sequence[str] = (), limit: int = 8) -> DataFrame:
        """``ranked`` by postings."""
        return ranked(files, self.scores(terms, boosts), limit)

    def snippets(self, terms: Sequence[str], paths: Sequence[str], around: int = 2, each: int = 2, enough: int = 12) -> DataFrame:
        """``snippets`` of the few files ``paths``: of the postings only theirs are kept, of the lines only their buckets are read."""
        if not paths or not terms:
            return self.spark.createDataFrame([], SNIPPETS)
        hits = self.postings_of(self.matching(terms), "text").where(F.col("path").isin(list(paths))).select("path", F.explode("lines").alias("at")).distinct()
        return snippets(hits, self._among(self.lines, "path", paths), paths, around, each, enough)
