"""Tests that belong to changed files: by their names, and by the names that their texts hold.

Many stems are looked for in a text at once, with an Aho-Corasick automaton: one pass over each test's text whatever their number. The
stems are broadcast in blocks of BLOCK bytes, so a task holds one block's automaton; a further block is a further pass, over the
tests that none has selected yet.

Cases: a test with a null text holds nothing; stems are compared in lower case and may stand anywhere in the text; without changed
files no test belongs to them; a changed test is selected itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.sources.store import remove, stored

BLOCK = 4 << 20


def _automaton(words: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    return automaton


def _found(sent):
    """(path, word) for each word that a text holds, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for rows in batches:
            found = [(p, w) for p, t in zip(rows.column("path").to_pylist(), rows.column("text").to_pylist(), strict=True) if t is not None for w in sorted({w for _, w in automaton.iter(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], ["path", "word"])

    return run


def found_words(texts: DataFrame, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, word: which of ``words`` (one column) each of ``texts`` (path, text) holds; a pass for each block of words, as a rule one."""
    spark, out = texts.sparkSession, None
    for some in blocks(words.where(F.length(words.columns[0]) > 0), block):
        new = texts.select("path", "text").mapInArrow(_found(spark.sparkContext.broadcast(some)), "path string, word string")
        out = new if out is None else out.unionByName(new)
    return texts.select("path", F.lit("").alias("word")).where("false") if out is None else out.distinct()


def _holding(sent):
    """Rows of (path, text) whose text holds one of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for rows in batches:
            keep = [t is not None and next(automaton.iter(t), None) is not None for t in rows.column("text").to_pylist()]
            yield rows.filter(pa.array(keep, pa.bool_())).select(["path"])

    return run


def blocks(words: DataFrame, most: int) -> Iterator[list[str]]:
    """The words in pieces of at most ``most`` bytes or one word; the driver holds one piece at a time."""
    held: list[str] = []
    size = 0
    for (w,) in words.toLocalIterator():
        n = len(w.encode()) + 64
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(w)
        size += n
    if held:
        yield held


def holding(texts: DataFrame, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """path of the rows of ``texts`` (path, text) whose text holds one of ``words`` (one column, not empty, lower case)."""
    spark, found, path = texts.sparkSession, None, None
    for some in blocks(words, block):
        sent = spark.sparkContext.broadcast(some)
        rest = texts if found is None else texts.join(found, "path", "left_anti")
        new = rest.select("path", "text").mapInArrow(_holding(sent), "path string")
        before, (found, path) = path, stored(new if found is None else found.unionByName(new), "holding")
        sent.unpersist()
        if before:
            remove(spark, before)
    return texts.select("path").where("false") if found is None else found


def related_tests(files: DataFrame, corpus: DataFrame, changed: DataFrame, block: int = BLOCK) -> DataFrame:
    """path of the tests below tests/ to run for the changed Python files (``changed``: path).

    ``files`` has path, n (lower-case name), st (stem) and suf (suffix), ``corpus`` path and content.
    """
    touched = files.join(changed.select("path").distinct(), "path", "left_semi").where((F.col("suf") == ".py") & (F.col("st") != "")).select("path", "st")
    bare = F.regexp_replace(F.regexp_replace("st", "^test_", ""), "_test$", "")
    tests = files.where((F.col("suf") == ".py") & F.startswith("path", F.lit("tests/")) & F.startswith("n", F.lit("test"))).select("path", bare.alias("st"))
    stems = touched.select("st").distinct()
    texts = corpus.join(tests.select("path"), "path", "left_semi").select("path", F.lower("content").alias("text"))
    own = touched.where(F.startswith("path", F.lit("tests/"))).select("path")
    return own.unionByName(tests.join(stems, "st", "left_semi").select("path")).unionByName(holding(texts, stems, block)).distinct()
