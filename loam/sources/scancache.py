"""Incremental scans: facts of unchanged files come from a keyed table, only the others are extracted and written.

A file's facts hold while its path, size and modification time are the same. Facts of a full scan serve any later one, those of a fast
scan (``mode``: full, or fast with its sample size) its own mode only. Facts of files that are gone are deleted.

The facts of a scan are hits and misses together; the table gets a change with the misses in their buckets, so the bytes written grow
with what changed, not with the corpus. Counts come from the same pass that stores the facts (an ``Observation``).

Cases: an empty listing deletes all facts; null sizes or times are compared as values; two rows of one path are an error of the caller.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import read_tree
from .keyed import KeyedTable
from .store import written

VERSION = 1
MODE = "_mode"
#: Files that are read by their names; more are read by a pass over the tree.
BY_NAME = 10_000


def cache_of(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path.rstrip('/')}/v{VERSION}", ["path"])


def _holds(mode: str) -> Column:
    """Whether a cached row (c) is that of the listed file (l), in a mode that serves."""
    return F.col("l.size").eqNullSafe(F.col("c.size")) & F.col("l.modified").eqNullSafe(F.col("c.modified")) & F.col(f"c.{MODE}").isin("full", mode)


def incremental_scan(listing: DataFrame, cache: str, mode: str, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """(facts of all files of ``listing``, counts); ``listing`` has path, size, modified and what ``extract`` needs.

    ``extract`` turns rows of the listing that the cache does not hold into facts with path, size and modified. Counts: hits, misses,
    writes (files whose facts were written), deleted, bytes (written to the cache) and milliseconds.
    """
    spark, began = listing.sparkSession, time.perf_counter()
    table = cache_of(spark, cache)
    m = table.manifest()
    held = None if m is None else table.read(m.version)
    if held is None:
        fresh, valid, gone = listing, None, None
    else:
        known = held.select("path", "size", "modified", MODE)
        same = (F.col("l.path") == F.col("c.path")) & _holds(mode)
        fresh = listing.alias("l").join(known.alias("c"), same, "left_anti")
        valid = held.alias("c").join(listing.select("path", "size", "modified").alias("l"), same, "left_semi")
        gone = known.select("path").join(listing.select("path"), "path", "left_anti")
    new = written(extract(fresh), "fresh").withColumn(MODE, F.lit(mode))
    every = new.withColumn("_hit", F.lit(False))
    if valid is not None:
        every = every.unionByName(valid.withColumn("_hit", F.lit(True)), allowMissingColumns=True)
    seen = Observation("scan")
    counted = every.observe(seen, F.count(F.when(F.col("_hit"), 1)).alias("hits"), F.count(F.when(~F.col("_hit"), 1)).alias("misses"))
    facts = written(counted.drop("_hit", MODE), "facts")
    counts = {"hits": 0, "misses": 0, **seen.get}
    counts |= {"writes": counts["misses"], "deleted": gone.count() if gone is not None else 0, "bytes": 0}
    if m is None or counts["writes"] or counts["deleted"]:
        before = set(table.folders())
        table.commit(new, gone, base=m.version if m else 0)
        counts["bytes"] = sum(table.bytes_of(f) for f in set(table.folders()) - before)
    counts["milliseconds"] = round((time.perf_counter() - began) * 1000)
    return facts, counts


def scan_tree(spark: SparkSession, root: str, cache: str, extract: Callable[[DataFrame], DataFrame], mode: str = "full", sample_bytes: int | None = None, **filters) -> tuple[DataFrame, dict[str, int]]:
    """An incremental scan of a file tree, in the order of its paths: the tree is listed, and only files that the cache does not hold are opened.

    ``filters`` are those of ``read_tree``. Up to BY_NAME such files are opened by name; more by a pass over the tree.
    """
    whole = read_tree(spark, root, sample_bytes=sample_bytes, **filters)
    listing = whole.select("path", "size", "modified")  # no content is read for these columns

    def contents(rows: DataFrame) -> DataFrame:
        few = [r.path for r in rows.select("path").limit(BY_NAME + 1).collect()]
        if len(few) > BY_NAME:
            return extract(whole.join(rows.select("path"), "path", "left_semi"))
        return extract(read_tree(spark, root, sample_bytes=sample_bytes, only=few, **filters))

    facts, counts = incremental_scan(listing, cache, mode, contents)
    return facts.orderBy("path"), counts
