"""Corpus sources: file trees, scan caches, reports. Listing is pruned before contents are read."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target")
MOST_BYTES = 1 << 20
SAMPLE = 65_536


def read_tree(
    spark: SparkSession, root: str, extensions: Iterable[str] | None = None, ignored: Iterable[str] = IGNORED, most_bytes: int = MOST_BYTES,
    sample_bytes: int | None = None, only: list[str] | None = None,
) -> DataFrame:
    """path (relative, POSIX), content, size, modified of the text files below ``root``, any file system that Spark reads.

    Size and path filters are decided on the listing, before a file is opened. Invalid UTF-8 bytes are dropped. With
    ``sample_bytes`` content is cut after so many bytes; size and hash stay those of the whole file. With ``only`` no other files than
    these (relative paths) are opened or listed.
    """
    if only == []:
        return spark.createDataFrame([], "path string, content string, size long, hash string, modified timestamp")
    places = root if only is None else [re.sub(r"([*?{}\[\]\\])", r"\\\1", f"{root.rstrip('/')}/{p}") for p in only]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(places).where(F.col("length") <= most_bytes)
    base = re.sub(r"^file:/*", "/", root.rstrip("/")) if root.startswith(("file:", "/")) else root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(base) + "/", "")
    files = raw.withColumn("path", path)
    parts = F.split(F.lower("path"), "/")
    files = files.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x.lower()) for x in ignored])))
    if extensions is not None:
        name = F.element_at(F.split("path", "/"), -1)
        suffix = F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))
        wanted = [e.lower() for e in extensions]
        files = files.where(suffix.isin(wanted) | F.lower(name).isin(wanted))
    kept = F.col("content") if sample_bytes is None else F.substring("content", 1, sample_bytes)
    files = files.select("path", kept.alias("raw"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified"))
    return files.select("path", _decoded_column(F.col("raw")).alias("content"), "size", "hash", "modified")


def _decoded_column(raw: Column) -> Column:
    """Bytes as text without those that are no UTF-8; only rows that have such bytes leave the JVM."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def decode(raw: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in raw.to_pylist()], pa.string())

    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(decode(raw))


def without_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files that are not, and are not below, one of the paths of ``ignored`` (column path): all leading parts are looked up."""
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = files.select("path", F.explode(heads).alias("head")).join(ignored.select(F.col("path").alias("head")).distinct(), "head", "left_semi")
    return files.join(hit.select("path").distinct(), "path", "left_anti")


def fresh_and_cached(listing: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to extract again, cached facts that still hold) by path, size and modification time."""
    keys = ["path", "size", "modified"]
    return listing.join(cache.select(*keys), keys, "left_anti"), cache.join(listing.select(*keys), keys, "left_semi")


def coverage_report(spark: SparkSession, path: str) -> DataFrame:
    """filename, line_rate, percent of a coverage XML."""
    # The two attributes that are read, so that no pass over the reports infers them.
    rows = spark.read.schema("`_filename` string, `_line-rate` string").format("xml").option("rowTag", "class").option("mode", "FAILFAST").load(path)
    rate = F.col("`_line-rate`").cast("double")
    return rows.select(F.col("_filename").alias("filename"), rate.alias("line_rate"), F.bround(rate * 100, 1).alias("percent"))


def coverage_gaps(risks: DataFrame, report: DataFrame, least: float = 0.7, most: int = 10) -> DataFrame:
    """The riskiest files without coverage, or below ``least``."""
    found = risks.join(report.select(F.col("filename").alias("file"), "line_rate"), "file", "left")
    return found.where(F.col("line_rate").isNull() | (F.col("line_rate") < least)).orderBy(F.desc("score"), "file").limit(most)


def git_listing(spark: SparkSession, root: str, timeout: int = 30) -> DataFrame | None:
    """Paths that git knows or does not ignore; None where git cannot tell."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard"], capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return spark.createDataFrame([(p,) for p in sorted(set(out.split("\n")) - {""})], "path string")


def changed_files(root: str, timeout: int = 30) -> list[str]:
    """What differs from the last commit, and what git status names."""
    out: set[str] = set()
    for args, cut in ((["diff", "--name-only"], 0), (["status", "--short"], 3)):
        try:
            text = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=True).stdout
        except (OSError, subprocess.SubprocessError):
            continue
        out |= {line[cut:].strip() for line in text.splitlines() if line[cut:].strip()}
    return sorted(out)


def repository_name(source: str) -> str:
    """A safe folder name for a repository's address."""
    tail = re.sub(r"\.git$", "", source.rstrip("/").rsplit("/", 1)[-1].rsplit(":", 1)[-1])
    return re.sub(r"[^A-Za-z0-9_.-]+", "-", tail).strip("-.") or "repository"


def python_modules(paths: Iterable[str]) -> Iterator[tuple[str, str]]:
    for p in paths:
        parts = [x for x in PurePosixPath(p).with_suffix("").parts if x != "__init__"]
        yield p, ".".join(parts)


def merged(base: dict, override: dict) -> dict:
    """Override wins; nested dicts are merged."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def truthy(name: str) -> bool:
    return os.environ.get(name, "").strip().lower() in {"1", "true", "yes", "on"}
