"""Runs relations on Spark: contents are read once into a table of file facts, everything else is SQL over that."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loam.sources.store import written

from .dialect import BY_REPO, SPARK, Spark
from . import understanding  # noqa: F401  (registers its relations)
from .relations import RELATIONS, needed

#: Relations that others use again and again: each is stored when it is first needed, so no plan holds them twice.
STORED = (
    "metrics", "primary_language", "archetype", "entry_points", "file_issues", "scored", "top_risks", "hotspots", "kept_components", "frameworks", "all_frameworks", "language_scores",
    "coverage_warning", "all_issues", "health", "diff", "patterns", "readme", "core_roles", "identity", "project_type", "purpose", "understanding", "important_files",
    "workflow_hints", "raw_suggestions", "suggestions", "context_lines",
)


#: Bytes of a table of few or large files that one task gets, and how many tasks' bytes a file has at most that is not dealt out.
TASK_BYTES = 16 << 20
LARGE = 3


def spread(df: DataFrame, path: str) -> DataFrame:
    """Deals out a table of fewer files than cores or of large ones, whose row groups may be few, in tasks of bounded size; others stay as they are."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    tasks = max(cores, -(-length(df.sparkSession, path) // TASK_BYTES))
    return df.repartition(tasks) if files < cores or tasks > files * LARGE else df


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(there).getLength()


def changed(spark: SparkSession, path: str) -> int:
    """When a file or folder changed last, in milliseconds."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).getModificationTime()


class Engine:
    """Analyses of one corpus, or with the dialect ``BY_REPO`` of many repositories at once, each row with its ``repo``.

    ``corpus`` has path and content (strings); ``old_corpus`` likewise, for diffs. Facts have no contents; they are stored as a
    Parquet table in the shared folder, so every analysis reads only the columns that it names and none reads contents again.
    """

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame], dialect: Spark = SPARK):
        self.spark, self.id, self.dialect = spark, uuid.uuid4().hex[:8], dialect
        self.views: dict[str, str] = {}
        self.kept: dict[str, object] = {}  # what operators derive from this corpus once
        self._measured: dict[str, float] = {}
        for name, df in views.items():
            self._view(name, df)

    def _scan(self) -> None:
        """Stores the facts, once, when the first query asks for them: what reads other tables only never waits for it."""
        if self._measured:
            return
        began, seen = time.perf_counter(), Observation("scan")
        facts = self._planned("select * from files").drop("content")
        files = written(facts.observe(seen, F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("line_count").alias("lines"), F.count(F.when(F.col("line_count") == 0, 1)).alias("empty")), "files")
        # Counted by the pass that stores the facts.
        self._measured = {k: v or 0 for k, v in seen.get.items()} | {"scan_seconds": round(time.perf_counter() - began, 3)}
        self._view("files", files)
        self._view("paths", files.select([c for c in ("repo", "path", "bare", "hash") if c in files.columns]))

    @property
    def measured(self) -> dict[str, float]:
        """What the scan counted: files, bytes, lines, empty, scan_seconds."""
        self._scan()
        return self._measured

    @classmethod
    def from_corpus(cls, corpus: DataFrame, old: DataFrame | None = None, listing: DataFrame | None = None) -> Engine:
        """Without ``old`` all files are new; ``listing`` has all paths there are, of files that ``corpus`` leaves out too."""
        old = corpus.where("false") if old is None else old
        views = {"corpus": corpus, "old_corpus": old}
        views = {name: df.select("path", "content") for name, df in views.items()}
        return cls(corpus.sparkSession, views | {"listing": (corpus if listing is None else listing).select("path")})

    @classmethod
    def from_repositories(cls, corpus: DataFrame, old: DataFrame | None = None, listing: DataFrame | None = None) -> Engine:
        """Like ``from_corpus``, of rows that have a ``repo`` too: one plan for all of them, none sees another's files."""
        old = corpus.where("false") if old is None else old
        views = {name: df.select("repo", "path", "content") for name, df in {"corpus": corpus, "old_corpus": old}.items()}
        return cls(corpus.sparkSession, views | {"listing": (corpus if listing is None else listing).select("repo", "path")}, BY_REPO)

    _documents: dict[tuple, Engine] = {}

    @classmethod
    def from_documents(cls, spark: SparkSession, sf_dir: str, dialect: Spark = SPARK) -> Engine:
        """Over the test corpus made of ``documents``; kept for the application's next query while the tables are the same."""
        paths = {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("documents", "pages", "events", "conversations", "labels")}
        key = (spark.sparkContext.applicationId, sf_dir, type(dialect), *(changed(spark, p) for p in paths.values()))
        if key not in cls._documents:
            tables = {t: spark.read.parquet(p) for t, p in paths.items()}
            tables["documents"] = spread(tables["documents"], paths["documents"])
            cls._documents[key] = cls(spark, tables, dialect)
        return cls._documents[key]

    def _view(self, name: str, df: DataFrame) -> None:
        self.views[name] = f"loam_{name}_{self.id}"
        df.createOrReplaceTempView(self.views[name])

    def sql(self, query: str) -> DataFrame:
        names = needed(self.dialect, query, self.views)
        if "files" in names:
            self._scan()
        for name in names:
            if name in STORED and name not in self.views:
                self._view(name, written(self.sql(RELATIONS[name](self.dialect)), name))
        return self._planned(query)

    def _planned(self, query: str) -> DataFrame:
        """The query over the views that there are."""
        bodies = needed(self.dialect, query, self.views)
        # Stored relations come in by their names, as the others do; the texts themselves stay as they are.
        said = set(re.findall(r"\w+", " ".join([query, *bodies.values()])))
        chain = [f"{name} as (select * from {view})" for name, view in self.views.items() if name in said]
        chain += [f"{name} as ({body})" for name, body in bodies.items()]
        return self.spark.sql(f"with {', '.join(chain)} select * from ({query}) the_result" if chain else query)

    def relation(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")
