"""State tables: rows by key that many writers change a little at a time.

A table is a folder with ``data`` (Parquet, each commit one folder, by hash bucket of the key) and ``log`` (a small manifest for each
version). A commit writes the rows that it sets and the keys that it deletes, in their buckets only, and then claims the next version
by creating its manifest, which fails if another writer was faster; it then looks at what the other changed and goes on behind it,
or gives up with ``Conflict`` if it had read buckets that changed since. What it costs is in proportion to the change.

Readers take one manifest and see all of that version and nothing else. Of a bucket they read its base and the changes since; ``compact``
makes a new base of the buckets that changed, ``vacuum`` removes folders that no kept version needs.

A commit may carry a ``tag`` (source, number), for example a streaming query and its batch: a tag that was committed, or a later one of
its source, is not committed again, so a batch that is run again after a failure changes nothing.

Cases: equal keys within one commit are an error of the caller (the row that sorts last is kept); a key both set and deleted is set;
null keys are rows like others (one for each key); an empty commit is a version without changes; a table without commits is None.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
#: Changes of a bucket that readers put together; the commit that would make it more compacts.
MOST_CHANGES = 16
GONE = "_gone"


class Conflict(RuntimeError):
    """Another writer changed what this one had read."""


@dataclass(frozen=True)
class Manifest:
    """``schema``: (column, type); ``base``: bucket -> its folder; ``changes``: (folder, version, buckets), oldest first; ``touched``: bucket -> last version
    that changed it; ``tags``: source -> (number, version)."""

    version: int = 0
    schema: list[list[str]] = field(default_factory=list)
    base: dict[str, str] = field(default_factory=dict)
    changes: list[list] = field(default_factory=list)
    touched: dict[str, int] = field(default_factory=dict)
    tags: dict[str, list] = field(default_factory=dict)
    at: float = 0.0

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self.schema)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # Files, in whatever file system the folder is

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    @property
    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        there = self._at("log")
        names = [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        versions = self.versions()
        if not versions or version == 0:
            return None
        k = versions[-1] if version is None else version
        stream = self._fs.open(self._at("log", f"{k:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _claim(self, m: Manifest) -> bool:
        """Creates the manifest's file; False if that version is there. What is written beforehand appears under its name at once."""
        target, draft = self._at("log", f"{m.version:020d}.json"), self._at("drafts", uuid.uuid4().hex)
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        self._fs.mkdirs(self._at("log"))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), none)  # refuses to overwrite
        except Exception as e:  # a Java exception of whatever kind; only one of them means that somebody was faster
            if not self._fs.exists(target):
                raise
            self._fs.delete(draft, False)
            if "exist" not in str(e).lower():
                raise
            return False
        return True

    # Reading

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _folder(self, m: Manifest, folder: str, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema(f"{m.ddl}, {GONE} boolean, b int").option("basePath", f"{self.path}/data/{folder}").parquet(f"{self.path}/data/{folder}").where(F.col("b").isin(buckets))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version (the last one), or of some of its buckets; None before the first commit."""
        m = self.manifest(version)
        return None if m is None else self._rows(m, buckets).drop("b")

    def _rows(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        wanted = set(range(self.buckets) if buckets is None else buckets)
        by_folder: dict[str, list[int]] = {}
        for b, folder in m.base.items():
            if int(b) in wanted:
                by_folder.setdefault(folder, []).append(int(b))
        empty = self.spark.createDataFrame([], f"{m.ddl}, {GONE} boolean, b int")
        base = reduce(DataFrame.unionByName, [self._folder(m, f, bs) for f, bs in sorted(by_folder.items())], empty)
        later = [self._folder(m, f, sorted(wanted & set(bs))).withColumn("_v", F.lit(v)) for f, v, bs in m.changes if wanted & set(bs)]
        if not later:
            return base.drop(GONE)
        changes = reduce(DataFrame.unionByName, later)
        payload = [c for c in changes.columns if c not in (*self.key, "_v")]
        last = changes.groupBy(*self.key).agg(F.max_by(F.struct(*payload), "_v").alias("row")).select(*self.key, "row.*")
        # A change's keys are few beside the base's rows; Spark broadcasts them if they are small, as it measures.
        keys = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])
        kept = base.join(keys, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)]), "left_anti")
        return kept.unionByName(last).where(~F.col(GONE)).drop(GONE)

    def of_keys(self, keys: DataFrame, version: int | None = None) -> DataFrame | None:
        """The rows of some keys; only their buckets are read."""
        m = self.manifest(version)
        if m is None:
            return None
        keys = keys.select(*self.key).distinct()
        held = [r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        return self._rows(m, held).drop("b").join(keys, self.key, "left_semi")

    # Writing

    def commit(self, rows: DataFrame | None = None, deleted: DataFrame | None = None, tag: tuple[str, int] | None = None, base: int | None = None, everything: bool = False) -> int:
        """Sets ``rows``, deletes the keys of ``deleted``, and returns the version in which that holds.

        ``base`` is the version that the caller derived its rows from: Conflict if one of their buckets changed since. With
        ``everything`` the rows are the whole table, and whatever else there was is gone.
        """
        m = self.manifest() or Manifest()
        done = tag and m.tags.get(tag[0])
        if done and done[0] >= tag[1]:
            return done[1]
        if rows is None:
            if m.version == 0:
                raise ValueError("the first commit of a table needs rows")
            rows = self.spark.createDataFrame([], m.ddl)
        schema = [[f.name, f.dataType.simpleString()] for f in rows.schema.fields]
        change = rows.withColumn(GONE, F.lit(False))
        if deleted is not None and not everything:
            gone = deleted.select(*self.key).distinct().join(rows.select(*self.key), self.key, "left_anti")
            change = change.unionByName(gone.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        folder = uuid.uuid4().hex
        written = self._write(change, folder)
        while True:
            m = self.manifest() or Manifest()
            done = tag and m.tags.get(tag[0])
            if done and done[0] >= tag[1]:
                return done[1]
            changed = list(range(self.buckets)) if everything else written
            if base is not None and any(m.touched.get(str(b), 0) > base for b in changed):
                raise Conflict(f"version {m.version} changed what version {base} held")
            v = m.version + 1
            touched = m.touched | {str(b): v for b in changed}
            tags = m.tags | ({tag[0]: [tag[1], v]} if tag else {})
            if everything:
                new = Manifest(v, schema, {str(b): folder for b in written}, [], touched, tags, time.time())
            else:
                wider = m.schema + [c for c in schema if c[0] not in {n for n, _ in m.schema}]  # columns are added, never lost
                new = replace(m, version=v, schema=wider, changes=[*m.changes, [folder, v, written]] if written else m.changes, touched=touched, tags=tags, at=time.time())
            if self._claim(new):
                break
        if len(new.changes) > MOST_CHANGES:
            self.compact()
        return v

    def _write(self, change: DataFrame, folder: str) -> list[int]:
        """Writes rows by bucket; the buckets that there are."""
        at = f"{self.path}/data/{folder}"
        change.withColumn("b", self._bucket()).repartition("b").write.partitionBy("b").parquet(at)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("data", folder))]
        return sorted(int(n[2:]) for n in names if n.startswith("b="))

    def compact(self) -> int:
        """A new base of the buckets that changed since theirs; a commit between gets its own change after it."""
        while True:
            m = self.manifest()
            if m is None or not m.changes:
                return m.version if m else 0
            changed = sorted({b for _, _, bs in m.changes for b in bs})
            folder = uuid.uuid4().hex
            rows = self._rows(m, changed).drop("b").withColumn(GONE, F.lit(False))
            written = self._write(rows, folder)
            base = {b: f for b, f in m.base.items() if int(b) not in changed} | {str(b): folder for b in written}
            if self._claim(replace(m, version=m.version + 1, base=base, changes=[], at=time.time())):
                return m.version + 1

    def vacuum(self, keep: int = 10, older_than: float = 3600.0) -> list[str]:
        """Removes data that none of the newest ``keep`` versions needs and that was written ``older_than`` seconds ago, and older manifests.

        The age protects commits that have written their rows but not yet claimed a version.
        """
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        needed = {f for m in kept for f in m.base.values()} | {c[0] for m in kept for c in m.changes}
        gone = []
        for s in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            if s.getPath().getName() not in needed and time.time() - s.getModificationTime() / 1000 > older_than:
                self._fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        for v in versions[:-keep]:
            self._fs.delete(self._at("log", f"{v:020d}.json"), False)
        return gone

    def folders(self) -> list[str]:
        there = self._at("data")
        return [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []

    def bytes_of(self, folder: str) -> int:
        return self._fs.getContentSummary(self._at("data", folder)).getLength()

    def reset(self) -> None:
        self._fs.delete(self._at(), True)
