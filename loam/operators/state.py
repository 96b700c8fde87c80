"""Snapshots, merges and event logs as Parquet tables: append, replace, retention."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.sources import config
from loam.sources.keyed import Conflict, KeyedTable
from loam.sources.store import written


def append_snapshot(files: DataFrame, path: str, checkpoint_id: int) -> None:
    """Adds the snapshot's (path, hash) under its id; written again, it replaces itself."""
    files.select("path", "hash").write.mode("overwrite").parquet(f"{path.rstrip('/')}/checkpoint_id={checkpoint_id}")


def last_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """path, hash of the newest snapshot (with an id below ``before``), None before the first; only that partition is read."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("path string, hash string, checkpoint_id long").parquet(path)
    except AnalysisException:
        return None
    rows = rows if before is None else rows.where(F.col("checkpoint_id") < before)
    newest = rows.agg(F.max("checkpoint_id")).first()[0]
    return None if newest is None else rows.where(F.col("checkpoint_id") == newest).select("path", "hash")


def snapshot_diff(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """path, status: new, modified, deleted (one full outer join); on a first scan everything is new."""
    if previous is None:
        return current.select("path", F.lit("new").alias("status"))
    c, p = current.select("path", F.col("hash").alias("now")), previous.select("path", F.col("hash").alias("before"))
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("before"), "modified")
    return c.join(p, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def merged(table: DataFrame, updates: DataFrame, deleted: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``updates`` replace those of their key; keys of ``deleted`` go; nothing else does."""
    kept = table.join(updates.select(key), key, "left_anti").join(deleted.select(key), key, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def retained(events: DataFrame, order: list, keep: int, by: list[str] | None = None) -> DataFrame:
    """The newest ``keep`` rows (of each group)."""
    if not by:
        return events.orderBy(*[F.desc(c) for c in order]).limit(keep)
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= keep).drop("__k")


def appended_if_absent(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.join(table, rows.columns, "left_anti").dropDuplicates())


def ordered_union(sources: list[DataFrame], key: str, keep: int) -> DataFrame:
    """Distinct keys in the order of their first source, at most ``keep``."""
    every = reduce(DataFrame.unionByName, [s.select(key, F.lit(i).alias("source")) for i, s in enumerate(sources)])
    return every.groupBy(key).agg(F.min("source").alias("source")).orderBy("source", key).limit(keep)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their numbers from 1 in the order of columns that tell them apart.

    Rows are dealt out by ranges and numbered range by range; of each range one count is summed up, so no task orders all rows.
    """
    part = "_part"
    dealt = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))  # a row for each range
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return local.join(F.broadcast(before), part).select(*rows.columns, (F.col(name) + F.col("_before")).alias(name))


def savings_summary(events: DataFrame) -> DataFrame:
    """full_tokens, emitted_tokens, saved, percent over all events."""
    sums = events.agg(F.coalesce(F.sum("full_tokens"), F.lit(0)).alias("full_tokens"), F.coalesce(F.sum("emitted_tokens"), F.lit(0)).alias("emitted_tokens"))
    saved = F.greatest(F.lit(0), F.col("full_tokens") - F.col("emitted_tokens"))
    percent = F.when(F.col("full_tokens") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.bround(100 * (1 - F.col("emitted_tokens") / F.nullif("full_tokens", F.lit(0))))))
    return sums.select("*", saved.alias("saved"), percent.alias("percent"))


class Tables:
    """Named state tables below a folder, each a ``KeyedTable``: a write costs what it changes, and writers do not lose each other's.

    Rows have an id that ``read`` leaves out: of files their path, of events one of their own.
    """

    ID, BUCKETS, TRIES = "_id", 4, 20

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", [self.ID], self.BUCKETS)

    def _named(self, rows: DataFrame) -> DataFrame:
        """With ids of their own, fixed here: stored, since they are drawn."""
        return written(rows.withColumn(self.ID, F.concat(F.lit(f"{time.time_ns():020d} "), F.uuid())), "rows")

    def read(self, name: str) -> DataFrame | None:
        rows = self.table(name).read()
        return None if rows is None else rows.drop(self.ID)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows are the whole table from now on."""
        self.table(name).commit(self._named(rows), everything=True)
        return self.read(name)

    def append(self, name: str, rows: DataFrame, keep: int | None = None, order: str = "ts") -> DataFrame:
        """Adds rows; with ``keep`` only the newest stay (of equal ones those added last)."""
        table, rows = self.table(name), self._named(rows)
        old = table.read() if keep is not None else None
        if old is None:
            table.commit(rows if keep is None else rows.orderBy(F.desc(order), F.desc(self.ID)).limit(keep))
            return self.read(name)
        kept = old.select(order, self.ID).unionByName(rows.select(order, self.ID)).orderBy(F.desc(order), F.desc(self.ID)).limit(keep).select(self.ID)
        table.commit(rows.join(kept, self.ID, "left_semi"), old.select(self.ID).join(kept, self.ID, "left_anti"))
        return self.read(name)

    def changed(self, name: str, change: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
        """Replaces a small table by what ``change`` makes of it; if another writer was faster, of what that one made of it."""
        table = self.table(name)
        for _ in range(self.TRIES):
            m = table.manifest()
            old = None if m is None else table.read(m.version).drop(self.ID)
            try:
                table.commit(self._named(change(old)), base=m.version if m else 0, everything=True)
                return self.read(name)
            except Conflict:
                continue
        raise Conflict(f"{name} changes faster than it can be written")

    def reset(self) -> None:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)

    # What a scan leaves behind

    def sync_files(self, current: DataFrame, deleted: DataFrame) -> DataFrame:
        """The files of a scan replace their rows, those that say something new; only deleted paths go."""
        table, rows = self.table("files"), current.withColumn(self.ID, F.col("path"))
        old = table.read()
        if old is not None:
            rows = rows.join(old.select(self.ID, F.col("hash").alias("was")), self.ID, "left").where("was is null or was <> hash").drop("was")
        table.commit(rows, deleted.select(F.col("path").alias(self.ID)))
        return self.read("files")

    def replace_issues(self, issues: DataFrame) -> DataFrame:
        return self.write("issues", issues.drop("category"))

    def add_issue(self, ts: str, message: str, severity: str = "medium", file: str | None = None, type_: str = "manual") -> DataFrame:
        return self.append("issues", self.spark.createDataFrame([(type_, severity, file, message, ts)], "type string, severity string, file string, message string, ts string"))

    def add_decision(self, ts: str, decision: str, reason: str = "") -> DataFrame:
        return self.append("decisions", self.spark.createDataFrame([(ts, decision, reason)], "ts string, decision string, reason string"))

    def record_scan(self, ts: str, event: DataFrame) -> DataFrame:
        """A scan's one row; the newest hundred stay."""
        return self.append("scans", event.withColumn("ts", F.lit(ts)), 100)

    def record_task(self, ts: str, goal: str, changed: list[str], tests: list[str], risks: list[str], decisions: list[str], verified: str = "") -> DataFrame:
        schema = "ts string, goal string, changed_files array<string>, tests array<string>, risks array<string>, decisions array<string>, verifier_summary string"
        return self.append("tasks", self.spark.createDataFrame([(ts, goal, changed, tests, risks, decisions, verified)], schema), 100)

    def record_savings(self, ts: str, command: str, full: int, emitted: int) -> DataFrame:
        """The newest fifty events stay; totals are a table of their own, which retention does not change."""
        full, emitted = max(0, full), max(0, emitted)
        row = self.spark.createDataFrame([(ts, command, full, emitted)], "ts string, command string, full_tokens long, emitted_tokens long")
        own, sums = row.select("full_tokens", "emitted_tokens"), [F.sum(c).alias(c) for c in ("full_tokens", "emitted_tokens")]
        self.changed("savings_totals", lambda totals: (own if totals is None else totals.unionByName(own)).agg(*sums))
        return self.append("savings", row, 50)

    def record_once(self, events: DataFrame) -> DataFrame:
        """Emitted answers (ts, command, scan, full_tokens, emitted_tokens), each once however often it is recorded: its command and scan say which it is.

        Returns the totals of all events. The newest fifty are listed by ``last("savings_events", 50)``.
        """
        named = events.withColumn(self.ID, F.sha2(F.concat_ws("\x00", "command", "scan"), 256)).dropDuplicates([self.ID])
        counts = [F.greatest(F.col(c), F.lit(0)).alias(c) for c in ("full_tokens", "emitted_tokens")]
        self.table("savings_events").commit(named.select("ts", "command", "scan", *counts, self.ID))
        return savings_summary(self.read("savings_events"))

    def update_suggestions(self, suggestions: DataFrame) -> DataFrame:
        """The columns that are kept, with defaults for those that are missing."""
        defaults = {"title": "", "priority": "low", "category": "general", "reason": "", "action": "", "prompt": "", "impact": "medium", "effort": "medium", "label": "", "confidence": "", "evidence": ""}
        return self.write("suggestions", suggestions.select("rank", *[(F.coalesce(F.col(c), F.lit(v)) if c in suggestions.columns else F.lit(v)).alias(c) for c, v in defaults.items()]))

    def last(self, name: str, limit: int = 20) -> DataFrame | None:
        """The newest rows, oldest first: the timeline of scans and tasks, the ledger of decisions."""
        rows = self.read(name)
        return None if rows is None else rows.orderBy(F.desc("ts")).limit(max(1, limit)).orderBy("ts")


def budget_alerts(engine, budgets: Mapping[str, object]) -> DataFrame:
    """name, actual, budget, message: what a scan took more of than its budget: seconds, files, tokens of the compact context.

    Seconds and files were measured by the scan itself; budgets that are missing or no numbers are not looked at.
    """
    tokens = engine.relation("llm_readiness").first().compact_tokens if budgets.get("context_tokens") is not None else 0
    actual = {"scan_seconds": float(engine.measured["scan_seconds"]), "files": int(engine.measured["files"]), "context_tokens": int(tokens)}
    rows = []
    for name, value in actual.items():
        try:
            budget = float(budgets.get(name))  # type: ignore[arg-type]
        except (TypeError, ValueError):
            continue
        if value > budget:
            rows.append((name, float(value), budget, f"{name} {value} exceeds budget {budgets[name]}"))
    return engine.spark.createDataFrame(rows, "name string, actual double, budget double, message string")


def release_checks(engine, settings: Mapping[str, object], root: str, usage: str) -> DataFrame:
    """ord, name, ok, message of the seven checks: five that files decide, the command line's own help text, and the doctor's."""
    from .catalog import QUERIES

    doctor = config.doctor(engine.spark, settings, root).agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"))
    help_ = engine.spark.createDataFrame([(6, "CLI help", "usage: loam" in usage, "help renders" if usage else "no help")], "ord int, name string, ok boolean, message string")
    state = doctor.select(F.lit(7).alias("ord"), F.lit("doctor").alias("name"), "ok", F.when(F.col("ok"), "doctor ready").otherwise("doctor found issues").alias("message"))
    return engine.sql(QUERIES["a25_release_checks"](engine.dialect)).unionByName(help_).unionByName(state)


def stale_focus(focus: DataFrame, files: DataFrame) -> DataFrame:
    """path: focus files that no longer exist; while there is one, an exported context is stale."""
    return focus.select("path").where("path <> ''").distinct().join(files.select("path"), "path", "left_anti")


def scan_once(engine, tables: Tables, ts: str) -> dict[str, DataFrame]:
    """Audits, compares with the files of the last scan, suggests, and records all of it."""
    files = engine.relation("files")
    before = tables.read("files")
    diff = snapshot_diff(files.select("path", "hash"), None if before is None else before.select("path", "hash"))
    out = {"health": engine.relation("health"), "issues": engine.relation("all_issues"), "suggestions": engine.relation("suggestions"), "diff": diff}
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"{s}_count")
    event = diff.agg(count("new"), count("modified"), count("deleted")).crossJoin(out["health"].select(F.col("score").alias("health_score")))
    event = event.crossJoin(files.agg(F.count("*").alias("files_scanned"))).crossJoin(out["suggestions"].agg(F.min(F.when(F.col("rank") == 1, F.col("title"))).alias("top_suggestion")))
    tables.record_scan(ts, event)
    tables.replace_issues(out["issues"])
    tables.update_suggestions(out["suggestions"])
    tables.sync_files(files.drop("content"), diff.where("status = 'deleted'").select("path"))
    return out
