"""Keyed state tables, incremental scans and replayed batches."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loam.operators.state import Tables
from loam.sources import keyed, scancache
from loam.sources.keyed import Conflict, KeyedTable
from loam.streaming.watch import apply_batch, watch


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, "k string, v int")


def test_random_commits_equal_a_dict(spark, tmp_path, make, monkeypatch):
    """Any order of upserts, deletions, replacements and compactions, read at every version."""
    monkeypatch.setattr(keyed, "MOST_CHANGES", 4)
    rng, table, state, seen = random.Random(3), KeyedTable(spark, str(tmp_path / "t"), ["k"], 4), {}, {}
    keys = ["a", "b", "c", "d", None, "é", ""]
    for _ in range(9):
        new = {rng.choice(keys): rng.randrange(9) for _ in range(rng.randrange(1, 4))}
        gone = [k for k in keys if rng.random() < 0.3 and k is not None]
        whole = rng.random() < 0.15
        v = table.commit(make(list(new.items())), make([(k, 0) for k in gone]), everything=whole)
        state = ({} if whole else {k: x for k, x in state.items() if k not in gone}) | new
        seen[v] = dict(state)
    assert all(rows_of(table.read(v)) == sorted(s.items(), key=repr) for v, s in seen.items())
    last = table.compact()
    assert rows_of(table.read()) == sorted(state.items(), key=repr) and not table.manifest().changes and table.manifest().version == last
    table.vacuum(keep=1, older_than=0)
    assert table.versions() == [last] and rows_of(table.read()) == sorted(state.items(), key=repr)
    assert rows_of(table.of_keys(make([("a", 0), ("nobody", 0)]))) == [x for x in sorted(state.items(), key=repr) if x[0] == "a"]


def test_conflicts_and_tags(spark, tmp_path, make):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 64)
    assert table.read() is None and table.manifest() is None
    with pytest.raises(ValueError):
        table.commit(None, make([("a", 0)]))
    base = table.commit(make([("a", 1), ("b", 1)]), tag=("q", 0))
    other = table.commit(make([("a", 2)]))
    with pytest.raises(Conflict):
        table.commit(make([("a", 3)]), base=base)
    assert table.commit(make([("b", 3)]), base=base) == other + 1  # another bucket
    assert table.commit(make([("a", 9)]), tag=("q", 0)) == base and table.commit(None, make([("b", 0)]), tag=("q", 1)) == other + 2
    assert rows_of(table.read()) == [("a", 2)]
    wider = table.commit(spark.createDataFrame([("c", 1, "x")], "k string, v int, note string"))
    assert rows_of(table.read(wider)) == [("a", 2, None), ("c", 1, "x")]


def test_writers_at_once(spark, tmp_path, make):
    """Eight writers append and eight add to a counter; nothing is lost."""
    table, tables = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4), Tables(spark, str(tmp_path / "kb"))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda i: table.commit(make([(f"k{i}", i)])), range(8)))
        list(pool.map(lambda i: tables.changed("sums", lambda old: make([("n", 1)]) if old is None else old.withColumn("v", F.col("v") + 1)), range(5)))
    assert sorted(versions) == list(range(1, 9)) and rows_of(table.read()) == [(f"k{i}", i) for i in range(8)]
    assert rows_of(tables.read("sums")) == [("n", 5)]


def test_a_commit_costs_what_it_changes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 32)
    table.commit(spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")))
    (first,) = table.folders()
    table.commit(spark.createDataFrame([("7", 0)], "k string, v long"))
    (second,) = set(table.folders()) - {first}
    assert table.bytes_of(second) * 50 < table.bytes_of(first) and len([n for n in os.listdir(tmp_path / "t/data" / second) if n.startswith("b=")]) == 1
    plan = table.of_keys(spark.createDataFrame([("7",)], "k string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and table.of_keys(spark.createDataFrame([("7",)], "k string")).first().v == 0


def test_scan_writes_in_proportion(spark, tmp_path):
    listing = lambda n, changed: spark.range(n).select(F.concat(F.lit("f"), "id").alias("path"), F.col("id").alias("size"), F.when(F.col("id") < changed, 2).otherwise(1).alias("modified"))
    extract = lambda rows: rows.withColumn("lines", F.col("size") * 2)
    cache = str(tmp_path / "c")
    whole = scancache.incremental_scan(listing(5000, 0), cache, "full", extract)[1]
    none = scancache.incremental_scan(listing(5000, 0), cache, "full", extract)[1]
    some_facts, some = scancache.incremental_scan(listing(4990, 3), cache, "fast9", extract)
    assert (whole["hits"], whole["misses"], none["hits"], none["bytes"]) == (0, 5000, 5000, 0)
    assert (some["hits"], some["misses"], some["writes"], some["deleted"]) == (4987, 3, 3, 10) and 0 < some["bytes"] < whole["bytes"] / 3 and some_facts.count() == 4990
    assert scancache.incremental_scan(listing(4990, 3), cache, "full", extract)[1]["misses"] == 3  # a fast scan's facts serve no full one


def test_tree_scan_opens_misses_only(spark, tmp_path):
    tree = tmp_path / "tree"
    for p, t in {"b.py": "x\n", "a/c [1].py": "y\ny\n", "a/d.md": "z", "node_modules/e.py": "no"}.items():
        os.makedirs((tree / p).parent, exist_ok=True)
        (tree / p).write_text(t)
    opened = []

    def extract(rows):
        opened.append(sorted(r.path for r in rows.collect()))
        return rows.select("path", "size", "modified", F.length("content").alias("chars"))

    scan = lambda: scancache.scan_tree(spark, str(tree), str(tmp_path / "cache"), extract, extensions=[".py", ".md"])
    facts, counts = scan()
    assert [(r.path, r.chars) for r in facts.collect()] == [("a/c [1].py", 4), ("a/d.md", 1), ("b.py", 2)] and counts["misses"] == 3
    (tree / "b.py").write_text("longer\n")
    os.remove(tree / "a/d.md")
    facts, counts = scan()
    assert [(r.path, r.chars) for r in facts.collect()] == [("a/c [1].py", 4), ("b.py", 7)] and opened[1] == ["b.py"]
    assert (counts["hits"], counts["misses"], counts["deleted"]) == (1, 1, 1)


def test_replayed_batches(spark, tmp_path):
    """A batch that runs again says the same and changes nothing; the state equals a full rescan."""
    table = KeyedTable(spark, str(tmp_path / "s"), ["path"])
    rows = lambda *r: spark.createDataFrame([(*x, 1, "f") for x in r], "path string, content string, deleted boolean, at long, file string")
    said = lambda k, *r: sorted((x.path, x.status) for x in apply_batch(table, rows(*r), "q", k).collect())
    one = (("a", "1", False), ("b", "1", None), ("c", None, True))
    two = (("a", "2", False), ("b", "1", False), ("d", "1", False), ("b", None, True))
    assert said(0, *one) == [("a", "new"), ("b", "new")] == said(0, *one)
    assert said(1, *two) == [("a", "modified"), ("b", "deleted"), ("d", "new")] == said(1, *two)
    assert sorted(r.path for r in table.read().collect()) == ["a", "d"] and len(table.versions()) == 2


def test_watch_keeps_state_small(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"p{k}", "x", False)], "path string, content string, deleted boolean").write.mode("append").parquet(str(tmp_path / "in"))
        watch(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "cp"), lambda d, i: d.collect()).awaitTermination()
    sizes = [len([n for n in os.listdir(tmp_path / "s/data" / f) if n.startswith("b=")]) for f in os.listdir(tmp_path / "s/data")]
    assert sizes == [1, 1, 1]
