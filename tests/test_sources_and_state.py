"""File trees, coverage reports, graphs, snapshots and streams."""

import os

from pyspark.sql.functions import col as F_col

from loam.operators import pygraph, state
from loam.sources import files as F
from loam.streaming.watch import watch


def test_tree(spark, tmp_path):
    for p, b in {"a.py": b"x = 1\n", "sub/b.md": b"# T\xff\n", "node_modules/c.py": b"no", "big.py": b"x" * 2000, "Makefile": b"all:", "d.bin": b"\0"}.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {r.path: r for r in F.read_tree(spark, str(tmp_path), [".py", ".md", "Makefile"], most_bytes=1000).collect()}
    assert set(got) == {"a.py", "sub/b.md", "Makefile"}
    assert got["sub/b.md"].content == "# T\n" and got["a.py"].size == 6
    some = spark.createDataFrame([("a/b/c",), ("ab/c",), ("a/x",)], "path string")
    assert {r.path for r in F.without_ignored(some, spark.createDataFrame([("a/b",)], "path string")).collect()} == {"ab/c", "a/x"}


def test_coverage_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<coverage><class filename="a.py" line-rate="0.625"/><class filename="b.py" line-rate="0.9"/></coverage>')
    report = F.coverage_report(spark, str(tmp_path / "c.xml"))
    assert {(r.filename, r.percent) for r in report.collect()} == {("a.py", 62.5), ("b.py", 90.0)}
    risks = spark.createDataFrame([("a.py", 50), ("b.py", 90), ("c.py", 10)], "file string, score int")
    assert [r.file for r in F.coverage_gaps(risks, report).collect()] == ["a.py", "c.py"]


def test_graph(spark):
    text = "import os\nfrom . import x\n\nclass A:\n    '''Doc.'''\n    def f(self):\n        g(1).h()\n        os.path.join('a')\n\nprint(1)\n"
    rows = pygraph.python_graph(spark.createDataFrame([("p/a.py", text), ("bad.py", "def ("), ("n.py", None)], "path string, content string")).collect()
    kinds = {(r.kind, r.qualname, r.name) for r in rows if r.path == "p/a.py"}
    assert {("class", "A", "A"), ("function", "A.f", "f"), ("import", "", "os"), ("import", "", "."), ("call", "A.f", "os.path.join"), ("call", "A.f", "g.h")} <= kinds
    assert not any(k == "call" and n == "print" for k, _, n in kinds)
    assert [r.kind for r in rows if r.path == "bad.py"] == ["error"]


def test_runtime_paths(spark):
    edges = spark.createDataFrame([("main", "a", 1), ("a", "b", 1), ("b", "main", 1), ("main", "c", 2)], "src string, dst string, ord int")
    got = pygraph.runtime_paths(edges, spark.createDataFrame([("main",)], "module string")).collect()
    assert sorted(r.steps for r in got) == ["main -> a -> b", "main -> c"]


def test_snapshots(spark, tmp_path):
    path, make = str(tmp_path / "s"), lambda rows: spark.createDataFrame(rows, "path string, hash string")
    assert state.last_snapshot(spark, path) is None
    state.append_snapshot(make([("a", "1"), ("b", "1"), ("c", "1")]), path, 0)
    diff = state.snapshot_diff(make([("a", "1"), ("b", "2"), ("d", "1")]), state.last_snapshot(spark, path))
    assert {(r.path, r.status) for r in diff.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "new")}
    kept = state.merged(make([("a", "1"), ("b", "1")]), make([("b", "2")]), spark.createDataFrame([("a",)], "path string"))
    assert [(r.path, r.hash) for r in kept.collect()] == [("b", "2")]


def test_watch(spark, tmp_path):
    seen = []
    schema = "path string, content string, deleted boolean"
    for k, rows in enumerate([[("a", "1", False), ("b", "1", False)], [("a", "2", False), ("b", None, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp"), lambda d, i: seen.append(sorted((r.path, r.status) for r in d.collect())))
        q.awaitTermination()
    assert seen == [[("a", "new"), ("b", "new")], [("a", "modified"), ("b", "deleted")]]


def test_savings(spark):
    r = state.savings_summary(spark.createDataFrame([(100, 25), (0, 0)], "full_tokens int, emitted_tokens int")).first()
    assert (r.saved, r.percent) == (75, 75.0)


def test_helpers():
    assert F.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert F.repository_name("https://example.org/x/My Repo!.git") == "My-Repo"


def test_config(spark, tmp_path, monkeypatch):
    from loam.sources import config as C

    assert C.validate(C.DEFAULTS) == [] and C.load() == C.DEFAULTS
    bad = C.DEFAULTS | {"scan_interval_seconds": 0, "max_file_size_bytes": True, "auto_suggest": "yes", "ignore_dirs": ["a", ""], "log_file": 3, "performance_budgets": {"files": "x"}}
    del bad["reports_path"]
    assert C.validate(bad) == [
        "Config key scan_interval_seconds must be >= 1", "Config key ignore_dirs must contain only non-empty strings", "Config key max_file_size_bytes must be an integer",
        "Config key auto_suggest must be true or false", "Missing config key: reports_path", "Config key log_file must be str", "Performance budget files must be numeric",
    ]
    at = str(tmp_path / "c.json")
    C.write_json(at, {"scan_interval_seconds": 7, "performance_budgets": {"files": 9}})
    monkeypatch.setenv("LOAM_CONFIG", at)
    assert C.load()["scan_interval_seconds"] == 7 and C.load()["performance_budgets"] == {"scan_seconds": 5.0, "files": 9, "context_tokens": 4000}
    (tmp_path / "bad.json").write_text("{")
    assert C.read_json(str(tmp_path / "bad.json"), [1]) == [1] and C.read_json(str(tmp_path / "none.json"), {}) == {}
    rows = {r.name: r.ok for r in C.doctor(spark, C.DEFAULTS, str(tmp_path), 1).collect()}
    assert rows["config"] and rows["project_dir"] and not rows["reports_path"] and not rows["focus_files"]
    assert [p.rsplit("/", 1)[-1] for p in C.own_paths(C.DEFAULTS, str(tmp_path), ["more"])] == ["knowledge", "checkpoints", "reports", "log", "more"]
    assert (C.budget_name(" Large "), C.budget_name("huge"), C.budget_name(None, "tiny")) == ("large", "small", "tiny")
    assert C.as_bool(" On ") and not C.as_bool("x") and C.as_bool(None, True) and C.as_int("x", 3) == 3 and C.as_list("a, b\n,c") == ["a", "b", "c"]
    (tmp_path / "f").write_bytes(b"abc")
    assert C.file_hash(str(tmp_path / "f")).startswith("ba7816bf") and C.file_hash(str(tmp_path)) == "unreadable"
    xml = spark.createDataFrame([('<?xml version="1.0"?><!DOCTYPE a [<!ENTITY x "y">]><a>1</a>',)], "x string").select(C.without_doctype(F_col("x")).alias("y")).first().y
    assert xml == '<?xml version="1.0"?><a>1</a>' and C.git_context(str(tmp_path)) == {"enabled": False}
    assert C.git_source("https://example.org/x.git") == "https://example.org/x.git" and C.git_source(str(tmp_path)) == str(tmp_path.resolve())
    assert C.now()[:2] == "20"


def test_scan_cache(spark, tmp_path):
    from loam.sources.scancache import incremental_scan as cached_scan

    counted = lambda c: {k: c[k] for k in ("hits", "misses", "writes")}

    seen = []

    def extract(rows):
        seen.append(sorted(r.path for r in rows.collect()))
        return rows.withColumn("lines", rows.size * 2)

    listing = lambda *r: spark.createDataFrame(list(r), "path string, size long, modified long")
    at = str(tmp_path / "cache")
    assert counted(cached_scan(listing(("a", 1, 1), ("b", 2, 1)), at, "full", extract)[1]) == {"hits": 0, "misses": 2, "writes": 2}
    facts, counts = cached_scan(listing(("a", 1, 1), ("b", 2, 5), ("c", 3, 1)), at, "full", extract)
    # What was analysed is written, not what the cache held already.
    assert counted(counts) == {"hits": 1, "misses": 2, "writes": 2} and seen[1] == ["b", "c"] and {(r.path, r.lines) for r in facts.collect()} == {("a", 2), ("b", 4), ("c", 6)}
    assert cached_scan(listing(("c", 3, 1), ("d", 1, 1)), at, "fast4", extract)[1]["hits"] == 1
    assert cached_scan(listing(("d", 1, 1)), at, "full", extract)[1]["hits"] == 0
    assert cached_scan(listing(("d", 1, 1)), at, "fast4", extract)[1]["hits"] == 1


def test_tables(spark, tmp_path):
    t = state.Tables(spark, str(tmp_path / "kb"))
    assert t.read("issues") is None and t.last("scans") is None
    t.replace_issues(spark.createDataFrame([("todo", "low", "x", "a.py", "m")], "type string, severity string, category string, file string, message string"))
    t.add_issue("2024", "by hand")
    assert {(r.type, r.message) for r in t.read("issues").collect()} == {("todo", "m"), ("manual", "by hand")} and "category" not in t.read("issues").columns
    t.add_decision("1", "use it", "fast")
    t.add_decision("2", "drop it")
    assert [r.decision for r in t.last("decisions", 1).collect()] == ["drop it"] and [r.decision for r in t.last("decisions").collect()] == ["use it", "drop it"]
    for k in range(3):
        t.record_savings(str(k), "context", 100, 40)
    assert t.read("savings_totals").first().full_tokens == 300 and t.append("savings", t.read("savings").limit(0), 2).count() == 2
    t.record_task("1", "fix", ["a.py"], [], ["r"], [])
    t.update_suggestions(spark.createDataFrame([(1, "T", None)], "rank long, title string, priority string"))
    assert t.read("suggestions").first().asDict()["priority"] == "low" and t.read("tasks").first().changed_files == ["a.py"]
    t.reset()
    assert t.read("tasks") is None


def test_scan_once(spark, tmp_path):
    from loam.plans.engine import Engine

    t = state.Tables(spark, str(tmp_path / "kb"))
    engine = lambda **files: Engine.from_corpus(spark.createDataFrame([(p.replace("_", "/", 1) + ".py", c) for p, c in files.items()], "path string, content string"))
    state.scan_once(engine(src_a="x = 1\n", src_b="y = 1\n"), t, "1")
    out = state.scan_once(engine(src_a="x = 2\n", src_c="z = 1\n"), t, "2")
    assert {(r.path, r.status) for r in out["diff"].collect()} == {("src/a.py", "modified"), ("src/b.py", "deleted"), ("src/c.py", "new")}
    assert {r.path for r in t.read("files").collect()} == {"src/a.py", "src/c.py"}
    assert [(r.ts, r.new_count, r.modified_count, r.deleted_count) for r in t.last("scans").collect()] == [("1", 2, 0, 0), ("2", 1, 1, 1)]
    focus = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("",)], "path string")
    assert [r.path for r in state.stale_focus(focus, t.read("files")).collect()] == ["src/b.py"]


def test_resolved_calls(spark):
    """As Python binds names: relative and renamed imports, self, shadowing, dotted modules, methods of other modules."""
    files = {
        "pkg/__init__.py": "def boot():\n    pass\n",
        "pkg/a.py": "from . import boot as start\nfrom .b import tool, Deep\nimport pkg.b\nimport os.path as p\n\ndef go():\n    start()\n    tool()\n    pkg.b.tool()\n    p.join('x')\n    Deep.make()\n    late()\n\ndef late():\n    print(1)\n",
        "pkg/b.py": "from pkg.a import go as tool2\n\ndef tool():\n    tool2()\n\nclass Deep:\n    def make(self):\n        self.rest()\n        tool()\n    def rest(self):\n        return self.make().x()\n",
        "top.py": "import pkg\nfrom pkg.a import go\n\ndef go2():\n    go()\n    pkg.boot()\n",
    }
    graph = pygraph.python_graph(spark.createDataFrame(list(files.items()), "path string, content string"))
    got = {(r.owner, r.name): (r.target, r.resolved) for r in pygraph.resolved_calls(graph).collect()}
    assert got == {
        ("pkg.a.go", "start"): ("pkg.boot", True), ("pkg.a.go", "tool"): ("pkg.b.tool", True), ("pkg.a.go", "pkg.b.tool"): ("pkg.b.tool", True),
        ("pkg.a.go", "p.join"): ("os.path.join", False), ("pkg.a.go", "Deep.make"): ("pkg.b.Deep.make", True), ("pkg.a.go", "late"): ("pkg.a.late", True), ("pkg.a.late", "print"): ("print", False),
        ("pkg.b.tool", "tool2"): ("pkg.a.go", True), ("pkg.b.Deep.make", "self.rest"): ("pkg.b.Deep.rest", True), ("pkg.b.Deep.make", "tool"): ("pkg.b.tool", True),
        ("pkg.b.Deep.rest", "self.make"): ("pkg.b.Deep.make", True), ("pkg.b.Deep.rest", "self.make.x"): ("self.make.x", False),
        ("top.go2", "go"): ("pkg.a.go", True), ("top.go2", "pkg.boot"): ("pkg.boot", True),
    }
    totals = pygraph.graph_totals(graph, pygraph.resolved_calls(graph)).first()
    assert (totals.modules, totals.call_sites, totals.resolved_calls, totals.parse_errors) == (4, 14, 11, 0)
