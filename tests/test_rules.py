"""Rules on hand-made files: classification order, markers, pairings, health, and edge cases of the corpus."""

import pytest

from loam.operators.catalog import QUERIES
from loam.plans.dialect import SPARK
from loam.plans.engine import Engine

ROLES = {
    "build.rs": "build_tooling", "a/package-lock.json": "dependency_lock", "requirements-dev.txt": "dependency_lock", "vendor/x/a.py": "vendor",
    "i18n/de.json": "localization", "src/generated/a.ts": "generated_sdk", "api/x_pb2.py": "generated_sdk", "inspect.md": "specification",
    "tests/notes.md": "documentation", "tests/fixtures/a.py": "fixture", "tests/x.py": "test_runner", "tests/test_x.py": "test", "tests/data.json": "fixture",
    "tools/test_runner.py": "test_runner", "a/b_test.go": "test", "x/.devcontainer/a.json": "environment_setup", "scripts/a.py": "build_tooling",
    "run.sh": "build_tooling", "gen_tables.py": "generator", "src/ci/a.py": "build_tooling", "Meta/Generators/a.py": "generator", "src/a.py": "source",
    "package.json": "config", "CMakeLists.txt": "build_tooling", "Dockerfile": "environment_setup", "Makefile": "build_tooling", "LICENSE": "source",
}


@pytest.fixture(scope="module")
def files(spark):
    def make(contents):
        return Engine.from_corpus(spark.createDataFrame(list(contents.items()), "path string, content string"))

    return make


def test_roles(files):
    got = {r.path: r.role for r in files(dict.fromkeys(ROLES, "x")).relation("files").select("path", "role").collect()}
    assert got == ROLES


def test_facts(files):
    text = {
        "a.py": "import os\nfrom sys import path\nimport os\n\nclass A:\n    def f(self): pass\n# TODO: one\n# see todo_count: no\nif __name__ == '__main__':\n    x()",
        "empty.py": "", "nl.txt": "a\n", "r.md": "# Title\n\ntext\n## A\n\n\n\n\n\ntbd here\n", "m.go": "package main\nfunc main() {\n}\n", "é.py": "défTODO: no\n# fixme- yes\n",
        ".env": "A=1",
    }
    got = {r.path: r for r in files(text).relation("files").collect()}
    a = got["a.py"]
    assert (a.imports, a.symbols, a.todo_count, a.line_count, a.has_main, a.has_class, a.has_function) == (["os", "sys"], ["A", "f"], 1, 10, True, True, True)
    assert (got["empty.py"].line_count, got["empty.py"].size, got["nl.txt"].line_count) == (0, 0, 1)
    assert (got["r.md"].doc_title, got["r.md"].drift, got["r.md"].empty_headings) == ("Title", ["TBD"], 1)
    assert got["m.go"].has_main and got["é.py"].todo_count == 1
    assert (got[".env"].extension, got["a.py"].extension) == (".env", ".py")


def test_very_long_texts(files):
    words = "word another third " * 30_000
    text = {"a.cpp": words + "\nint f(int x)\n", "b.md": "# T\n" + words, "c.py": "x" * 500_000, "d.ts": words}
    got = {r.path: r for r in files(text).relation("files").collect()}
    assert got["a.cpp"].symbols == ["f"] and got["b.md"].doc_title == "T" and got["c.py"].line_count == 1


def test_pairings(files):
    names = ["src/server.py", "src/other.py", "src/lib.go", "tests/test_server.py", "tests/test_my_other.py", "x/lib_test.go", "src/zz.py"]
    got = {r.path: (r.status, r.test_file) for r in files(dict.fromkeys(names, "x")).relation("coverage").collect()}
    assert got["src/server.py"] == ("paired", "tests/test_server.py")
    assert got["src/other.py"] == ("related", "tests/test_my_other.py")
    assert got["src/lib.go"] == ("paired", "x/lib_test.go")
    assert got["src/zz.py"] == ("none", None)


def test_large_vendor_files_skip_later_checks(files):
    long = "# x\n" * 600
    got = {(r.type, r.file) for r in files({"vendor/a.md": long + "tbd\n", "src/a.py": long, "docs/a.md": long + "tbd\n"}).relation("file_issues").collect()}
    assert got == {("large_file", "src/a.py"), ("large_file", "docs/a.md"), ("doc_code_drift", "docs/a.md")}


def test_level_is_from_the_uncapped_score(files):
    text = "\n".join(f"import m{i}" for i in range(14)) + "\nif __name__ == '__main__':\n    pass\ndef f(): pass\n# TODO: x\n" + "x\n" * 600
    r = files({"src/main.py": text}).relation("risks").collect()[0]
    assert (r.score, r.level, r.factors.split(";")[:3]) == (99, "high", ["entry point", "moderate size", "many imports"])


def test_empty_corpus(files):
    e = files({"a.py": "x"})
    none = Engine.from_corpus(e.spark.createDataFrame([], "path string, content string"))
    assert none.relation("health").count() == 1 and none.relation("risks").count() == 0
    assert none.relation("metrics").collect()[0].total_files == 0


def test_plan_has_no_cross_joins(files):
    e = files({"src/a.py": "x", "tests/test_a.py": "x"})
    for name in ("coverage", "degree", "risks"):
        assert "Cartesian" not in e.relation(name)._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in e.relation(name)._jdf.queryExecution().toString()


def test_texts_that_look_like_sql(spark):
    """A text that names a relation is a text."""
    from loam.plans.engine import Engine

    engine = Engine.from_corpus(spark.createDataFrame([("a.py", "x")], "path string, content string"))
    assert engine.sql("select 'taken from files, or join metrics' as t, path from files").first().t == "taken from files, or join metrics"


def test_all_changed_files_with_a_risk_are_shown(spark):
    """More changes than fifty and more risks than eighty; files that stayed are not shown, whatever their risk."""
    corpus = {f"src/m{i:03}.py": f"def f{i}(): pass\n" for i in range(120)} | {f"a/same{i:03}.py": "class A: pass\ndef f(): pass\nif __name__ == '__main__':\n    f()\n" for i in range(90)}
    old = {p: t for p, t in corpus.items() if p.startswith("a/")} | {"src/m000.py": "x = 1\n", "a/gone.py": "def f(): pass\n"}
    new, old = (spark.createDataFrame(list(x.items()), "path string, content string") for x in (corpus, old))
    engine = Engine.from_corpus(new, old)
    got = {r.path: (r.status, r.score, r.level) for r in engine.sql(QUERIES["j7_diff_impact"](SPARK)).collect()}
    risks = {r.file: (r.score, r.level) for r in engine.relation("risks").collect()}
    assert len(risks) == 210 and engine.relation("top_risks").count() == 80
    assert got == {f"src/m{i:03}.py": ("new" if i else "modified", *risks[f"src/m{i:03}.py"]) for i in range(120)}
