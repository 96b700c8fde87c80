"""Identity, purpose, hints, suggestions and warnings of small hand-made projects, each worked out by hand."""

import pytest

from loam.plans.engine import Engine


@pytest.fixture(scope="module")
def project(spark):
    def make(contents, old=None, listing=None):
        table = lambda rows, schema: spark.createDataFrame(rows, schema)
        return Engine.from_corpus(
            table(list(contents.items()), "path string, content string"), table(list((old or {}).items()), "path string, content string"),
            table([(p,) for p in listing], "path string") if listing else None,
        )

    return make


def one(engine, relation):
    (row,) = engine.relation(relation).collect()
    return row


README = "# Swift Notes: a store of notes\n\n[![badge](https://x/b.svg)](https://x)\n\nWelcome to the notes.\nKeeps [notes](x.md) in one file and finds them again.\n"


def test_identity_and_purpose(project):
    e = project({"README.md": README, "src/main.py": "def f(): pass\nif __name__ == '__main__':\n    f()\n", "tests/test_main.py": "def test(): pass\n"})
    u = one(e, "understanding")
    assert u.project_name == "Swift Notes: a store of notes" and u.purpose == "Keeps notes in one file and finds them again."
    assert u.project_type == "python application with extensive test infrastructure with frontend components"
    assert u.summary.startswith(f"{u.raw_name} appears to be python application")
    named = project({"README.md": README, "package.json": '{"name": "@team/notes", "description": "Finds notes again"}', "setup.py": "setup(name='other')"})
    assert one(named, "identity").asDict() == {"project_name": "notes", "description": "Finds notes again"}
    assert one(named, "purpose").purpose == "Finds notes again."
    bare = project({"lib/a.go": "package lib\n"})
    assert (one(bare, "identity").project_name, one(bare, "primary_language").language) == ("corpus", "go")
    assert one(bare, "project_type").project_type == "go application"
    none = project({"x.bin": ""})
    assert one(none, "purpose").purpose == "Purpose could not be confidently inferred from README." and one(none, "primary_language").language == "unknown"


def test_summaries_and_titles(project):
    e = project(
        {
            "a.md": "no heading yet\n# T\n<p>x</p>\nshort\n| a | -- |\nThe first [real](u) line.\n", "b.py": '"""Does a thing.\n\nMore."""\nx = 1\n', "c.py": "x = 1\n",
            "pyproject.toml": 'name = "n"\ndescription = "d"\n', "setup.py": "setup(name='s', version='1.0')\n", "d.md": "text only\n",
        }
    )
    got = {r.path: r.summary for r in e.relation("files").select("path", "summary").collect()}
    assert got == {"a.md": "The first real line.", "b.py": "Does a thing.", "c.py": "", "pyproject.toml": "n: d", "setup.py": "s", "d.md": ""}
    from loam.functions import extract as X
    from loam.plans.dialect import SPARK

    titles = {"Notes": True, "Why Notes?": False, "What is it": False, "API": False, "Badge shop": False, "one two three four five six seven": False, "<b>x</b>": False, "---": False, "x": False}
    rows = e.spark.createDataFrame([(t,) for t in titles], "t string").selectExpr("t", f"{X.valid_title(SPARK, 't')} as ok").collect()
    assert {r.t: r.ok for r in rows} == titles


def test_hints_and_confidence(project):
    e = project({"src/main.py": "if __name__ == '__main__':\n    x()\n", "tests/test_main.py": "x = 1\n", "pytest.ini": "", "README.md": "# N\n", "setup.py": "setup(name='n')"})
    assert [r.hint for r in e.relation("workflow_hints").orderBy("ord").collect()] == [
        "Start runtime tracing from src/main.py (primary detected runtime entry point)", "Use the test suite as the fastest regression signal",
        "Read the project manifest before changing dependencies or startup flow", "Use the README as the first source of product intent",
    ]
    got = {r.aspect: (r.level, r.reason) for r in e.relation("confidence").collect()}
    assert got["entry_points"] == ("high", "Runtime entry points detected from source files such as src/main.py")
    assert got["language"] == ("high", "Primary language detected: python") and got["identity"] == ("high", "Project name: n")
    important = [(r.path, r.reason) for r in e.relation("important_files").orderBy("rank").collect()]
    assert important[0] == ("src/main.py", "entry point") and ("README.md", "project definition") in important


def test_suggestions(project):
    e = project({"src/main.py": "if __name__ == '__main__':\n    x()\n# TODO: a\n" + "# FIXME: b\n" * 6, "app/.env": "A=1\n"}, {"src/main.py": "old"})
    got = [r.asDict() for r in e.relation("suggestions").orderBy("rank").collect()]
    assert [(r["title"], r["impact"], r["effort"], r["label"]) for r in got[:3]] == [
        ("Add .gitignore immediately", "high", "low", "risky"), ("Add tests for your project", "high", "low", "risky"), ("Update tests for src/main.py", "high", "low", "quick win"),
    ]
    by_title = {r["title"]: r for r in got}
    todo = by_title["Prioritise 7 first-party source TODO/FIXME markers"]
    assert (todo["effort"], todo["label"], todo["confidence"], todo["focus"]) == ("low to triage, high to remediate", "needs user decision", "high", [])
    trace = by_title["Trace the main execution path before editing"]
    assert trace["focus"][0] == "src/main.py" and trace["surface_confidence"] == "high"
    assert by_title["Create a README"]["focus"] == ["src/main.py"] and "Integrate new files" in by_title
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) <= 10
    assert e.relation("test_candidates").collect()[0].asDict() == {"path": "src/main.py", "stem": "main", "test": None, "candidate": "tests/test_main.py"}


def test_archetypes(project):
    kinds = {
        "framework_library medium": ["lib/core/a.py", "lib/python/b.py", "lib/api/c.py"], "cli_server high": ["go.mod", "main.go", "cmd/x.go", "server/y.go"], "monorepo high": ["apps/a.py", "services/b.py"],
        "app high": ["src/main.py", "src/a.py"], "desktop_app high": ["src-tauri/src/main.rs", "src/a.ts"], "browser_engine high": ["libraries/libweb/a.cpp"], "app medium": ["lib/a.py"],
    }
    for kind, paths in kinds.items():
        r = one(project(dict.fromkeys(paths, "x\n")), "archetype")
        assert f"{r.primary_archetype} {r.confidence}" == kind, paths
    library = one(project({"go.mod": "module x\n", "pkg/a.go": "package a\n", **{f"docs/{i}.md": "# x\n" for i in range(9)}}), "archetype")
    assert (library.primary_archetype, library.documentation_heavy, library.mixed_language, library.test_suite) == ("framework_library", True, False, False)


def test_commands_and_evidence_lines(project):
    from loam.operators.catalog import QUERIES
    from loam.plans.dialect import SPARK

    e = project({"src/main.py": "if __name__ == '__main__':\n    x()\n", "tests/test_main.py": "x = 1\n", "tests/test_other.py": "x = 1\n", "docs/a.md": "# A\n\nsome text\nIt is TBD here\n- \n"})
    commands = {r.command for r in e.sql(QUERIES["j14_test_commands"](SPARK)).collect()}
    assert "python -m pytest tests/test_main.py" in commands and commands <= {"python -m pytest tests/test_main.py", "python -m pytest tests/test_main.py tests/test_other.py"}
    assert e.relation("files").where("path = 'docs/a.md'").first().drift_lines == ["TBD at 4: It is TBD here", "empty bullet at 5: -"]


def test_patterns_are_compiled_from_rules(project):
    from loam.plans.dialect import SPARK
    from loam.plans.understanding import patterns_sql

    e = project({"web/main.py": "import fastapi.app\nif __name__ == '__main__':\n    x()\n", "api/x.py": "import flask\n", "Dockerfile": "FROM x\n"})
    rules = [
        {"name": "a", "extension_in": [".PY"], "requires_main": True, "import_contains_any": ["fastapi"]},
        {"name": "b", "extension_in": [".py"], "requires_main": True, "import_contains_any": ["flask"]},  # no one file meets both
        {"name": "c", "requires_directories": ["web", "API"]}, {"name": "d", "requires_directories": ["web", "none"]},
        {"name": "e", "file_name_in": ["dockerfile"]}, {"name": "f", "path_contains_any": ["web/"], "requires_directories": ["api"]},
    ]
    assert [r.name for r in e.sql(patterns_sql(SPARK, rules)).collect()] == ["a", "c", "e", "f"]
    assert [r.name for r in e.relation("patterns").orderBy("ord").collect()] == ["command_line_interface", "containerization"]


def test_coverage_warnings(project):
    go = project({"a.md": "# x\n"}, listing=["go.mod", "cmd/main.go"])
    assert one(go, "coverage_warning").warning.startswith("Scan coverage note: Go module detected")
    left_out = project({"a.go": "package a\n"}, listing=["go.mod", "a.go"])
    assert one(left_out, "coverage_warning").warning.startswith("Scan coverage note: go.mod exists")
    few = project({"src/a.py": "x = 1\n"}, listing=["src/a.py", *[f"src/{i}.bin" for i in range(120)]])
    assert one(few, "coverage_warning").warning == "Scan coverage note: expected directories src are below previous baseline."
    tests = project({"tests/test_a.py": "x\n" * 90, "src/a.py": "x = 1\n" * 10})
    assert "tests represent a large share" in one(tests, "coverage_warning").warning
    none = project({"docs/a.md": "x\n" * 120})
    assert "no first-party source" in one(none, "coverage_warning").warning and one(project({"src/a.py": "x\n"}), "coverage_warning").warning == ""


def test_contexts(project):
    e = project({"src/main.py": "if __name__ == '__main__':\n    x()\n", "README.md": "# Notes\n"})
    text = {r.budget: r.text for r in e.relation("contexts").collect()}
    assert set(text) == {"tiny", "small", "medium", "large"} and len(text["tiny"]) <= len(text["large"])
    lines = text["small"].split("\n")
    assert lines[:4] == ["# Project Knowledge Base", "", "## Summary", "- Project: Notes"] and "## Important Files" in lines and "- src/main.py: entry point" in lines
    r = one(e, "llm_readiness")
    assert r.budget == "tiny" and r.full_tokens == 11 and r.focus_files.split(";")[0] == "src/main.py"


def test_reports(project, tmp_path):
    import json

    from loam.operators import render

    e = project({"src/main.py": "if __name__ == '__main__':\n    x()\n", "README.md": "# Notes <b>\n", "tests/test_main.py": "x = 1\n"})
    assert render.save_bundle(e, str(tmp_path), "small") == ["context.txt", "overview.txt", "prompt.txt", "report.html", "report.json", "report.md"]
    r = json.loads((tmp_path / "report.json").read_text())
    assert r["metrics"]["total_files"] == 3 and list(r) == sorted(r)
    assert "## Suggestions" in (tmp_path / "report.md").read_text() and "<b>" not in (tmp_path / "report.html").read_text()
    assert "- src/main.py: entry point" in (tmp_path / "overview.txt").read_text()
    pack = render.prompt_pack(e, "debug", "tiny")
    assert pack["objective"].startswith("find the most likely root cause") and len(pack["deliverables"]) == 5 and "src/main.py" in pack["focus_files"] and len(pack["focus_files"]) <= 4
    assert pack["text"].endswith(render.context(e, "tiny").strip() + "\n")
    plan = {x.goal: x.objective for x in e.relation("objectives").collect()}
    assert plan["plan"].endswith("; start from src/main.py") and ": " in plan["next"] and set(plan) == {"next", "debug", "review", "plan", "document", "test"}
