"""Many repositories in one plan against an engine for each, on projects with the same paths and opposite facts."""

import pytest

from loam.plans.engine import Engine

BODY = "def main():\n    pass\n\nif __name__ == '__main__':\n    main()\n"
PROJECTS = {
    "app": {"main.py": BODY, "src/core.py": "import os\nclass A:\n    pass\n" * 120, "tests/test_core.py": "def test_a():\n    pass\n", "README.md": "# App\n", "requirements.txt": "fastapi\n"},
    "go": {"go.mod": "module x\n", "pkg/a.go": "package pkg\n" * 40, "pkg/a_test.go": "package pkg\n", "README.md": "# Go\n"},
    "bare": {f"src/m{i}.py": f"# TODO: {i}\nx = {i}\n" for i in range(9)} | {".env": "KEY=1\n"},
    "mono": {f"packages/p{i}/index.ts": "export function f() {}\n" * (i + 1) for i in range(8)} | {"main.py": "x = 1\n", "src/core.py": "y = 2\n"},
    "one": {"notes.md": "tbd\n"},
}
OLD = {"app": {"main.py": "old\n", "gone.py": "x\n"}, "bare": {f"src/m{i}.py": f"# TODO: {i}\nx = {i}\n" for i in range(9)}, "one": {"a.md": "a"}}
RELATIONS = ("metrics", "health", "top_risks", "archetype", "suggestions", "all_issues", "kept_components", "primary_language", "diff", "todo_buckets", "hot_paths", "coverage", "scan_coverage")


@pytest.fixture(scope="module")
def engines(spark):
    rows = lambda all_: spark.createDataFrame([(r, p, t) for r, files in all_.items() for p, t in files.items()], "repo string, path string, content string")
    corpus, old = rows(PROJECTS), rows(OLD)
    alone = {r: Engine.from_corpus(corpus.where(f"repo = '{r}'"), old.where(f"repo = '{r}'")) for r in PROJECTS}
    return Engine.from_repositories(corpus, old), alone


@pytest.mark.parametrize("name", RELATIONS)
def test_equal_to_separate_runs(engines, name):
    fleet, alone = engines
    got = {}
    for r in fleet.relation(name).collect():
        got.setdefault(r.repo, []).append(repr(sorted((k, v) for k, v in r.asDict().items() if k != "repo")))
    for repo, engine in alone.items():
        want = sorted(repr(sorted(r.asDict().items())) for r in engine.relation(name).collect())
        if name == "primary_language" and repo not in got:  # a repository without a language has no row
            assert "unknown" in want[0]
            continue
        assert sorted(got.get(repo, [])) == want, repo


def test_plan_deals_by_repository(engines):
    """No ranking over all repositories at once, no product of relations that grow."""
    for name in ("top_risks", "suggestions", "health"):
        text = engines[0].relation(name)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [row_number() windowspecdefinition(repo" in text or "Window" not in text
