"""Related tests by automaton, and the inverted index against a pass over everything."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import related, retrieve, state
from loam.operators.catalog import GOAL_BOOST
from loam.operators.textindex import TextIndex
from loam.plans.engine import Engine
from loam.sources import config

FILES = {
    "src/core.py": "class Core:\n    pass\n", "src/a-b.py": "x = 1\n", "src/été.py": "y = 1\n", "src/quiet.py": "z = 1\n", "src/go.go": "package x\n",
    "tests/test_core.py": "import core\n", "tests/test_other.py": "from src import CORE\n", "tests/sub/test_dash.py": "load('A-B')\n", "tests/test_accent.py": "# ÉTÉ\n",
    "tests/test_none.py": "pass\n", "tests/helper.py": "core\n", "other/test_core.py": "core\n", "tests/test_empty.py": "",
}


@pytest.mark.parametrize("block", [1, 200, 1 << 22])
def test_related_tests(spark, block):
    corpus = spark.createDataFrame(list(FILES.items()), "path string, content string")
    engine = Engine.from_corpus(corpus)
    some = lambda *paths: sorted(r.path for r in related.related_tests(engine.relation("files"), corpus, spark.createDataFrame([(p,) for p in paths], "path string"), block).collect())
    assert some("src/core.py") == ["tests/test_core.py", "tests/test_other.py"]
    assert some("src/a-b.py", "src/été.py", "src/go.go") == ["tests/sub/test_dash.py", "tests/test_accent.py"]
    assert some("tests/test_none.py") == ["tests/test_none.py"] and some("src/quiet.py") == [] and some("nobody.py") == []


def test_index_equals_a_pass(spark):
    rng = random.Random(2)
    words = ["main", "domain", "vector", "Vector2", "x_main_y", "ﬁne", "naïve", "helper", "a", "ab", "mainly", "TITLE"]
    texts = {f"d{i % 5}/f{i}.py": "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(0, 30))) for i in range(60)}
    engine = Engine.from_corpus(spark.createDataFrame(list(texts.items()), "path string, content string"))
    index = retrieve.index_of(engine)
    for terms in (["main"], ["ma", "vector", "main", "main"], ["zzz"], ["helper", "title"]):
        hits = {(r.term, r.path): sorted(r.lines) for r in index.postings_of(index.matching(terms), "text").groupBy("term", "path").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines")).collect()}
        want = {(t, p): [i for i, line in enumerate(c.splitlines()) if t in line.lower()] for t in set(terms) for p, c in texts.items()}
        assert hits == {k: v for k, v in want.items() if v}
    with pytest.raises(ValueError):
        index.matching(["x"])
    # Ranking: a pass over the facts.
    hay = {r.path: (" ".join([r.path, r.summary, " ".join(r.symbols), " ".join(r.imports)]).lower(), r) for r in engine.relation("files").collect()}
    import re

    def score(h, terms, goal):
        s = sum(4 if re.search(rf"(?:^|\W){t}(?:$|\W)", h) else 1 if t in h else 0 for t in terms)
        return s + sum(b in h for b in GOAL_BOOST[goal])

    for question, goal in (("main helper", "review"), ("d1 f11 vector", "test")):
        terms = retrieve.terms_of(question)
        want = [(score(h, terms, goal) + int(r.has_main) + int(r.has_function or r.has_class), r.line_count, p) for p, (h, r) in hay.items() if score(h, terms, goal) > 0]
        want = sorted(want, key=lambda x: (-x[0], x[1], x[2]))[:8]
        assert [(r.score, r.line_count, r.path) for r in retrieve.rank_files(engine, question, goal).collect()] == want
    paths = [f"d{i % 5}/f{i}.py" for i in range(9)]
    got = [(r.k, r.n, r.path, r.start_line, r.text) for r in index.snippets(["main", "title"], paths).orderBy("k", "n").collect()]
    want, shown = [], 0
    for k, p in enumerate(paths, 1):
        lines = texts[p].splitlines()
        at = [i for i, line in enumerate(lines) if "main" in line.lower() or "title" in line.lower()][:2] if shown < 12 else []
        shown += len(at)
        want += [(k, n, p, max(i - 2, 0) + 1, "\n".join(f"{j + 1}: {lines[j]}" for j in range(max(i - 2, 0), min(i + 3, len(lines))))) for n, i in enumerate(at, 1)]
    assert got == want


def test_index_reads_its_buckets(spark):
    index = TextIndex.build(spark.createDataFrame([("a.py", "s", ["x"], ["y"])], "path string, summary string, symbols array<string>, imports array<string>"), spark.createDataFrame([("a.py", "one two\n")], "path string, content string"))
    plan = index._among(index.lines, "path", ["a.py"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(b" in plan or "PartitionFilters: [b" in plan


def test_budgets_and_release(spark, tmp_path):
    engine = Engine.from_corpus(spark.createDataFrame([("README.md", "# T\n"), ("a.py", "x = 1\n"), ("empty.py", "")], "path string, content string"))
    assert (engine.measured["files"], engine.measured["lines"], engine.measured["empty"]) == (3, 2, 1) and engine.measured["scan_seconds"] > 0
    alerts = {r.name: r.message for r in state.budget_alerts(engine, {"files": "2", "scan_seconds": "x", "context_tokens": 10**6}).collect()}
    assert alerts == {"files": "files 3 exceeds budget 2"}
    checks = {r.name: r.ok for r in state.release_checks(engine, config.DEFAULTS, str(tmp_path), "usage: loam [-h]").collect()}
    assert checks == {"README": True, "LICENSE": False, "package metadata": False, "version": False, "tests": False, "CLI help": True, "doctor": False}


def test_events_count_once(spark, tmp_path):
    tables = state.Tables(spark, str(tmp_path / "kb"))
    event = lambda *r: spark.createDataFrame(list(r), "ts string, command string, scan string, full_tokens long, emitted_tokens long")
    tables.record_once(event(("1", "ask", "s1", 100, 25), ("1", "ask", "s2", 10, -5)))
    totals = tables.record_once(event(("2", "ask", "s1", 100, 25), ("2", "context", "s1", 50, 50))).first()
    assert (totals.full_tokens, totals.emitted_tokens, totals.saved) == (160, 75, 85) and tables.last("savings_events", 50).count() == 3
