import pytest
from pyspark.sql import functions as F

from loam.operators import extra, pygraph, retrieve
from loam.plans.engine import Engine


def test_questions(spark):
    rows = [("src/parser.py", "class Parser:\n    def parse_line(self):\n        return 1\n"), ("src/other.py", "x = 1\n"), ("docs/parser.md", "# Parser\n")]
    corpus = spark.createDataFrame(rows, "path string, content string")
    engine = Engine.from_corpus(corpus)
    files = retrieve.rank_files(engine, "where is the parser implemented").collect()
    assert [(r.path, r.score) for r in files] == [("src/parser.py", 5), ("docs/parser.md", 4)]
    symbols = pygraph.python_graph(corpus)
    top = retrieve.rank_symbols(symbols, "parser", retrieve.rank_files(engine, "parser")).collect()
    assert [(r.qualname, r.score) for r in top] == [("Parser", 6), ("Parser.parse_line", 6)]
    assert retrieve.answer(engine, "parser", symbols).endswith("Parser at src/parser.py:1.")
    assert retrieve.answer(engine, "nowhere").startswith("Nothing")
    with pytest.raises(ValueError):
        retrieve.terms_of("what is the")


def test_one_answer(spark):
    rows = [("src/parser.py", "import os\nclass Parser:\n    def parse_line(self):\n        return os.getcwd()\n"), ("src/other.py", '"""Other things."""\ndef f():\n    parse_all()\n'), ("x.py", "def parse_all(): pass\n")]
    corpus = spark.createDataFrame(rows, "path string, content string")
    got = retrieve.retrieve(Engine.from_corpus(corpus), "parser parse_all", pygraph.python_graph(corpus), limit=2)
    assert [f["path"] for f in got["files"]] == ["x.py", "src/parser.py"] and [s["qualname"] for s in got["symbols"]][:2] == ["Parser", "Parser.parse_line"]
    assert [(s["path"], s["start_line"], s["end_line"]) for s in got["snippets"]] == [("x.py", 1, 1), ("src/parser.py", 1, 4)]
    assert "2: class Parser:" in got["text"] and "- src/parser.py: os" in got["text"] and "- src.parser.Parser.parse_line: os.getcwd" in got["text"]
    assert got["full_tokens"] == sum(len(t) for _, t in rows) // 4 and got["saved_percent"] == 0
    files = [{"path": "a", "score": 3}, {"path": "b", "score": 2}]
    known = {"c": {"line_count": 1, "summary": ""}, "a": {"line_count": 1, "summary": ""}}
    kept = retrieve.include_symbol_files(files, [{"path": "a", "score": 9}, {"path": "c", "score": 5}, {"path": "z", "score": 5}], known, 2)
    assert [f["path"] for f in kept] == ["a", "c"]


def test_hints_of_every_module_stay_a_table(spark, monkeypatch):
    """A term in a function's name of every module: the text comes in parts, none longer than its hints, that joined are the text in one."""
    monkeypatch.setattr(retrieve, "PART", 7)
    got = extra.r1_r5_retrieval(spark, "/root/testdata/sf0.001").orderBy("part").collect()
    hints = [line for r in got for line in r.text.split("\nCall Hints:\n")[-1].splitlines()]
    modules = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert [r.part for r in got] == list(range(-(-modules // 7))) and len({r[:6] for r in got}) == 1
    assert hints == sorted(f"- pkg.m{i}.helper: C{i}.run, C{i}" for i in range(modules))
    whole = "".join(r.text for r in got)
    assert got[0].text.startswith("RETRIEVAL") and all("RETRIEVAL" not in r.text for r in got[1:]) and got[0].retrieved_tokens == (len(whole.strip()) + 3) // 4
    monkeypatch.setattr(retrieve, "PART", 10_000)
    (one,) = extra.r1_r5_retrieval(spark, "/root/testdata/sf0.001").collect()
    assert one.text == whole and one[:6] == got[0][:6]


def test_modules_are_those_of_the_paths_or_their_ends(spark):
    paths = ["src/pkg/a.py", "b.py"]
    asked = ["src/pkg/a.py", "pkg/a.py", "a.py", "src/pkg", "xa.py", "b.py", "x/b.py", "kg/a.py", "", None]
    rows = spark.createDataFrame([(p,) for p in asked], "path string").withColumn("held", retrieve._of_paths(F.col("path"), paths))
    assert {r.path: r.held for r in rows.collect()} == {p: None if p is None else any(q.endswith(p) for q in paths) for p in asked}


def test_one_question_builds_no_index_and_is_answered_alike(spark):
    """By passes over facts and the shown files' contents as by postings; two rows of a path are one file, repeated terms count again."""
    rows = [("src/parser.py", '"""Parses the tests."""\nimport os\nclass Parser:\n    def Parse_line(self):\n        return os.getcwd()\n'), ("src/other.py", "def f():\n    parse_all()\n\n\n\n\nx = 'parser'\n# PARSER\n# parser"),
            ("x.py", "def parse_all(): pass\n"), ("two.py", "def parser(): pass\n"), ("two.py", "a\nclass main_error:\n    parser = 1\n"), ("docs/parser.md", "# A parser\n"), ("n.go", "")]
    corpus = spark.createDataFrame(rows, "path string, content string")
    graph, asked = pygraph.python_graph(corpus), [("parser parse parser", "debug", 8), ("parse main tests", "test", 3), ("line os", "", 2), ("zzz", "", 4)]
    engine, indexed = Engine.from_corpus(corpus), Engine.from_corpus(corpus)
    retrieve.index_of(indexed)
    for question, goal, limit in asked:
        one, two = (retrieve.retrieve(e, question, graph, goal, limit) for e in (engine, indexed))
        same = ("files", "symbols", "snippets", "text", "full_tokens", "retrieved_tokens", "saved_percent")
        assert [one[k] for k in same] == [two[k] for k in same] and ("- None matched" in one["text"]) == (question == "zzz")
    assert "index" not in engine.kept
