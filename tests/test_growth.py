"""Steps whose cost must not grow faster than their input, and the ways of doing them that must give the same."""

import glob
import itertools
import time
import xml.etree.ElementTree as ET

from loam.functions import extract as X
from loam.operators import catalog, extra, textindex
from loam.plans import engine as engines
from loam.plans.dialect import SPARK as D
from loam.plans.engine import Engine
from loam.plans.relations import RELATIONS
from loam.plans.understanding import ISSUE_ORDER

SF = "/root/testdata/sf0.001"


def test_words_are_found_as_by_the_patterns_that_look_ahead(spark):
    """A word first and what is before it last: the same as a boundary first."""
    w, pieces = r"[\p{L}\p{N}_]", ["", " ", "x", "_", "é", "\n", "(", "9", "-"]
    words = ["class A", "class  é", "class\n_b", "classy A", "class", "def f", "def\t1", "undef f", "function g", "const k = (", "const k=(", "const k = 1", "TODO:", "todo (", "Fixme-", "hack :", "XXXX:", "xxx:", "TODO", "aTODO: TODO:"]
    rows = [(a + x + b + y,) for a, b in itertools.product(pieces, pieces) for x, y in itertools.product(words, ("", " def g", "class Z"))]
    spark.createDataFrame(rows, "x string").createOrReplaceTempView("some_texts")
    before = rf"(?:^|[^\p{{L}}\p{{N}}_])"
    marker = rf"(?i){before}(?:TODO|FIXME|HACK|XXX)\s*[:(-]"
    old = [rf"x rlike r'{before}class\s+{w}+'", rf"x rlike r'{before}def\s+{w}+|{before}function\s+{w}+|{before}const\s+{w}+\s*=\s*\('", f"size(filter(split(x, '\\n'), l -> l rlike r'{marker}'))"]
    new = [X.has_class(D, "x"), X.has_function(D, "x"), X.todo_count(D, "split(x, '\\n')")]
    wrong = spark.sql("select x from some_texts where " + " or ".join(f"({a}) <> ({b})" for a, b in zip(old, new, strict=True)))
    assert wrong.take(3) == []
    held = spark.sql(f"select count_if({new[0]}), count_if({new[1]}), count_if({new[2]} > 0), count(*) from some_texts").first()
    assert all(0 < n < held[3] for n in held[:3])


def test_lines_are_those_without_their_ends(spark):
    texts = ["".join(t) for n in range(5) for t in itertools.product(["a", "\n", "\r", "\x0b", "\x1d", " ", "\x85"], repeat=n)]
    spark.createDataFrame([(t,) for t in texts], "x string").createOrReplaceTempView("some_lines")
    for x, found in spark.sql(f"select x, {X.lines(D, 'x')} from some_lines").collect():
        assert found == (x.splitlines() or [""]), repr(x)


def test_facts_are_stored_when_they_are_asked_for(spark):
    """What reads another table only does not wait for a pass over all contents."""
    docs = spark.createDataFrame([("a.py", "import os\n")], "path string, content string")
    engine = Engine.from_corpus(docs)
    assert engine.sql("select count(*) as n from corpus").first().n == 1 and "files" not in engine.views
    assert engine.relation("files").first().imports == ["os"] and "files" in engine.views


def test_parts_of_stems_are_not_gathered_before_they_are_joined(spark):
    """Related tests as by looking at all pairs; parts leave their task as they are made, no table of them is held."""
    names = [f"test_m{i}.py" for i in (1, 12, 3)] + ["test_.py", "ab_m7_test.py"]
    files = [f"tests/{n}" for n in names] + [f"src/{s}.py" for s in ("m1", "m123", "xm12y", "abc", "m7", "ab", "q", "mm")]
    engine = Engine.from_corpus(spark.createDataFrame([(p, "x\n") for p in files], "path string, content string"))
    got = {r.path: (r.status, r.test_file) for r in engine.relation("coverage").collect()}
    stem = lambda p: p.rsplit("/", 1)[-1][:-3]
    norm = lambda p: stem(p).removeprefix("test_").removesuffix("_test")
    tests = [f"tests/{n}" for n in names]
    for p in files:
        same = [t for t in tests if norm(t) == stem(p)]
        near = [t for t in tests if norm(t) in stem(p) or stem(p) in norm(t).split("_")]
        assert got[p] == (("paired", min(same)) if same else ("related", min(near)) if near else ("none", None)), p
    plan = engine.relation("stem_parts")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate" not in plan[: plan.index("Generate")]


def test_words_of_a_file_are_gathered_where_it_is(spark, monkeypatch):
    """No occurrence is shuffled; files are cut into pieces of words, and two rows of a path are one file."""
    monkeypatch.setattr(textindex, "AT_ONCE", 3)
    texts = [("a", "X y x\n\nx z"), ("b", ""), ("c", "y\ny"), ("c", "y\nw"), ("d", "one two three four five one")]
    rows = spark.createDataFrame(texts, "path string, content string").repartition(1)
    plan = textindex.text_postings(rows.selectExpr("path", "split(content, '\\n') as rows"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the test's own
    facts = rows.selectExpr("path", "'' as summary", "array('q q') as symbols", "cast(array() as array<string>) as imports")
    index = textindex.TextIndex.build(facts, rows)
    want: dict = {}
    for p, t in texts:
        for i, line in enumerate(t.split("\n")):
            for w in line.lower().split():
                want.setdefault((w, p), set()).add(i)
    assert {(r.word, r.path): r.lines for r in index.postings.where("field = 'text'").collect()} == {k: sorted(v) for k, v in want.items()}
    assert index.postings.where("field = 'text'").count() == len(want)
    assert {r.word: (r.about, r.text) for r in index.words.collect()}["q"] == (4, 0) and {r.word: r.text for r in index.words.collect()}["y"] == 2
    assert spark.conf.get(textindex.WRITERS) == "0"


def test_coverage_reports_are_as_many_as_their_bytes_need(spark, monkeypatch, tmp_path):
    """Each is one well-formed document; none is lost, also where there are several."""
    for classes, most in ((10_000, 1), (50, 5)):
        monkeypatch.setattr(extra, "_CLASSES", classes)
        monkeypatch.setattr(extra, "work_dir", lambda _, n=classes: str(tmp_path / str(n)))
        found = extra.s12_coverage_report(spark, SF).count()
        reports = glob.glob(f"{tmp_path}/{classes}/coverage/shard=*/*.txt")
        assert 0 < len(reports) <= most and found == sum(len(ET.parse(p).getroot().findall("classes/class")) for p in reports) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_symbols_are_found_by_one_look_at_each_run_of_words(spark):
    """The same as by looking from each line's beginning; many lines without punctuation take no time that grows with their square."""
    w = r"[\p{L}\p{N}_]"
    run, m = r"[\p{L}\p{N}_][\p{L}\p{N}_\s]*\s", "(?md)"
    parts = ["a", " b", "\n", "(", "::", "é", "\t", ";", "class x", "\r\n", "\x85"]
    texts = ["".join(t) for n in range(6) for t in itertools.product(parts[:8], repeat=n)] + ["".join(t) for t in itertools.product(parts, repeat=4)]
    spark.createDataFrame([(t,) for t in texts], "x string").repartition(16).createOrReplaceTempView("some_symbols")
    old = [rf"regexp_extract_all(x, r'{m}^\s*{p}', 1)" for p in (rf"(?:{run})?({w}+)::{w}*\s*\(", rf"{run}({w}+)\s*\(", rf"class\s+({w}+)")]
    new = X.symbols(D, "x", "'.cpp'")
    wrong = spark.sql(f"select x from some_symbols where not slice(array_distinct(concat({', '.join(old)})), 1, 8) <=> {new}")
    assert wrong.take(3) == [] and spark.sql(f"select count_if(size({new}) > 0) as n from some_symbols").first().n > 1000
    heads = {".py": [r"import\s+([\p{L}\p{N}_.]+)", r"from\s+([\p{L}\p{N}_.]+)\s+import"], ".go": [r"import\s+[\x22\x27]([^\x22\x27]+)[\x22\x27]"], ".h": [r"#include\s*[<\x22]([^>\x22]+)[>\x22]"]}
    lines = ["import a", "from b import", "from b\nimport c", '#include "d"', 'import "e"', "\n", " ", "\x0b", "x", "\r"]
    spark.createDataFrame([("".join(t),) for n in range(5) for t in itertools.product(lines, repeat=n)], "x string").createOrReplaceTempView("some_imports")
    for ext, patterns in heads.items():
        before = f"concat({', '.join(rf"regexp_extract_all(x, r'{m}^\s*{p}', 1)" for p in patterns)})"
        assert spark.sql(f"select x from some_imports where not slice(array_distinct({before}), 1, 20) <=> {X.imports(D, 'x', repr(ext))}").take(3) == [], ext
    began = time.perf_counter()
    assert spark.sql(f"select {new} as s from (select repeat('some words of a line\\n', 60000) || '; a::b(' || repeat('\\n', 60000) || 'x' as x)").first().s == []
    assert time.perf_counter() - began < 30


def test_lines_are_cut_where_they_are_looked_at(spark):
    """Facts of lines are the same whether a text has markers or is a document or not; null stays null."""
    rows = [("a.py", "x\n# TODO: y\n"), ("b.py", "x\ny"), ("c.md", "# T\n\nA line that says enough.\n"), ("d.txt", ""), ("e.py", "Hack (z"), ("README", "# A\n\n\n\n\n\nx"), ("f.py", None)]
    got = {r.path: r for r in Engine.from_corpus(spark.createDataFrame(rows, "path string, content string")).relation("files").collect()}
    assert {p: r.todo_count for p, r in got.items() if p != "f.py"} == {"a.py": 1, "b.py": 0, "c.md": 0, "d.txt": 0, "e.py": 1, "README": 0}
    assert got["c.md"].summary == "A line that says enough." and got["README"].empty_headings == 1 and got["f.py"].line_count is None
    assert [got[p].line_count for p in ("a.py", "b.py", "d.txt")] == [2, 2, 0]


def test_contexts_sort_no_more_issues_than_they_list(spark):
    """The ten first issues, by file, chosen before they are numbered in one task."""
    rows = [("todo", "low", "maintainability", f"f{i:02}", "m", 1) for i in range(30)] + [("no_tests", "high", "test", None, "m", 9)]
    engine = Engine(spark, {"all_issues": spark.createDataFrame(rows[::-1], "type string, severity string, category string, file string, message string, ord int")})
    assert [r.file for r in engine.relation("first_issues").orderBy("file").collect()] == [f"f{i:02}" for i in range(10)]
    said = RELATIONS["context_lines"](D)
    assert f"order by {ISSUE_ORDER}) as o from first_issues" in said and f"order by {ISSUE_ORDER}) as o from all_issues" not in said


def test_what_paths_and_hashes_tell_waits_for_no_facts(spark):
    """Changes, untested changed files and release checks: the same before and after facts are stored, and none stores them."""
    cols = "path string, content string"
    new = spark.createDataFrame([("src/A.py", "x"), ("src/b.py", "y"), ("tests/test_b.py", "new"), ("README.md", "# r"), ("setup.py", "version = '1.2'")], cols)
    old = spark.createDataFrame([("src/A.py", "old"), ("src/b.py", "y"), ("tests/test_b.py", "old"), ("gone.py", "z")], cols)
    engine = Engine.from_corpus(new, old)
    asked = [catalog.QUERIES[q](D) for q in ("sg2_modified_without_tests", "a25_release_checks")] + ["select * from diff_counts", "select path, hash, bare from paths"]
    first = [sorted(map(tuple, engine.sql(q).collect())) for q in asked]
    assert "files" not in engine.views and first[0] == [("src/A.py",)] and first[2] == [(2, 2, 1)]
    assert [r[2] for r in first[1]] == [True, False, True, True, True]
    engine.relation("files")
    assert "files" in engine.views and [sorted(map(tuple, engine.sql(q).collect())) for q in asked] == first
    repos = Engine.from_repositories(new.selectExpr("'r' as repo", "*"), old.selectExpr("'r' as repo", "*"))
    assert tuple(repos.sql("select * from diff_counts").first()) == ("r", 2, 2, 1) and "files" not in repos.views


def test_large_files_are_dealt_out_however_many_there_are(spark, monkeypatch, tmp_path):
    """A row group is one task of Spark's; where files are large, their rows are dealt out in tasks of bounded size."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(cores * 200).repartition(cores + 1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert "Exchange" not in engines.spread(table, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(engines, "TASK_BYTES", 100)
    dealt = engines.spread(table, str(tmp_path / "t"))
    assert dealt.rdd.getNumPartitions() == -(-engines.length(spark, str(tmp_path / "t")) // 100) and dealt.count() == cores * 200
