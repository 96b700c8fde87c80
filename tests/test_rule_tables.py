"""Rules as data against the rules' definition, file by file."""

import json
import random

import pytest

from loam.operators import rules
from loam.operators.related import found_words


def holds(rule, files):
    tops = {p.split("/")[0].lower() for p in files if "/" in p}
    if not {d.lower() for d in rule.get("requires_directories", [])} <= tops:
        return False
    if not any(k in rule for k in rules.FILE_KINDS):
        return True
    low = lambda k: [v.lower() for v in rule.get(k) or []]
    for p, (ext, main, imports) in files.items():
        if low("extension_in") and ext not in low("extension_in"):
            continue
        if low("file_name_in") and p.split("/")[-1].lower() not in low("file_name_in"):
            continue
        if low("path_contains_any") and not any(t in p.lower() for t in low("path_contains_any")):
            continue
        if rule.get("requires_main") and not main:
            continue
        if low("import_contains_any") and not any(t in i.lower() for i in imports for t in low("import_contains_any")):
            continue
        return True
    return False


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules(spark, tmp_path, seed):
    rng = random.Random(seed)
    some = lambda xs: rng.sample(xs, rng.randrange(0, 3))
    files = {f"{rng.choice(['Src', 'docs', 'a'])}/{rng.choice(['Main', 'x', 'test_y'])}{i}{e}": (e, rng.random() < 0.3, some(["os", "FastAPI.x", "lib"])) for i, e in enumerate([".py", ".md", ".go"] * 2)} | {"Setup.py": (".py", False, [])}
    table = []
    for k in range(40):
        rule = {"name": f"r'{k}\"", "description": "d"}
        for key, values in (("extension_in", [".py", ".MD", ".x"]), ("file_name_in", ["setup.py", "main0.py", "X1.md"]), ("path_contains_any", ["src", "DOCS/", "test_", "a"]), ("import_contains_any", ["fast", "OS", "zz"]), ("requires_directories", ["src", "Docs", "none"])):
            if rng.random() < 0.4:
                rule[key] = some(values)
        if rng.random() < 0.3:
            rule["requires_main"] = rng.random() < 0.7
        table.append(rule)
    (tmp_path / "rules.json").write_text(json.dumps({"patterns": table}, indent=1))
    df = spark.createDataFrame([(p, e, m, i) for p, (e, m, i) in files.items()], "path string, extension string, has_main boolean, imports array<string>")
    got = sorted((r.ord, r.name) for r in rules.matching_rules(df, *rules.rule_table(spark, rules.read_rules(spark, str(tmp_path / "rules.json")))).collect())
    assert got == [(k, r["name"]) for k, r in enumerate(table) if holds(r, files)] and 5 < len(got) < 40
    nothing = sorted(r.ord for r in rules.matching_rules(df.limit(0), *rules.rule_table(spark, table)).collect())
    assert nothing == [k for k, r in enumerate(table) if holds(r, {})]


def test_words_in_blocks(spark):
    texts = spark.createDataFrame([("a", "xabcx"), ("b", None), ("c", "bc"), ("a", "zz")], "path string, text string")
    words = spark.createDataFrame([("abc",), ("bc",), ("zz",), ("q",), ("",)], "w string")
    for block in (1, 1000):
        assert sorted(tuple(r) for r in found_words(texts, words, block).collect()) == [("a", "abc"), ("a", "bc"), ("a", "zz"), ("c", "bc")]
