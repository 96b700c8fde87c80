"""The named relations of an analysis, each as SQL over others; ``plan`` chains those that a query needs.

``files`` has one row for each file: every extracted fact and classification. It is the only relation that reads contents; all
others are joins, aggregates and rankings of its short rows. Relations name their inputs, Catalyst decides the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from loam.functions import classify as C
from loam.functions import extract as X
from loam.functions import roles as R

from .dialect import Spark

# Thresholds and labels of the rules.
LONG_FILE, LARGE_FILE = 500, 100_000
#: Partitions of rows of which each becomes many.
SPREAD = 64
CONFIG_FILES = ("config.json", ".env", "settings.py", "pyproject.toml", "package.json", "requirements.txt", "setup.py")
FRAMEWORKS = {
    "fastapi": ("fastapi", "uvicorn"), "flask": ("flask",), "django": ("django",), "pytest": ("pytest",), "unittest": ("unittest",),
    "pydantic": ("pydantic",), "click": ("click",), "typer": ("typer",), "redis": ("redis",), "sqlalchemy": ("sqlalchemy",),
    "streamlit": ("streamlit",), "react": ("react",), "nextjs": ("next",), "express": ("express",),
}
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".rs": "rust", ".go": "go", "go.mod": "go", "go.sum": "go", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".sh": "shell", ".bash": "shell", "Dockerfile": "docker",
    "Makefile": "make", ".cpp": "c++", ".c": "c++", ".h": "c++", ".hpp": "c++", ".cc": "c++", ".cxx": "c++", ".hh": "c++", ".hxx": "c++",
    ".cmake": "cmake",
}
LANGUAGE_BASE = {
    ".py": ("python", 100), ".ts": ("typescript", 95), ".js": ("javascript", 90), ".rs": ("rust", 85), ".go": ("go", 80),
    ".java": ("java", 75), ".kt": ("kotlin", 70), ".rb": ("ruby", 65), ".php": ("php", 60), ".cs": ("csharp", 55),
    **{e: ("c++", 95) for e in X.C_FAMILY},
}
DISPLAY = {"python": "Python", "c++": "C++", "go": "Go", "rust": "Rust", "typescript": "TypeScript", "javascript": "JavaScript", "java": "Java", "kotlin": "Kotlin", "ruby": "Ruby", "csharp": "C#"}
ENTRY_ORDER = ("runtime", "runtime_surface", "example", "build", "generator", "tooling", "test", "environment", "packaging", "documentation")
FIRST_PARTY = ("browser_engine", "javascript_engine", "runtime_entry", "first_party_source", "core_utility", "runtime_source")
SECONDARY = ("test", "test_data", "documentation", "vendor_generated")
TOOLING = ("build_tooling", "generator", "lint_tooling", "tooling")

RELATIONS: dict[str, Callable[[Spark], str]] = {}


def relation(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
    RELATIONS[f.__name__] = f
    return f


def case(x: str, pairs, default: str = "null") -> str:
    return f"(case {x} " + " ".join(f"when '{k}' then {v}" for k, v in pairs) + f" else {default} end)"


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: The repositories of the test corpus; the first one has three in seven of the files, the last one those at the root.
REPOS = ("mono", "svc-a", "svc-b", "svc-c", "svc-d", "root")
REPO_OF = "case when d % 7 < 3 then 'mono' when d % 7 = 3 then 'svc-a' when d % 7 = 4 then 'svc-b' when d % 7 = 5 then 'svc-c' else 'svc-d' end"


def corpus_of_documents(old: bool = False, repo: bool = False) -> str:
    """The test corpus: documents dressed up as source files. Synthetic paths and headers exercise rules, nothing more."""
    nl = "chr(10)"
    folder = {0: "'src/'", 1: "'tests/'", 2: "'docs/'", 3: "'vendor/x/'", 4: "'packages/' || source || '/'", 5: "'cmd/' || source || '/'",
              6: "'src/generated/'", 7: "'scripts/'", 8: "'i18n/'", 9: "'api/'", 10: "'examples/'", 11: "'tests/fixtures/'", 12: "'.devcontainer/'",
              13: "'Meta/Generators/'", 14: "'services/' || source || '/'"}
    base = {0: "'app' || d || '/main.py'", 1: "'test_mod' || d || '.py'", 2: "'mod' || d || '.py'", 3: "'n' || d || '.go'", 4: "'n' || d || '_test.go'",
            5: "'n' || d || '.cpp'", 6: "'n' || d || '.ts'", 7: "case when d % 2 = 0 then 'r' || d || '/README.md' else 'n' || d || '.md' end",
            8: "'p' || d || '/package.json'", 9: "'q' || d || '/requirements.txt'"}
    head = {0: f"""'if __name__ == "__main__":' || {nl} || '    run()' || {nl}""", 2: f"'class Thing:' || {nl} || '    def run(self):' || {nl}",
            3: f"""'package main' || {nl} || 'import "fmt"' || {nl} || 'func main() {{' || {nl}""",
            5: f"'#include <vector>' || {nl} || 'int main(int n) {{' || {nl}", 6: f"""'import x from "react"' || {nl} || 'export function f() {{}}' || {nl}""",
            7: f"'# Title ' || d || {nl} || {nl} || 'A summary of the document that follows.' || {nl} || '## Empty' || {nl}",
            8: f"""'{{"name": "pkg' || d || '", "description": "about it"}}' || {nl}""", 10: f"'#!/bin/sh' || {nl}"}
    by = lambda x, t, e: f"(case {x} " + " ".join(f"when {k} then {v}" for k, v in t.items()) + f" else {e} end)"
    deps = " || ".join(f"'import lib{i}' || {nl}" for i in range(12))
    few = " || ".join(f"'from pkg{i} import x' || {nl}" for i in range(6))
    body = f"case when d % 53 = 0 then repeat(t || {nl}, 80) else t end"
    changed = "case when d % 13 = 0 then t || ' older' else t end" if old else "t"
    rows = "where d % 10 <> 0" if old else ""
    whose = f"{REPO_OF} as repo, " if repo else ""
    return f"""select {whose}{by('d % 16', folder, "''")} || {by('d % 11', base, "'n' || d || '.sh'")} as path,
      {by('d % 11', head, "''")} || case when d % 3 = 0 then '# TODO: fix it' || {nl} else '' end
      || case when d % 11 in (0, 1, 2) and d % 4 = 0 then 'import os' || {nl} || 'import fastapi' || {nl} || 'def helper():' || {nl} else '' end
      || case when d % 11 in (0, 1, 2) and d % 6 = 0 then {few} else '' end || case when d % 11 in (0, 2) and d % 12 = 0 then {deps} else '' end
      || case when d % 11 = 7 and d % 7 = 0 then 'tbd' || {nl} || '# A' || {nl} || {nl} || {nl} || {nl} || {nl} || '# B' || {nl} else '' end || {body} as content
      from (select doc_id as d, coalesce(source, 'none') as source, {changed} as t from (select doc_id, source, coalesce(text, '') as t, doc_id as d from documents) x) y {rows}"""


#: Files at the corpus's root.
ROOT_FILES = {
    "README.md": "# Corpus of files\n\n[![build](https://example.org/b.svg)](https://example.org)\n\nFiles made of [documents](https://example.org) that exercise every rule of the catalogue.\n",
    "setup.py": "from setuptools import setup\nsetup(name='corpus-of-files', version='1.2.3', description='Files made of documents')\n",
    "src/tool.py": "\"\"\"A tool with a docstring.\n\nMore of it.\n\"\"\"\nimport os\n",
    "LICENSE": "MIT License\n", "app/.env": "A=1\n",
}


def root_files(d: Spark, repo: bool = False) -> str:
    quoted = lambda t: " || chr(10) || ".join(d.lit(x) for x in t.split("\n"))
    whose = "'root' as repo, " if repo else ""
    return " union all ".join(f"select {whose}'{p}' as path, {quoted(t)} as content" for p, t in ROOT_FILES.items())


@relation
def corpus(d: Spark) -> str:
    return f"{corpus_of_documents(repo=bool(d.key()))} union all {root_files(d, bool(d.key()))}"


@relation
def old_corpus(d: Spark) -> str:
    whose = f"{REPO_OF.replace('d %', 'doc_id %')} as repo, " if d.key() else ""
    return f"{corpus_of_documents(True, bool(d.key()))} union all select {whose}'gone/g' || doc_id || '.py' as path, coalesce(text, '') as content from documents where doc_id % 17 = 0"


def facts_sql(d: Spark, source: str) -> str:
    n = X.name("path")
    rows = X.lines(d, "content")
    if d.name == "spark":
        # Lines are read of documents and counted for markers; no others are cut.
        document = X.is_document(f"lower({X.suffix(d, 'path')})", f"lower({n})")
        rows = f"case when content is not null and not {document} and not {X.has_marker('content')} then array('') else {rows} end"
    return f"""select {d.key()}path, content, {rows} as rows, lower('/' || path) as lp, lower(path) as bare, lower({n}) as n, lower({X.stem(d, 'path')}) as st, lower({X.suffix(d, 'path')}) as suf,
      {X.extension(d, 'path')} as extension, {d.split('lower(path)', '/')} as parts, cast({d.octets('content')} as bigint) as size, {X.line_count(d, 'content')} as line_count, {d.sha('content')} as hash from {source}"""


def path_facts(d: Spark) -> str:
    """The relation of path, bare and hash."""
    return "paths" if d.name == "spark" else "files"


@relation
def paths(d: Spark) -> str:
    """What of a file's facts its path and its hash alone tell: queries of nothing else read this and wait for no pass over contents."""
    return f"select {d.key()}path, bare, hash from ({facts_sql(d, 'corpus')}) f"


@relation
def facts(d: Spark) -> str:
    x, ext = "content", "suf"
    both = "case when meta_name is not null and meta_description is not null then meta_name || ': ' || meta_description else coalesce(meta_name, meta_description, '') end"
    heading = d.at(d.filter(d.sequence("1", d.size("rows")), "i", f"left(trim({d.at('rows', 'cast(i as int)')}), 1) = '#'"), "1")
    if d.name == "spark":
        heading = f"case when {ext} in ('.md', '.txt') then {heading} end"
    drop = lambda *c: f"{'except' if d.name == 'spark' else 'exclude'} ({', '.join(c)})"
    after = d.cut("rows", "heading + 1", d.size("rows"))
    return f"""select * {drop('rows', 'heading')}, {X.summary(d, ext, 'n', x, after, both)} as summary from (select *, {X.has_main(d, x, ext)} as has_main, {X.has_class(d, x)} as has_class, {X.has_function(d, x)} as has_function, {X.imports(d, x, ext)} as imports,
      {X.symbols(d, x, ext)} as symbols, cast({X.todo_count(d, 'rows')} as bigint) as todo_count, {X.manifest(d, x, ext, 'n', 'name')} as meta_name, {X.manifest(d, x, ext, 'n', 'description')} as meta_description,
      case when {X.is_document(ext, 'n')} then {X.doc_title(d, x)} end as doc_title,
      case when {X.is_document(ext, 'n')} then {X.drift_flags(d, x)} else {d.no_texts()} end as drift,
      case when {X.is_document(ext, 'n')} then {X.drift_lines(d, 'rows', x)} else {d.no_texts()} end as drift_lines,
      case when {X.is_document(ext, 'n')} then cast({X.empty_headings(d, 'rows')} as bigint) else 0 end as empty_headings, {heading} as heading from ({facts_sql(d, 'corpus')}) f) g"""


@relation
def files(d: Spark) -> str:
    test = f"""not {d.match('path', r'(^|/)\.[^/]*/')} and ({d.match('bare', r'(^|/)(tests|test|spec|unittests|unit)/')} or {X.begins('n', 'test_')} or {X.ends('n', '_test.py', '_test.go')}
      or contains(n, '.spec.') or contains(bare, 'wpt-import'))"""
    return f"""select *, {C.context(d, 'role', 'lp', 'bare', 'n', 'parts')} as ctx, {C.entry_category(d, 'role', 'bare', 'n', 'st', 'parts', 'has_main')} as category,
      {C.entry_score(d, 'base_category', 'st', 'parts')} as entry_score,
      (candidate or has_main) and not is_test_file and role not in ('test', 'test_runner', 'fixture', 'generated_sdk') as is_entry,
      {C.hotspot_group('surface')} as hotspot from (
      select *, {C.surface('role')} as surface, {C.entry_category(d, 'role', 'bare', 'n', 'st', 'parts', 'false')} as base_category, {C.component_key(d, 'path')} as component,
        role = 'source' and {X.one_of('suf', C.SOURCE)} and {C.is_entry_candidate(d, 'lp', 'n', 'st')} as candidate, {test} as is_test_file,
        n in {listed(CONFIG_FILES)} as is_config_file, not {d.match('path', r'(^|/)\.[^/]*/')} and ({X.one_of('n', ('readme.md', 'readme.txt', 'readme'))}
          or {d.match('bare', r'(^|/)(docs|doc|documentation)/')} or {X.ends('bare', '.md')}) as is_doc_file, cast({d.size('imports')} as bigint) as import_count
      from (select *, {C.role(d, 'lp', 'n', 'suf')} as role from facts) a) b"""


@relation
def metrics(d: Spark) -> str:
    return f"""select {d.key()}cast(count(*) as bigint) as total_files, cast(sum(line_count) as bigint) as total_lines, cast(sum(size) as bigint) as total_size_bytes,
      cast(sum(todo_count) as bigint) as open_todos, cast({d.div('sum(line_count)', 'greatest(count(*), 1)')} as bigint) as avg_lines_per_file,
      coalesce(bool_or(is_test_file), false) as has_tests, coalesce(bool_or(is_doc_file), false) as has_docs, coalesce(bool_or(is_entry), false) as has_entries,
      coalesce(bool_or(n in ('readme.md', 'readme.txt', 'readme')), false) as has_readme, cast(count_if(is_test_file) as bigint) as test_files from files{d.group()}"""


@relation
def todo_buckets(d: Spark) -> str:
    bucket = """case when role in ('test', 'test_runner', 'fixture') then 'tests_fixtures' when role in ('documentation', 'specification') then 'docs'
      when role in ('vendor', 'generated_sdk', 'localization', 'dependency_lock') then 'vendor_generated'
      when role in ('build_tooling', 'generator', 'config', 'environment_setup') then 'tooling' else 'first_party_source' end"""
    names = " union all ".join(f"select '{b}' as bucket" for b in ("first_party_source", "tests_fixtures", "docs", "vendor_generated", "tooling"))
    return f"""select {d.key('b')}b.bucket, cast(coalesce(sum(t.todo_count), 0) as bigint) as todos from ({d.for_each_key(names)}) b
      left join (select {d.key()}{bucket} as bucket, todo_count from files) t on b.bucket = t.bucket{d.same('b', 't')} group by {d.key('b')}b.bucket"""


@relation
def entry_points(d: Spark) -> str:
    rank = case("base_category", [(c, i) for i, c in enumerate(ENTRY_ORDER)])
    return f"select {d.key()}path, base_category as category, cast(entry_score as bigint) as score, {rank} as category_rank from files where is_entry"


@relation
def file_issues(d: Spark) -> str:
    light = "role in ('config', 'documentation', 'localization', 'specification')"
    kind = f"case when {light} then 'maintainability' else 'structural' end"
    skipped = "role in ('vendor', 'dependency_lock')"
    long, large = f"line_count > {LONG_FILE}", f"size > {LARGE_FILE}"
    # Long or large vendor and lock files leave before the later checks.
    return f"""select {d.key()}'todo' as type, 'low' as severity, 'maintainability' as category, path as file, 'Contains ' || todo_count || ' TODO/FIXME markers' as message, 1 as ord from files where todo_count > 0
      union all select {d.key()}'large_file', 'medium', {kind}, path, {C.large_file_policy('role', 'line_count')}, 2 from files where {long} and not {skipped}
      union all select {d.key()}'large_file_size', 'medium', {kind}, path, 'File is ' || {d.div('size', '1024')} || 'KB', 3 from files where {large} and not {skipped}
      union all select {d.key()}'doc_code_drift', case when {d.size('drift')} > 0 then 'low' else 'medium' end, case when role in ('generated_sdk', 'localization') then 'structural' else 'maintainability' end, path,
        {d.size('drift')} || ' drift indicators, ' || empty_headings || ' empty headings', 4 from files where ({d.size('drift')} > 0 or empty_headings >= 3) and not ({skipped} and ({long} or {large}))"""


@relation
def archetype_signals(d: Spark) -> str:
    """What paths alone say of a project's kind: one row of existences and counts."""
    has = lambda c: f"coalesce(bool_or({c}), false)"
    main = X.ends("path", "main.rs", "main.go", "main.ts", "main.py", "main.cpp", "main.cc")
    aside = X.any_in("path", ("/gen/", "/generated/", "/genop/", "/tools/", "/cmd/")) + " or " + X.begins("path", "tools/", "cmd/")
    second, raw = d.at("parts", "2"), X.suffix(d, "path")
    roots = listed(("core", "python", "compiler", "lite", "runtime", "api", "go", "java", "c", "cc", "tools", "stream_executor", "tpu", "dtensor"))
    runtime = ("core/", "runtime/", "api/", "python/", "compiler/", "lite/")
    code = (".py", ".js", ".ts", ".rs", ".go", ".cpp", ".c", ".h", ".java", ".cc", ".hpp", ".hh", ".hxx")
    languages = (".py", ".js", ".ts", ".rs", ".go", ".cpp", ".c", ".h", ".hpp", ".cc", ".java", ".kt", ".rb", ".cs")
    return f"""select {d.key()}{has("contains(path, 'libraries/lib')")} as browser, {has("contains(path, 'src-tauri/src/main.rs')")} as tauri, {has(X.ends('path', 'go.mod'))} as go_mod, {has(X.ends('path', 'main.go'))} as main_go,
      count_if({X.begins('path', 'packages/')}) > 5 or count_if({X.begins('path', 'crates/')}) > 5 or {has(X.begins('path', 'apps/'))} and {has(X.begins('path', 'services/'))}
        or {has(X.begins('path', 'modules/'))} and {has(X.begins('path', 'services/'))} as packaged,
      {has(X.begins('path', 'cmd/', 'server/'))} as cmd_or_server, {has(X.begins('path', 'api/', 'src/'))} as api_or_src, {has(f'{main} and not ({aside})')} as main_root, count_if({main} and not ({aside})) as mains,
      {has(X.any_in('path', ['/' + x for x in runtime]) + ' or ' + X.begins('path', *runtime))} as large_runtime, count(distinct case when {second} in {roots} then {second} end) >= 2 as layout,
      count_if({X.begins('path', 'vendor/', 'third_party/')}) as vendor, count_if({X.any_in('path', ('/gen/', '/generated/'))}) as generated, count_if({X.begins('path', 'docs/')} or {X.ends('path', '.md')}) as docs,
      count_if({raw} in {listed(code)}) as sources, count_if({X.any_in('path', ('/test/', '/tests/'))} or {X.ends('path', '_test.go')}) as tests, count(distinct case when suf in {listed(languages)} then suf end) as languages from files{d.group()}"""


def _archetype(d: Spark, go: str, browser: str) -> str:
    """Later rules override earlier ones; a framework or library is an app without a main file of its own, or one laid out as such."""
    rooted = "(main_root or tauri) and (cmd_or_server or api_or_src)"
    framework = "p = 'app' and (layout and mains <= 2 and sources >= 3 or not main_root and (api_or_src or large_runtime or layout))"
    return f"""select {d.key()}case when {framework} then 'framework_library' else p end as primary_archetype, case when {framework} then 'medium' else c end as confidence, vendor > 20 as vendor_heavy, generated > 20 as generated_heavy,
      docs > 2 * sources and sources > 0 as documentation_heavy, tests > 0 and tests > 2 * sources as test_suite, languages >= 3 as mixed_language from (select *,
        case when go and not main_go then 'framework_library' when {rooted} then case when go then 'cli_server' when tauri then 'desktop_app' else 'app' end
          when packaged then 'monorepo' when tauri then 'desktop_app' when web then 'browser_engine' else 'app' end as p,
        case when go and not main_go then 'medium' when {rooted} or packaged or tauri or web then 'high' else 'medium' end as c
      from (select *, go_mod and {go} as go, browser or {browser} as web from archetype_signals) s) x"""


@relation
def archetype(d: Spark) -> str:
    return _archetype(d, f"{d.value('language', 'primary_language')} = 'go'", d.exists("kept_components", "lower(key) in ('libraries/libweb', 'libraries/libjs', 'ak')"))


@relation
def plain_archetype(d: Spark) -> str:
    """Of paths alone, as issues are found before languages and components are known."""
    return _archetype(d, "false", "false")


@relation
def issues(d: Spark) -> str:
    one = lambda t, s, c, m, cond: f"select {d.key()}'{t}', '{s}', '{c}', cast(null as {'string' if d.name == 'spark' else 'varchar'}), '{m}', 9 from metrics where {cond}"
    return f"""select * from file_issues
      union all {one('no_tests', 'high', 'test', 'No test files detected in project', 'not has_tests')}
      union all {one('no_readme', 'medium', 'structural', 'No README file found', 'not has_readme')}
      union all {one('no_entry_point', 'low', 'runtime', 'No clear entry point detected', f"total_files > 3 and not has_entries and {d.value('primary_archetype', 'plain_archetype')} not in ('framework_library', 'monorepo')")}"""


@relation
def tests(d: Spark) -> str:
    plain = d.sub("st", "_test$", "")
    return f"select {d.key()}path, suf, case when suf = '.go' then {plain} else {d.sub(d.sub('st', '^test_', ''), '_test$', '')} end as norm from files where is_test_file"


@relation
def testables(d: Spark) -> str:
    return f"select {d.key()}path, st, right(path, 3) = '.py' as py from files where right(path, 3) in ('.py', '.go')"


@relation
def test_keys(d: Spark) -> str:
    """Equality keys of the pairings: the normalised stem, tails of Go test names, parts of normalised stems."""
    tails = d.each(d.sequence("1", "greatest(length(norm), 1)"), "i", "substr(norm, cast(i as int))")
    return f"""select {d.key()}norm as k, 'same' as how, min(path) as test from tests{d.group('norm')}
      union all select {d.key()}k, 'tail', min(path) from (select {d.key()}path, {d.explode(tails)} as k from tests where right(path, 8) = '_test.go') t{d.group('k')}
      union all select {d.key()}k, 'part', min(path) from (select {d.key()}path, {d.explode(d.split('norm', '_'))} as k from tests) t{d.group('k')}"""


@relation
def stem_parts(d: Spark) -> str:
    """All substrings of Python stems: whether a test's stem is inside one is then an equality.

    On Spark the stems are dealt out by number before they are taken apart (what comes out is some hundred times what goes in, so
    partitions of a size would be one task), and their parts go to the join as they come: repeated ones change no minimum.
    """
    if d.name == "spark":
        stems = f"select distinct {d.key()}st from (select /*+ repartition({SPREAD}, st) */ {d.key()}st from testables where py) y"
        parts = d.explode(d.each(d.sequence("1", "length(st) - i + 1"), "j", "substr(st, cast(i as int), cast(j as int))"))
        return f"select {d.key()}st, {parts} as k from (select {d.key()}st, {d.explode(d.sequence('1', 'length(st)'))} as i from ({stems}) a) b union all select distinct {d.key()}st, '' from testables where py"
    spans = d.explode(d.sequence("1", "length(st)"))
    return f"""select distinct {d.key()}st, substr(st, cast(i as int), cast(j as int)) as k from (select {d.key()}st, i, {d.explode(d.sequence('1', 'length(st) - i + 1'))} as j from (
      select {d.key()}st, {spans} as i from (select distinct {d.key()}st from testables where py) a) b) c union select distinct {d.key()}st, '' from testables where py"""


@relation
def coverage(d: Spark) -> str:
    """path, status (paired, related, none), test_file."""
    return f"""select {d.key('s')}s.path, case when a.test is not null or t.test is not null then 'paired' when r.test is not null then 'related' else 'none' end as status,
      case when a.test is not null or t.test is not null then least(coalesce(a.test, t.test), coalesce(t.test, a.test)) else r.test end as test_file
      from testables s left join (select {d.key()}k, test from test_keys where how = 'same') a on s.st = a.k{d.same('s', 'a')}
      left join (select {d.key()}k, test from test_keys where how = 'tail') t on s.st = t.k and not s.py{d.same('s', 't')}
      left join (select {d.key()}st, min(test) as test from (select {d.key('p')}p.st, k.test from stem_parts p join test_keys k on p.k = k.k{d.same('p', 'k')} where k.how = 'same'
        union all select {d.key('q')}q.st, k.test from (select distinct {d.key()}st from testables where py) q join test_keys k on q.st = k.k{d.same('q', 'k')} where k.how = 'part') z where st <> ''{d.group('st')}) r on s.st = r.st and s.py{d.same('s', 'r')}"""


@relation
def issue_counts(d: Spark) -> str:
    return f"select {d.key()}file, count(*) as n, {d.join(d.slice(d.distinct(d.slice(d.collect('type', 'ord'), 2)), 2), ',')} as types from file_issues{d.group('file')}"


@relation
def scored(d: Spark) -> str:
    gates = f"""role in ('source', 'config') and not is_test_file and not {X.any_in('bare', C.SHOWN_DIRS)} and not {X.begins('n', 'gen_')}
      and not {X.any_in('bare', ('/gen_', '/genop/'))}"""
    return f"""select f.*, i.n as issue_count, i.types as issue_types, case when right(f.path, 3) in ('.py', '.go') then c.status else 'not_applicable' end as test_status, c.test_file,
      case when is_entry then 30 else 0 end + case when line_count > 500 and role = 'config' then 8 when line_count > 250 then 10 else 0 end
      + case when import_count >= 12 then 15 when import_count >= 6 then 8 else 0 end + case when has_main then 10 else 0 end
      + case when has_class or has_function then 6 else 0 end + case when c.status = 'none' then 12 else 0 end + 8 * coalesce(i.n, 0) as raw
      from (select * from files where {gates}) f left join coverage c on f.path = c.path{d.same('f', 'c')} left join issue_counts i on f.path = i.file{d.same('f', 'i')}"""


@relation
def risks(d: Spark) -> str:
    marks = d.array(
        "case when is_entry then 'entry point' end",
        "case when line_count > 500 and role = 'config' then 'large data/config file' when line_count > 250 then 'moderate size' end",
        "case when import_count >= 12 then 'many imports' when import_count >= 6 then 'several imports' end",
        "case when has_main then 'runtime surface' end",
        "case when has_class or has_function then 'executable code' end",
        "case when test_status = 'none' then 'no obvious paired test' end",
    )
    kinds = d.array(
        "case when line_count > 500 and role = 'config' then 'maintainability' end",
        "case when is_entry or has_main or role = 'source' then 'runtime' end",
        "case when line_count > 250 and not (line_count > 500 and role = 'config') or import_count >= 6 then 'structural' end",
        "case when test_status = 'none' then 'test' end",
    )
    kept = d.filter(marks, "m", "m is not null")
    factors = d.slice(d.distinct(d.concat(kept, f"case when issue_types is null then {d.no_texts()} else {d.split('issue_types', ',')} end")), 6)
    cats = d.filter(kinds, "m", "m is not null")
    return f"""select {d.key()}path as file, cast(least(raw, 100) as bigint) as score, case when raw >= 55 then 'high' when raw >= 30 then 'medium' else 'low' end as level,
      {d.join(factors, ';')} as factors, case when {d.size(cats)} = 0 then 'maintainability' else {d.join(d.sort(cats), ';')} end as risk_categories, surface, test_status, test_file from scored where raw > 0"""


@relation
def top_risks(d: Spark) -> str:
    return d.first("*", "from risks", "score desc, file", 80)


@relation
def hotspots(d: Spark) -> str:
    gates = f"""role not in ('vendor', 'dependency_lock', 'generated_sdk', 'localization') and not (hotspot = 'runtime' and (role <> 'source'
      or {X.any_in('bare', (*C.SHOWN_DIRS, *C.TEST_DIRS, '/docs_src/'))}))"""
    return f"""select {d.key('f')}f.path, f.hotspot as bucket, f.line_count, coalesce(cast(r.score as double), 0.0) + least(cast(f.line_count as double) / 40.0, 120.0) + least(cast(f.size as double) / 50000.0, 20.0)
      + coalesce(i.n, 0) * 8 + case when f.is_entry then cast(f.entry_score as double) else 0.0 end / 10.0
      + case f.hotspot when 'runtime' then 10 when 'test_data' then -10 when 'documentation' then -15 else 0 end as score
      from (select * from files where {gates}) f left join top_risks r on f.path = r.file{d.same('f', 'r')} left join issue_counts i on f.path = i.file{d.same('f', 'i')}"""


@relation
def components(d: Spark) -> str:
    """Groups by key; those without a slash and with more than three files are split at the second level."""
    return f"""select {d.key()}key, cast(count(*) as bigint) as file_count, cast(sum(line_count) as bigint) as line_count from (
      select {d.key('f')}f.path, f.line_count, case when not contains(f.component, '/') and c.n > 3 then {d.join(d.cut(d.split('f.path', '/'), '1', '2'), '/')} else f.component end as key
      from files f join (select {d.key()}component, count(*) as n from files where component is not null{d.group('component')}) c on f.component = c.component{d.same('f', 'c')}) x{d.group('key')}"""


@relation
def role_names(d: Spark) -> str:
    return R.dimension(R.ROLES)


@relation
def library_names(d: Spark) -> str:
    return R.dimension(R.LIBRARIES)


@relation
def kept_components(d: Spark) -> str:
    return d.first("key, file_count, line_count", f"from components where file_count > 2 or {d.count('components')} <= 3 or {d.count('components', 'file_count > 2')} < 3", "line_count desc, file_count desc, key", 15)


@relation
def framework_hits(d: Spark) -> str:
    rules = " ".join(
        f"when {' or '.join(f"(i = '{t}' or left(i, {len(t) + 1}) in ('{t}.', '{t}/') or {d.has(d.split('i', '[^a-z0-9]+'), repr(t))})" for t in tokens)} then '{label}'"
        for label, tokens in FRAMEWORKS.items()
    )
    weight = f"case when ctx in {listed(SECONDARY)} then 1 when ctx in {listed(FIRST_PARTY)} then 10 when ctx in {listed(TOOLING)} then 5 else 4 end"
    return f"select distinct path, label, tenths, ctx not in {listed(SECONDARY)} as main from (select path, ctx, {weight} as tenths, case {rules} end as label from (select path, ctx, {d.explode(d.each('imports', 'z', 'lower(z)'))} as i from files) x) y where label is not null"


@relation
def frameworks(d: Spark) -> str:
    return """select label, cast(sum(tenths) as bigint) as tenths from framework_hits group by label
      having sum(tenths) >= 10 and (sum(case when main then tenths else 0 end) >= 10 or label in ('pytest', 'unittest'))"""


@relation
def language_scores(d: Spark) -> str:
    base = case("extension", [(e, v[1]) for e, v in LANGUAGE_BASE.items()])
    lang = case("extension", [(e, f"'{v[0]}'") for e, v in LANGUAGE_BASE.items()])
    # hundredths, so that truncation is exact
    weight = f"""case when ctx in ('test', 'test_data', 'documentation') then 15 when ctx in ('vendor_generated', 'resources', 'data_or_config') then 25 when ctx = 'environment' then 20
      when ctx in {listed((*FIRST_PARTY, 'python_api'))} then 220 when ctx in {listed(TOOLING)} then 75 else 100 end"""
    bonus = [("c++", 80, "n = 'cmakelists.txt'"), ("rust", 35, X.ends("path", "Cargo.toml")), ("go", 120, "n in ('go.mod', 'go.sum')"), ("go", 50, "n = 'go.mod'"), ("go", 60, "contains(path, '/cmd/') or left(path, 4) = 'cmd/'")]
    more = " union all ".join(f"select {d.key()}'{k}', cast(case when bool_or({c}) then {v} else 0 end as bigint) from files{d.group()}" for k, v, c in bonus)
    return f"""select {d.key()}language, cast(sum(points) as bigint) as points from (select {d.key()}{lang} as language, cast({d.div(f'{base} * {weight}', '100')} as bigint) as points from files union all {more}) x
      where language is not null{d.group('language')} having sum(points) > 0"""


@relation
def category_lines(d: Spark) -> str:
    kinds = {
        "source": (*FIRST_PARTY, "application"), "tests": ("test", "test_support", "test_data"), "tooling": TOOLING, "documentation": ("documentation", "specification_documentation"),
        "environment": ("environment",), "data": ("resources", "data_or_config", "vendor_generated", "generated_sdk", "localization_resource", "test_data"),
    }
    sums = ", ".join(f"cast(coalesce(sum(case when ctx in {listed(v)} then line_count else 0 end), 0) as bigint) as {k}_lines" for k, v in kinds.items())
    return f"select {d.key()}{sums} from files{d.group()}"


@relation
def scan_coverage(d: Spark) -> str:
    total = "greatest(1, source_lines + tests_lines + tooling_lines + documentation_lines + environment_lines + data_lines)"
    return f"""select c.*, {d.half_even(f'cast(tests_lines as double) / {total}', 3)} as test_ratio, {d.half_even(f'cast(source_lines as double) / {total}', 3)} as source_ratio, warning
      from category_lines c {d.paired('c', 'coverage_warning')}"""


@relation
def all_issues(d: Spark) -> str:
    """With what scan coverage adds; it does not feed risk scores."""
    return f"select * from issues union all select {d.key()}'scan_coverage', 'medium', 'structural', cast(null as {'string' if d.name == 'spark' else 'varchar'}), warning, 10 from scan_coverage where warning <> ''"


@relation
def signals(d: Spark) -> str:
    return f"""select {d.key()}category, count(*) as n from (select {d.key()}category from all_issues union all select {d.key()}'maintainability' from all_issues where type in ('large_file', 'large_file_size') and category <> 'maintainability'
      union all select {d.key()}{d.explode(d.split('risk_categories', ';'))} from top_risks) x{d.group('category')}"""


@relation
def health_inputs(d: Spark) -> str:
    return f"""select m.*, {d.count('all_issues')} as issue_count, coalesce({d.value('n', 'signals', "category = 'runtime'")}, 0) as runtime_signals,
      {d.value('todos', 'todo_buckets', "bucket = 'docs'")} as doc_todos, greatest(1, coalesce(total_lines, 0)) as lines1,
      coalesce(total_lines, 0) >= 50000 or total_files >= 2000 as mature,
      {d.count('all_issues', "type = 'no_entry_point'")} > 0 as no_entry, {d.count('all_issues', "type = 'no_tests'")} > 0 as no_tests from metrics m"""


@relation
def health(d: Spark) -> str:
    density = "cast(coalesce(open_todos, 0) as double) / lines1 * 1000"
    return f"""select {d.key()}cast(greatest(30, least(100, maintainability + case test_signal when 'strong' then 5 when 'missing' then -10 else 0 end
        + case runtime_level when 'high' then -5 when 'medium' then -2 else 0 end + case when documentation <= 30 then -5 else 0 end - 5
        + case when mature and test_signal = 'strong' then 3 else 0 end)) as bigint) as score,
      cast(maintainability as bigint) as maintainability, case when maintainability >= 85 then 'low' when maintainability >= 65 then 'medium' else 'high' end as maintainability_risk,
      cast(documentation as bigint) as documentation, runtime_level, test_signal, {d.half_even('density', 2)} as todo_density from (
      select {d.key()}mature, {density} as density, greatest(0, least(100, 80 - least(30, doc_todos * 3))) as documentation,
        greatest(55, least(100, {d.half_even(f'100 - case when mature then least(25.0, {density} * 4) else least(35.0, {density} * 6) end - least(20.0, cast(issue_count as double) / 60)')})) as maintainability,
        case when no_entry then 'medium' when runtime_signals >= 8 then 'high' when runtime_signals >= 3 then 'medium' when runtime_signals >= 1 then 'low' else 'unknown' end as runtime_level,
        case when no_tests then 'missing' when test_files > 5 then 'strong' when test_files > 0 then 'present' else 'missing' end as test_signal from health_inputs) x"""


@relation
def old_files(d: Spark) -> str:
    return f"select {d.key()}path, {d.sha('content')} as hash from old_corpus"


@relation
def diff(d: Spark) -> str:
    whose = "coalesce(f.repo, o.repo) as repo, " if d.key() else ""
    return f"""select {whose}coalesce(f.path, o.path) as path, case when o.path is null then 'new' when f.path is null then 'deleted' when f.hash <> o.hash then 'modified' else 'same' end as status
      from (select {d.key()}path, hash from {path_facts(d)}) f full outer join old_files o on f.path = o.path{d.same('f', 'o')}"""


@relation
def diff_counts(d: Spark) -> str:
    return f"""select {d.key()}cast(count_if(status = 'new') as bigint) as new_count, cast(count_if(status = 'modified') as bigint) as modified_count, cast(count_if(status = 'deleted') as bigint) as deleted_count from diff{d.group()}"""


@relation
def import_edges(d: Spark) -> str:
    """module -> import, each once."""
    return f"select {X.module_name(d, 'path')} as src, {d.explode('imports')} as dst from files where suf = '.py'"


@relation
def module_tails(d: Spark) -> str:
    return f"select distinct module, k from (select module, {d.explode(_tails(d, 'module'))} as k from (select distinct {X.module_name(d, 'path')} as module from files where suf = '.py') m) x"


def _tails(d: Spark, x: str) -> str:
    """A dotted name and all its dotted tails."""
    parts = d.split(x, r"\.")
    return d.each(d.sequence("1", d.size(parts)), "i", d.join(d.cut(parts, "cast(i as int)", d.size(parts)), "."))


@relation
def degree(d: Spark) -> str:
    """In-degree: imports that name a module or end with it, or that a module ends with; suffixes make this an equality."""
    import_tails = f"select src, dst, {d.explode(_tails(d, 'dst'))} as k from import_edges"
    hits = f"""select distinct src, dst, module from (select i.src, i.dst, m.module from ({import_tails}) i join (select distinct module from module_tails) m on i.k = m.module
      union all select i.src, i.dst, m.module from import_edges i join module_tails m on i.dst = m.k) x"""
    return f"""select m.module, cast(coalesce(i.n, 0) as bigint) as in_degree, cast(coalesce(o.n, 0) as bigint) as out_degree from (select distinct module from module_tails) m
      left join (select module, count(*) as n from ({hits}) h group by module) i on m.module = i.module
      left join (select src, count(*) as n from import_edges group by src) o on m.module = o.src"""


def needed(d: Spark, query: str, given: Collection[str] = ()) -> dict[str, str]:
    """The relations that ``query`` needs, each after those that it needs itself; ``given`` exist as views already."""
    done: dict[str, str] = {}

    def need(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_]+", sql)):
            if word in RELATIONS and word not in done and word not in given and re.search(rf"\b(?:from|join) {word}\b", sql):
                body = RELATIONS[word](d)
                need(body)
                done[word] = body

    need(query)
    return done


def plan(d: Spark, query: str, given: Collection[str] = ()) -> str:
    """``query`` after the relations it needs."""
    once = " materialized" if d.name == "duckdb" else ""
    head = ", ".join(f"{k} as{once} ({v})" for k, v in needed(d, query, given).items())
    return f"with {head} select * from ({query}) the_result" if head else query
