"""The catalogue: each named analysis as one query over the relations, for either engine."""

from __future__ import annotations

from collections.abc import Callable

from loam.functions import classify as C
from loam.functions import extract as X
from loam.functions import roles as R
from loam.plans.dialect import Spark
from loam.plans.relations import LANGUAGES, case, path_facts

QUERIES: dict[str, Callable[[Spark], str]] = {}
#: Terms of the retrieval queries on the test corpus.
TERMS = ("main", "title", "helper", "vector")
GOAL_BOOST = {"debug": ("test", "error", "exception", "fix", "bug"), "test": ("test", "pytest", "unittest"), "document": ("readme", "docs", "guide"), "review": ("test", "main", "core")}


def query(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
    QUERIES[f.__name__] = f
    return f


def flat(d: Spark, a: str) -> str:
    return d.join(a, ";")


# Facts


@query
def flagship_surfaces(d: Spark) -> str:
    return "select surface, cast(count(*) as bigint) as files, cast(sum(line_count) as bigint) as total_lines, cast(sum(todo_count) as bigint) as todos from files group by surface"


@query
def s6_file_facts(d: Spark) -> str:
    return "select path, size, extension, line_count, hash from files"


@query
def s2_candidates(d: Spark) -> str:
    """Paths outside pruned directories, of wanted extensions, up to a size."""
    pruned = " or ".join(d.has("parts", f"'{x}'") for x in ("vendor", ".git", "node_modules", "__pycache__"))
    return f"select path, size from files where not ({pruned}) and (suf in ('.py', '.md', '.go', '.json') or n = 'makefile') and size <= 1048576"


@query
def s4_ignored_paths(d: Spark) -> str:
    return "select f.path from files f where not exists (select 1 from (select 'docs' as p union all select 'vendor/x') i where f.path = i.p or left(f.path, length(i.p) + 1) = i.p || '/')"


@query
def x1_todo_count(d: Spark) -> str:
    return "select path, todo_count from files"


@query
def x2_x3_code_flags(d: Spark) -> str:
    return "select path, has_main, has_class, has_function from files"


@query
def x4_imports(d: Spark) -> str:
    return f"select path, {flat(d, 'imports')} as imports, import_count from files"


@query
def x6_symbols(d: Spark) -> str:
    return f"select path, {flat(d, 'symbols')} as symbols from files"


@query
def x7_x9_manifests(d: Spark) -> str:
    both = "case when meta_name is not null and meta_description is not null then meta_name || ': ' || meta_description else coalesce(meta_name, meta_description, '') end"
    return f"select path, meta_name, meta_description, left({both}, 160) as summary from files"


@query
def x8_document_quality(d: Spark) -> str:
    return f"select path, doc_title, {flat(d, 'drift')} as drift, {flat(d, 'drift_lines')} as drift_lines, empty_headings from files where suf in ('.md', '.txt') or n = 'readme'"


@query
def x10_strip_html(d: Spark) -> str:
    return f"select page_id, {X.strip_html(d, 'html')} as text from pages"


@query
def x11_strip_markdown(d: Spark) -> str:
    return f"select path, {X.strip_markdown(d, 'doc_title')} as title from files where doc_title is not null"


@query
def x13_token_estimate(d: Spark) -> str:
    return f"select doc_id, cast({X.tokens(d, 'text')} as bigint) as tokens from documents"


@query
def x15_path_parts(d: Spark) -> str:
    return f"select path, n as name, st as stem, suf as suffix, cast({d.size('parts')} as bigint) as depth from files"


@query
def x18_module_names(d: Spark) -> str:
    return f"select path, {X.module_name(d, 'path')} as module from files where suf = '.py'"


@query
def x20_term_scores(d: Spark) -> str:
    return "select path, " + ", ".join(f"cast({X.term_score(d, 'bare', t)} as bigint) as {t}_score" for t in TERMS) + " from files"


# Classification


@query
def c1_classify_file(d: Spark) -> str:
    return "select path, role, surface from files"


@query
def c5_large_file_policy(d: Spark) -> str:
    return f"select path, {C.large_file_policy('role', 'line_count')} as policy from files"


@query
def c6_c10_name_rules(d: Spark) -> str:
    return f"select path, {C.is_generated_name(d, 'n')} as generated_name, {C.is_test_name(d, 'n', 'suf')} as test_name, {C.is_runner_name(d, 'n', 'lp')} as runner_name, {C.is_generator('n', 'lp')} as generator_name from files"


@query
def c12_entry_candidates(d: Spark) -> str:
    return "select path, candidate from files"


@query
def c13_path_context(d: Spark) -> str:
    return "select path, ctx as context from files"


@query
def c14_entry_category(d: Spark) -> str:
    return "select path, category, base_category from files"


@query
def c15_hotspot_group(d: Spark) -> str:
    return "select path, hotspot as bucket from files"


@query
def c17_component_key(d: Spark) -> str:
    return "select path, component from files"


@query
def c22_archetype(d: Spark) -> str:
    return "select * from archetype"


@query
def c23_risk_level(d: Spark) -> str:
    """Scores of health and its parts as levels."""
    scores = "select 'health' as name, score from health union all select 'maintainability', maintainability from health union all select 'documentation', documentation from health"
    return f"select name, score, case when score >= 85 then 'low' when score >= 65 then 'medium' else 'high' end as level from ({scores}) x"


@query
def c25_test_coverage(d: Spark) -> str:
    return "select path, status, test_file from coverage"


# Aggregates


@query
def a1_metrics(d: Spark) -> str:
    return "select total_files, total_lines, total_size_bytes, open_todos, avg_lines_per_file from metrics"


@query
def a1_file_types(d: Spark) -> str:
    return "select extension, cast(count(*) as bigint) as files from files group by extension"


@query
def w2_largest_files(d: Spark) -> str:
    return "select path, line_count, size from files order by line_count desc, size desc, path limit 5"


@query
def a2_todo_categories(d: Spark) -> str:
    return "select bucket, todos from todo_buckets"


@query
def a3_directories(d: Spark) -> str:
    return "select directory from directories"


@query
def p6_special_files(d: Spark) -> str:
    return "select path, is_config_file, is_test_file, is_doc_file from files where is_config_file or is_test_file or is_doc_file"


@query
def a4_scan_coverage(d: Spark) -> str:
    return "select * from scan_coverage"


@query
def a6_components(d: Spark) -> str:
    """With the three longest files and, where a component is not split, its first five symbols; both are ranked before they are gathered."""
    key = f"case when not contains(f.component, '/') and c.n > 3 then {d.join(d.cut(d.split('f.path', '/'), '1', '2'), '/')} else f.component end"
    keyed = f"select f.path, f.line_count, f.symbols, {key} as key, {key} <> f.component as split from files f join (select component, count(*) as n from files where component is not null group by component) c on f.component = c.component"
    named = f"select key, path, i, {d.at('symbols', 'cast(i as int)')} as symbol from (select key, path, symbols, {d.explode(d.sequence('1', d.size('symbols')))} as i from keyed where not split) x"
    return f"""with keyed as ({keyed}) select c.key, c.file_count, c.line_count, coalesce(l.files, '') as longest, coalesce(y.symbols, '') as symbols from kept_components c
      left join (select key, {d.join(d.collect('path', 'k'), ';')} as files from (select key, path, row_number() over (partition by key order by line_count desc, path) as k from keyed) a where k <= 3 group by key) l on c.key = l.key
      left join (select key, {d.join(d.collect('symbol', 'o'), ';')} as symbols from (select key, symbol, row_number() over (partition by key order by path, i) as o from
        (select *, row_number() over (partition by key, symbol order by path, i) as again from ({named}) n) b where again = 1) e where o <= 5 group by key) y on c.key = y.key"""


@query
def c19_component_roles(d: Spark) -> str:
    return R.component_roles(d, "select key from components")


@query
def w5_component_files(d: Spark) -> str:
    return """select component, path, cast(k as bigint) as k from (select component, path, row_number() over (partition by component order by line_count desc, path) as k
      from files where component is not null) x where k <= 3"""


@query
def a7_frameworks(d: Spark) -> str:
    return "select label, tenths from frameworks"


@query
def a7_all_frameworks(d: Spark) -> str:
    """With those that files prove, and Next.js only if they do."""
    return "select label from all_frameworks"


@query
def a8_languages(d: Spark) -> str:
    plain = d.sub("extension", r"^\.+", "")
    return f"select distinct {case('extension', [(k, f"'{v}'") for k, v in LANGUAGES.items()], f"coalesce(nullif({plain}, ''), lower(extension))")} as language from files"


@query
def a9_primary_language(d: Spark) -> str:
    return "select language as primary_language from primary_language"


@query
def w11_language_scores(d: Spark) -> str:
    return "select language, points from language_scores"


@query
def a10_risk_signals(d: Spark) -> str:
    return "select category, cast(n as bigint) as n from signals"


@query
def a11_health(d: Spark) -> str:
    return "select * from health"


@query
def a16_context_tokens(d: Spark) -> str:
    return f"select cast({d.div('sum(size) + 3', '4')} as bigint) as up, cast({d.div('sum(size)', '4')} as bigint) as down from files"


@query
def a19_recommended_budget(d: Spark) -> str:
    return """select case when total_files <= 12 and total_lines <= 1500 then 'tiny' when total_files <= 60 and total_lines <= 10000 then 'small'
      when total_files <= 150 and total_lines <= 30000 then 'medium' else 'large' end as budget, case when total_files >= 5000 or total_lines >= 500000 then 'large' else 'normal' end as mode from metrics"""


# Issues, risks, hotspots


@query
def i1_i7_issues(d: Spark) -> str:
    return "select type, severity, category, file, message from issues"


@query
def i8_coverage_issue(d: Spark) -> str:
    return "select type, severity, category, message from all_issues where type = 'scan_coverage'"


@query
def p9_confirmed_issues(d: Spark) -> str:
    return "select cast(count_if(severity in ('high', 'critical') and type not in ('todo', 'large_file', 'large_file_size', 'doc_code_drift')) as bigint) as confirmed from all_issues"


@query
def sc1_entry_points(d: Spark) -> str:
    return "select path, category, score from entry_points"


@query
def w3_entry_point_order(d: Spark) -> str:
    return "select path, category, score, cast(row_number() over (partition by category order by score desc, path) as bigint) as k from entry_points"


@query
def sc2_file_risks(d: Spark) -> str:
    return "select file, score, level, factors, risk_categories, surface, test_status, test_file from top_risks"


@query
def w7_risk_groups(d: Spark) -> str:
    known = "surface in ('runtime', 'build_tooling', 'generator', 'test_runner', 'test_data', 'documentation', 'specification', 'vendor', 'generated_sdk', 'dependency_lock', 'environment_setup', 'config')"
    return f"""select bucket, file, score, cast(k as bigint) as k from (select bucket, file, score, row_number() over (partition by bucket order by score desc, file) as k
      from (select file, score, case when {known} then surface else 'other' end as bucket from top_risks) x) y where k <= 10"""


@query
def sc3_hotspots(d: Spark) -> str:
    return "select path, bucket, line_count, score from hotspots"


@query
def w8_hotspot_groups(d: Spark) -> str:
    return "select bucket, path, cast(k as bigint) as k from (select bucket, path, row_number() over (partition by bucket order by score desc, line_count desc, path) as k from hotspots) x where k <= 5"


@query
def w9_important_files(d: Spark) -> str:
    return "select rank, path, reason from important_files"


@query
def j2_issue_map(d: Spark) -> str:
    return f"select file, cast(count(*) as bigint) as n, {flat(d, d.collect('type', 'ord'))} as types from file_issues group by file"


# Changes


@query
def j1_snapshot_diff(d: Spark) -> str:
    return "select path, status from diff where status <> 'same'"


@query
def set1_change_counts(d: Spark) -> str:
    return "select new_count, modified_count, deleted_count, new_count >= 1 or modified_count >= 1 or deleted_count >= 1 as significant from diff_counts"


@query
def j7_diff_impact(d: Spark) -> str:
    """Every changed file that has a risk, whatever its rank."""
    return "select c.path, c.status, r.score, r.level from (select path, status from diff where status <> 'same') c join risks r on c.path = r.file"


@query
def a21_alerts(d: Spark) -> str:
    return """select 'health_critical' as alert, score as value from health where score < 55 union all select 'health_low', score from health where score >= 55 and score < 75
      union all select 'many_changes', new_count + modified_count + deleted_count from diff_counts where new_count + modified_count + deleted_count >= 25
      union all select 'high_risks', n from (select cast(count_if(level = 'high') as bigint) as n from top_risks) x where n > 0
      union all select 'scan_coverage', cast(1 as bigint) from scan_coverage where warning <> ''"""


@query
def a20_budget_alerts(d: Spark) -> str:
    return f"select metric, actual, cast(budget as bigint) as budget from (select 'files' as metric, total_files as actual, 500 as budget from metrics union all select 'context_tokens', cast({d.div('total_size_bytes', '4')} as bigint), 4000 from metrics) x where actual > budget"


# Retrieval


def _hay(d: Spark) -> str:
    return f"lower(path || ' ' || summary || ' ' || {d.join('symbols', ' ')} || ' ' || {d.join('imports', ' ')})"


def _ranked(d: Spark, goal: str, limit: int) -> str:
    terms = " + ".join(X.term_score(d, "hay", t) for t in TERMS)
    boost = " + ".join(f"case when contains(hay, '{t}') then 1 else 0 end" for t in GOAL_BOOST[goal])
    return f"""select path, line_count, cast(s + case when has_main then 1 else 0 end + case when has_function or has_class then 1 else 0 end as bigint) as score
      from (select *, {terms} + {boost} as s from (select *, {_hay(d)} as hay from files) x) y where s > 0 order by score desc, line_count, path limit {limit}"""


@query
def r1_retrieve_files(d: Spark) -> str:
    return f"select path, score, cast(row_number() over (order by score desc, line_count, path) as bigint) as k from ({_ranked(d, 'review', 20)}) z"


@query
def x19_query_terms(d: Spark) -> str:
    stop = "('a', 'an', 'and', 'are', 'for', 'from', 'how', 'implemented', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'what', 'where', 'which', 'who', 'why', 'with')"
    words = d.extract_all("lower(text)", "([a-zA-Z0-9_]+)")
    return f"select conv_id, turn, {d.join(d.filter(words, 'w', f'length(w) > 1 and w not in {stop}'), ' ')} as terms from conversations where role = 'user'"


# Graph


@query
def a12_import_edges(d: Spark) -> str:
    return "select src, dst from import_edges"


@query
def a13_degree(d: Spark) -> str:
    return "select module, in_degree, out_degree from degree"


@query
def w15_degree_ranking(d: Spark) -> str:
    return "select module, in_degree, out_degree from degree order by in_degree + out_degree desc, in_degree desc, module limit 25"


@query
def j10_test_relationships(d: Spark) -> str:
    return f"""select t.path as test, s.module from (select path, {d.sub(d.sub('st', '^test_', ''), '_test$', '')} as k from files where suf = '.py' and is_test_file) t
      join (select st, max({X.module_name(d, 'path')}) as module from files where suf = '.py' and not is_test_file group by st) s on t.k = s.st"""


def related_tests_sql(d: Spark) -> str:
    """Tests below tests/ to run for new and modified Python files: changed ones, those of a changed stem, and those whose text holds one.

    A stem of letters, digits and underscores lies within one such word of the text, so holding it is an equality with one of the
    parts, of the stems' lengths, of the tests' distinct words. Other stems are few; they are looked for in the texts.
    """
    stems = "select distinct f.st, f.path from files f join (select path from diff where status in ('modified', 'new')) c on f.path = c.path where f.suf = '.py' and f.st <> ''"
    tests = f"select path, {d.sub(d.sub('st', '^test_', ''), '_test$', '')} as k from files where suf = '.py' and left(path, 6) = 'tests/' and left(n, 4) = 'test'"
    words = f"select distinct t.path, {d.explode(d.split('lower(c.content)', '[^a-z0-9_]+'))} as w from t join corpus c on t.path = c.path"
    starts = d.explode(d.sequence("1", "length(w) - n + 1"))
    parts = f"select w, substr(w, cast(i as int), cast(n as int)) as k from (select w, n, {starts} as i from (select distinct w from held) a join (select distinct length(st) as n from plain) b on length(a.w) >= b.n) c"
    return f"""with stems as ({stems}), t as ({tests}), plain as (select distinct st from stems where {d.match('st', '^[a-z0-9_]+$')}), held as ({words})
      select path from stems where left(path, 6) = 'tests/' union select t.path from t join stems s on t.k = s.st
      union select h.path from held h join (select distinct p.w from ({parts}) p join plain s on p.k = s.st) m on h.w = m.w
      union select t.path from t join corpus c on t.path = c.path join (select distinct st from stems where not {d.match('st', '^[a-z0-9_]+$')}) o on contains(lower(c.content), o.st)"""


@query
def j13_test_candidates(d: Spark) -> str:
    return "select path, test, candidate from test_candidates"


@query
def j19_dependency_manifests(d: Spark) -> str:
    return """select kind, max(path) as path from (select case when n in ('requirements.txt', 'pyproject.toml', 'setup.py') then 'python' when n = 'package.json' then 'node'
      when n in ('dockerfile', 'docker-compose.yml') then 'containers' end as kind, path from files) x where kind is not null group by kind"""


# Predicates and projections of single steps


@query
def c26_c29_path_predicates(d: Spark) -> str:
    weak = X.any_in("bare", ("/assets/", "/asset/", "/static/", "/docs/", "/docs_src/", "/examples/", "/example/", "/samples/", "/sample/"))
    ignored = " or ".join(d.has("parts", f"'{x}'") for x in (".git", ".venv", "venv", "__pycache__", "node_modules", "dist", "build"))
    return f"""select path, {d.match('path', r'\.(py|js|ts|cpp|c|h|hpp)$')} as testable, {weak} as weak_entry, {d.has('parts', "'tests'")} or {X.begins('n', 'test_')} or {X.ends('n', '_test.py')} as graph_test,
      {ignored} as graph_ignored from files"""


@query
def p1_risk_eligible(d: Spark) -> str:
    return "select path from scored"


@query
def p2_hotspot_eligible(d: Spark) -> str:
    return "select path, bucket from hotspots"


@query
def p3_p4_patterns(d: Spark) -> str:
    """Names of the rules of a table that hold, each compiled to one condition."""
    return "select ord, name, description from patterns"


@query
def p7_entry_predicate(d: Spark) -> str:
    return "select path, is_entry from files"


@query
def x5_summary(d: Spark) -> str:
    return "select path, summary from files"


@query
def x12_bad_identity(d: Spark) -> str:
    """Of each page's first line."""
    return f"select page_id, {X.bad_identity(d, 'v')} as bad from (select page_id, {d.at(X.lines(d, 'html'), '1')} as v from pages) x"


@query
def p5_valid_titles(d: Spark) -> str:
    """Titles of documents and pages that may name a project."""
    heads = f"select 'page ' || page_id as id, left({X.strip_html(d, d.at(X.lines(d, 'html'), '1'))}, 80) as title from pages union all select path, {X.strip_markdown(d, X.strip_html(d, 'doc_title'))} from files where doc_title is not null"
    return f"select id, title from ({heads}) x where {X.valid_title(d, 'title')}"


# Joins and rankings that reports are made of


@query
def j6_changed_risks(d: Spark) -> str:
    return "select c.path, r.score, r.level from (select path from diff where status in ('new', 'modified')) c join risks r on c.path = r.file"


@query
def j9_evidence(d: Spark) -> str:
    """The fifteen riskiest files with the first five of their issues."""
    return f"""select r.file, r.score, f.line_count, {d.join(d.slice(d.collect('i.type', 'i.ord'), 5), ';')} as issues from (select file, score from risks order by score desc, file limit 15) r
      join files f on r.file = f.path join file_issues i on r.file = i.file group by r.file, r.score, f.line_count"""


@query
def j14_test_commands(d: Spark) -> str:
    """How to test each suggestion's files: tests of their stems, else the first ones; other languages' tests by their own runner."""
    stems = f"select distinct rank, {d.sub(X.name('path'), r'[.]py$', '')} as stem from (select rank, {d.explode('focus')} as path from suggestions) f where right(path, 3) = '.py'"
    tests = f"select path, {d.sub(d.sub(X.name('path'), '^test_', ''), r'[.]py$', '')} as stem, right(path, 3) = '.py' as py from files where is_test_file"
    four = lambda source, by: f"select {by}, {d.join(d.collect('path', 'k'), ' ')} as files from (select {by}, path, row_number() over (partition by {by} order by path) as k from {source}) q where k <= 4 group by {by}"
    return f"""with t as ({tests}), s as ({stems}), m as (select s.rank, t.path, t.py from s join t on s.stem = t.stem), near as ({four('(select rank, path from m where py) z', 'rank')}), first as ({four('(select 1 as one, path from t where py) z', 'one')})
      select r.rank, case when a.rank is not null and n.files is not null then 'python -m pytest ' || n.files when a.rank is not null and o.rank is not null or a.rank is null and f.files is null then 'Run the project''s native test runner for the affected test files.'
        when f.files is not null then 'python -m pytest ' || f.files else 'Run the project''s native test runner.' end as command
      from suggestions r left join (select distinct rank from s) a on r.rank = a.rank left join near n on r.rank = n.rank left join (select distinct rank from m) o on r.rank = o.rank left join first f on f.one = 1 where exists (select 1 from t)"""


@query
def j16_selected_edges(d: Spark) -> str:
    return f"""select src, dst from (select e.src, e.dst from import_edges e join (select {X.module_name(d, 'path')} as module from (select path from files where suf = '.py' order by line_count desc, path limit 8) s) m
      on e.src = m.module order by e.src, e.dst limit 10) x"""


@query
def a5_directory_coverage(d: Spark) -> str:
    return "select directory, scanned, actual, ratio, under from directory_coverage"


@query
def a17_architecture(d: Spark) -> str:
    """One row of lists; each is cut to its first fifty, a view of the relations that hold them whole."""
    some = lambda what, source, order: f"(select {d.join(d.collect('v', 'o'), ';')} from (select {what} as v, row_number() over (order by {order}) as o from {source}) q where o <= 50)"
    language = case("extension", [(k, f"'{v}'") for k, v in LANGUAGES.items()], f"coalesce(nullif({d.sub('extension', r'^[.]+', '')}, ''), lower(extension))")
    return f"""select 'corpus' as root_dir, {some('language', f'(select distinct {language} as language from files) l', 'language')} as languages, {some('directory', 'directories', 'directory')} as directories,
      {some('path', 'entry_points', 'category_rank, score desc, path')} as entry_points, {some('path', 'files where is_config_file', 'path')} as config_files, {some('path', 'files where is_doc_file', 'path')} as documentation_files,
      {some('name', 'patterns', 'ord')} as patterns"""


@query
def a18_llm_readiness(d: Spark) -> str:
    return "select budget, full_tokens, compact_tokens, saved_percent, focus_files from llm_readiness"


@query
def a22_confidence(d: Spark) -> str:
    return "select aspect, level, reason from confidence"


@query
def a23_insight(d: Spark) -> str:
    return "select insight from insight"


@query
def a14_project_summary(d: Spark) -> str:
    """One row; the history is that of the ``events`` table."""
    types = f"(select {d.join(d.collect("extension || '=' || n", 'extension'), ';')} from (select coalesce(nullif(extension, ''), 'unknown') as extension, count(*) as n from files group by 1) t)"
    return f"""select m.total_files, m.total_lines, {types} as file_types, (select count(*) from all_issues where severity <> 'resolved') as open_issues, (select count(*) from patterns) as patterns_found,
      u.project_name, u.project_type, p.language as primary_language, (select title from suggestions where rank = 1) as top_suggestion, l.saved_percent, (select count(*) from (select event_id from events order by ts desc, event_id desc limit 100) e) as history,
      (select max(event_id) from events where ts = (select max(ts) from events)) as last_event from metrics m cross join understanding u cross join primary_language p cross join llm_readiness l"""


@query
def a25_release_checks(d: Spark) -> str:
    """The checks that files decide: ord, name, ok, message."""
    has = lambda c: f"coalesce(bool_or({c}), false)"
    version = d.extract("c.content", r"version\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]")
    return f"""with f as (select {has("path = 'README.md'")} as readme, {has("lower(path) in ('license', 'license.md')")} as license, {has("path = 'setup.py'")} as setup, {has(X.begins('path', 'tests/'))} as tests from {path_facts(d)}),
      v as (select coalesce(max({version}), '') as version from corpus c where c.path = 'setup.py')
      select 1 as ord, 'README' as name, readme as ok, 'README.md' as message from f union all select 2, 'LICENSE', license, 'license file present' from f union all select 3, 'package metadata', setup, 'setup.py' from f
      union all select 4, 'version', version <> '', case when version = '' then 'version not found' else version end from v union all select 5, 'tests', tests, 'tests directory present' from f"""


@query
def x21_setup_versions(d: Spark) -> str:
    version = d.extract("content", r"version\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]")
    return f"select path, {version} as version from corpus where right(path, 8) = 'setup.py'"


@query
def sc8_project_identity(d: Spark) -> str:
    return "select project_name, description from identity"


@query
def sc7_project_type(d: Spark) -> str:
    return "select project_type from project_type"


@query
def sc9_purpose(d: Spark) -> str:
    return "select purpose from purpose"


@query
def sc10_sc11_understanding(d: Spark) -> str:
    return "select project_name, project_type, purpose, summary, description from understanding"


@query
def sc10_page_names(d: Spark) -> str:
    """The identity gate on pages: a title's first sentence, four words of a long one, or the page's number."""
    clean = X.strip_markdown(d, X.strip_html(d, d.at(X.lines(d, "html"), "1")))
    words = d.split("t", r"\s+")
    short = f"case when contains(t, '.') and right(t, 1) <> '.' and not contains(t, '/') then trim(split_part(t, '.', 1)) else t end"
    return f"""select page_id, case when {X.bad_identity(d, 't')} then 'page ' || page_id when length({short}) <= 48 then {short} when {d.size(words)} > 4 then {d.join(d.slice(words, 4), ' ')} else 'page ' || page_id end as name
      from (select page_id, {clean} as t from pages) x"""


@query
def w10_workflow_hints(d: Spark) -> str:
    return "select ord, hint from workflow_hints"


# Suggestions


@query
def sg_suggestions(d: Spark) -> str:
    """All that the rules say, before they are ranked."""
    return f"select cast(ord as bigint) as rule, category, priority, title, reason, action, {flat(d, 'focus')} as focus, surface_confidence from raw_suggestions"


@query
def w16_sc6_ranked_suggestions(d: Spark) -> str:
    return f"select rank, category, priority, title, impact, effort, label, uncertainty, confidence, evidence, {flat(d, 'focus')} as focus from suggestions"


@query
def w21_top_suggestion(d: Spark) -> str:
    return "select title, action, priority from suggestions where rank = 1"


@query
def sg13_prompts(d: Spark) -> str:
    """What to ask for: the action and the files to look at."""
    return f"select rank, action || case when {d.size('focus')} = 0 then '.' else ': ' || {d.join('focus', ', ')} || '.' end as prompt from suggestions"


@query
def sg15_objectives(d: Spark) -> str:
    return "select goal, objective from objectives"


@query
def sg16_deliverables(d: Spark) -> str:
    return "select goal, ord, text from deliverables"


@query
def w18_o10_contexts(d: Spark) -> str:
    """The compact context of each budget, as text."""
    return "select budget, text from contexts"


@query
def o3_o4_lines(d: Spark) -> str:
    """The compact line and the brief of a scan, without its duration."""
    compact = "'health=' || score || '% files=' || total_files || ' lines=' || total_lines || ' changes=+' || new_count || '/~' || modified_count || '/-' || deleted_count || coalesce(chr(10) || 'next=[' || priority || '] ' || title || chr(10) || 'rank=' || label || ' impact=' || impact || ' effort=' || effort || ' confidence=' || confidence, '')"
    brief = "'health=' || score || '% files=' || total_files || ' review_signals=' || signals || coalesce(chr(10) || 'next: [' || priority || '] ' || title || chr(10) || 'why: ' || reason || chr(10) || 'do: ' || action || chr(10) || 'rank: ' || label || ' | impact=' || impact || ' effort=' || effort || ' confidence=' || confidence, '') || chr(10) || 'type: ' || project_type"
    return f"""select {compact} as compact, {brief} as brief from health cross join (select total_files, total_lines from metrics) m cross join diff_counts cross join (select count(*) as signals from all_issues) i
      cross join (select project_type from understanding) u left join (select * from suggestions where rank = 1) s on s.rank = 1"""


@query
def o14_status(d: Spark) -> str:
    return "select total_files, total_lines, score as health, new_count, modified_count, deleted_count from metrics cross join (select score from health) h cross join diff_counts"


@query
def sg2_modified_without_tests(d: Spark) -> str:
    return f"select c.path from (select path from diff where status = 'modified') c join {path_facts(d)} f on c.path = f.path where {d.match('c.path', r'\.(py|js|ts|cpp|c|h|hpp)$')} and not contains(f.bare, 'test')"


@query
def w17_focus_files(d: Spark) -> str:
    """For each budget: the top suggestion's files, important ones (of the runtime first), modified and new ones, each once."""
    top = f"select {d.at('focus', 'cast(i as int)')} as path, 1 as source, i as ord from (select focus, {d.explode(d.sequence('1', d.size('focus')))} as i from suggestions where rank = 1) t"
    changed = lambda s, n: f"select path, {n}, o from (select path, row_number() over (order by path) as o from diff where status = '{s}') c where o <= 10"
    api = "(contains(i.path, 'api/') or contains(i.path, 'core/')) and (select primary_archetype from archetype) = 'framework_library'"
    every = f"""{top} union all select i.path, case when {api} then 2 when f.surface = 'runtime' then 3 else 4 end, i.rank from important_files i join files f on i.path = f.path
      union all {changed('modified', 5)} union all {changed('new', 6)}"""
    limits = "select 'tiny' as budget, 4 as most union all select 'small', 6 union all select 'medium', 8 union all select 'large', 10"
    return f"""select budget, path, cast(k as bigint) as k from (select path, row_number() over (order by source, ord, path) as k from (
      select *, row_number() over (partition by path order by source, ord) as again from ({every}) e) x where again = 1) y join ({limits}) l on y.k <= l.most"""


# Small functions, each over a table's rows


@query
def c4_role_labels(d: Spark) -> str:
    """A role as words."""
    return "select distinct role, replace(role, '_', ' ') as label from files"


@query
def c16_runtime_names(d: Spark) -> str:
    """Files whose names mark runtime code that is no entry point."""
    return f"select path, st in ({', '.join(repr(x) for x in C.RUNTIME_NAMES)}) and n <> 'build.rs' as runtime_name from files"


@query
def c21_under_package_root(d: Spark) -> str:
    return f"select path, {d.at('parts', '1')} in ('packages', 'apps', 'services', 'crates', 'modules', 'libs') as packaged from files"


@query
def x17_extensions(d: Spark) -> str:
    """What a fact record says of an extension wins over the path's suffix."""
    return "select path, lower(coalesce(nullif(case when line_count % 2 = 0 then extension else '' end, ''), suf)) as ext from files"


@query
def x22_budget_names(d: Spark) -> str:
    words = f"select distinct {d.at(d.split('text', ' '), '1')} as word from conversations"
    return f"select word, case when lower(trim(word)) in ('tiny', 'small', 'medium', 'large') then lower(trim(word)) else 'small' end as budget from ({words} union all select ' Large ' union all select 'TINY' union all select '') w"


@query
def x26_coercions(d: Spark) -> str:
    """Texts as booleans, numbers and lists."""
    parts = d.filter(d.each(d.split("v", r"[\n,]+"), "p", "trim(p)"), "p", "p <> ''")
    some = "select text as v from conversations union all select ' Yes ' union all select '12' union all select 'a, b,,c' union all select 'off'"
    return f"select distinct v, lower(trim(v)) in ('1', 'true', 'yes', 'on', 'apply', 'run') as as_bool, coalesce(try_cast(trim(v) as int), 7) as as_int, {d.join(parts, ';')} as as_list from ({some}) x"


@query
def s10_text_hashes(d: Spark) -> str:
    return f"select doc_id, {d.sha("coalesce(text, '')")} as hash from documents"


@query
def s17_repository_names(d: Spark) -> str:
    tail = d.sub(d.sub("url", "/+$", ""), r"^.*[/:]", "")
    return f"select page_id, coalesce(nullif({d.sub(d.sub(d.sub(tail, r'\.git$', ''), '[^A-Za-z0-9_.-]+', '-'), '^[-.]+|[-.]+$', '')}, ''), 'repository') as name from pages"


@query
def a12_graph_totals(d: Spark) -> str:
    return "select count(distinct src) as modules, cast(count(*) as bigint) as imports from import_edges"


@query
def p11_workspace_paths(d: Spark) -> str:
    """Paths seen from above a scanned folder."""
    p = "trim(path)"
    return f"select path, case when {p} = '' or left({p}, 1) = '/' or {p} = 'src' or left({p}, 4) = 'src/' then {p} else 'src/' || {p} end as scoped from files"


@query
def p13_json(d: Spark) -> str:
    """A result as JSON with sorted keys."""
    return """select '{"deleted": ' || deleted_count || ', "files": ' || total_files || ', "health": ' || score || ', "lines": ' || total_lines || ', "modified": ' || modified_count || ', "new": ' || new_count || '}' as result
      from metrics cross join (select score from health) h cross join diff_counts"""


@query
def set3_unique_symbols(d: Spark) -> str:
    """Trimmed, without empty ones, each once, in their first order."""
    padded = d.each(d.concat("symbols", "imports", "symbols"), "s", "' ' || s || ' '")
    return f"select path, {d.join(d.distinct(d.filter(d.each(padded, 's', 'trim(s)'), 's', "s <> ''")), ';')} as words from files"


@query
def set5_factors_ignoring_case(d: Spark) -> str:
    """The first of each factor, whatever its case."""
    both = d.concat(d.split("factors", ";"), d.each(d.split("factors", ";"), "f", "upper(f)"))
    lowered = d.each("b", "f", "lower(trim(f))")
    return f"select file, {d.join(d.distinct(lowered), ';')} as factors from (select file, {both} as b from top_risks) x"


@query
def set6_suggestions_once(d: Spark) -> str:
    """Titles and actions of all rules, twice over, each once."""
    return "select title, action, cast(min(ord) as bigint) as first_rule from (select * from raw_suggestions union all select * from raw_suggestions) x group by title, action"


@query
def set7_patterns_once(d: Spark) -> str:
    return "select distinct name, description from (select * from patterns union all select * from patterns) x"


@query
def st12_scan_event(d: Spark) -> str:
    return """select score as health_score, total_files as files_scanned, new_count, modified_count, deleted_count, title as top_suggestion from health cross join (select total_files from metrics) m
      cross join diff_counts left join (select title from suggestions where rank = 1) s on true"""


@query
def st14_savings(d: Spark) -> str:
    """Totals over all events; only the newest fifty are listed."""
    events = f"select conv_id, turn, {X.tokens(d, 'text')} as full_tokens, least({X.tokens(d, 'text')}, 20) as emitted, row_number() over (order by conv_id desc, turn desc) as k from conversations"
    return f"select e.conv_id, e.turn, cast(e.full_tokens as bigint) as full_tokens, cast(e.emitted as bigint) as emitted, t.total_full, t.total_emitted from ({events}) e cross join (select cast(sum(full_tokens) as bigint) as total_full, cast(sum(emitted) as bigint) as total_emitted from ({events}) a) t where k <= 50"


@query
def st15_normal_suggestions(d: Spark) -> str:
    return "select title, priority, category, reason, action, impact, effort, label, confidence from suggestions"


@query
def st18_timeline(d: Spark) -> str:
    """The newest twenty events, oldest first."""
    return "select cast(row_number() over (order by ts, event_id) as bigint) as k, event_id, event_type from (select * from events order by ts desc, event_id desc limit 20) x"


# Event logs


@query
def w20_last_events(d: Spark) -> str:
    """Retention: the newest 100 events of each type."""
    return "select event_id, event_type from (select event_id, event_type, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) x where k <= 100"


@query
def w19_task_memory(d: Spark) -> str:
    return "select conv_id, turn, role from (select *, row_number() over (partition by role order by conv_id desc, turn desc) as k from conversations) x where k <= 20"


@query
def a15_savings(d: Spark) -> str:
    """Tokens of a language's texts against those of their plain beginnings, each line of the summary as emitted."""
    full, part = X.tokens(d, "text"), X.tokens(d, f"coalesce({d.at(X.lines(d, 'text'), '1')}, '')")
    return f"""select lang, full_tokens, emitted, greatest(0, full_tokens - emitted) as saved, case when full_tokens <= 0 then 0.0 else greatest(0.0, {d.half_even('100 * (1 - cast(emitted as double) / full_tokens)')}) end as percent from (
      select lang, cast(sum({full}) as bigint) as full_tokens, cast(sum({part}) as bigint) as emitted from documents group by lang) x"""


@query
def a24_per_source_benchmark(d: Spark) -> str:
    """Facts by top directory, as the built-in benchmark has them by fixture."""
    return f"select {d.at('parts', '1')} as repo, cast(count(*) as bigint) as files, cast(sum(line_count) as bigint) as total_lines, cast(sum(todo_count) as bigint) as todos from files group by 1"


@query
def st12_daily_health(d: Spark) -> str:
    day = "cast(ts as date)"
    return f"select {d.text(day)} as day, event_type, cast(count(*) as bigint) as n, cast(count(distinct user_id) as bigint) as users from events group by 1, 2"

