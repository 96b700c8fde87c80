"""What a project is and what to do next: one-row relations of its identity, type and purpose, and the suggestion rules."""

from __future__ import annotations

from loam.functions import extract as X
from loam.functions import roles as R

from .dialect import Spark
from .relations import REPO_OF, DISPLAY, FIRST_PARTY, case, listed, relation

#: The corpus's own name; an engine may be given another one.
ROOT = "corpus"
# Names of well-known repositories by folder name.
KNOWN = {
    "tensorflow": "TensorFlow", "ollama": "Ollama", "ladybird": "Ladybird", "rust": "Rust", "llvm": "LLVM", "llvm-project": "LLVM", "fastapi": "FastAPI",
    "kubernetes": "Kubernetes", "k8s.io": "Kubernetes", "flask": "Flask", "django": "Django", "spring": "Spring", "react": "React", "next.js": "Next.js",
    "pytorch": "PyTorch", "numpy": "NumPy", "pandas": "Pandas", "scikit-learn": "scikit-learn", "home-assistant": "Home Assistant",
    "home-assistant.io": "Home Assistant", "vite": "Vite", "express": "Express", "tailwindcss": "Tailwind CSS",
}
# Manifests in order of reliability, greetings that tell nothing, marks of markup, directories that a scan should reach.
MANIFESTS = ("Cargo.toml", "pyproject.toml", "package.json", "setup.py", "go.mod", "CMakeLists.txt")
GREETINGS = ("welcome to", "welcome!", "hello!", "hi there", "getting started", "this project is", "the project is", "this repository", "the repository")
MARKUP = ("cmake_minimum_required", "project(", "cmake ", "<p ", "<p>", "<img ", "<div ", "</", "[![", "![", "<!--")
LOW_SIGNAL = ("readme", "sample project", "application logic, application logic, application logic", "application logic", "----", "---")
EXPECTED_DIRS = ("Libraries/LibWeb", "Libraries/LibJS", "AK", "Meta", "src", "Source", "Services", "UI", "app", "cmd", "api", "server", "llama", "ml")
NO_PURPOSE = "Purpose could not be confidently inferred from README."
# How many of each a context of a budget lists.
BUDGETS = {
    "tiny": {"components": 3, "files": 4, "issues": 3, "patterns": 3, "suggestions": 1, "directories": 4, "decisions": 2, "frameworks": 4},
    "small": {"components": 5, "files": 6, "issues": 4, "patterns": 5, "suggestions": 2, "directories": 6, "decisions": 3, "frameworks": 6},
    "medium": {"components": 7, "files": 8, "issues": 6, "patterns": 8, "suggestions": 3, "directories": 10, "decisions": 5, "frameworks": 8},
    "large": {"components": 10, "files": 12, "issues": 10, "patterns": 12, "suggestions": 5, "directories": 16, "decisions": 8, "frameworks": 12},
}
# Pattern rules. All keys but the first three restrict one file that must meet them together.
PATTERNS = (
    {"name": "automated_tests", "description": "The project includes automated tests", "path_contains_any": ["tests/", "test_", "_test."], "extension_in": [".py", ".js", ".ts", ".go"]},
    {"name": "documentation", "description": "The project includes markdown documentation", "path_contains_any": ["readme.md", "docs/"], "extension_in": [".md"]},
    {"name": "command_line_interface", "description": "The project exposes a command-line entry point", "requires_main": True, "extension_in": [".py", ".js", ".ts", ".sh", ".bash"]},
    {"name": "containerization", "description": "The project includes container-related assets", "file_name_in": ["dockerfile", "docker-compose.yml", "docker-compose.yaml"]},
    {"name": "packaging", "description": "The project includes package or dependency manifests", "file_name_in": ["requirements.txt", "pyproject.toml", "setup.py", "package.json"]},
)


def text_of(values, sep: str, d: Spark) -> str:
    """The non-null ones of SQL values, joined."""
    return d.join(d.filter(d.array(*values), "v", "v is not null"), sep)


def pattern_condition(d: Spark, rule: dict) -> str:
    """Whether some file meets a pattern's file conditions together and its directories exist, over all files."""
    one = []
    if rule.get("extension_in"):
        one.append(f"lower(extension) in {listed(x.lower() for x in rule['extension_in'])}")
    if rule.get("file_name_in"):
        one.append(f"n in {listed(x.lower() for x in rule['file_name_in'])}")
    if rule.get("path_contains_any"):
        one.append(X.any_in("bare", [x.lower() for x in rule["path_contains_any"]]))
    if rule.get("requires_main"):
        one.append("has_main")
    if rule.get("import_contains_any"):
        parts = X.any_in("lower(i)", [x.lower() for x in rule["import_contains_any"]])
        one.append(f"{d.size(d.filter('imports', 'i', parts))} > 0")
    scoped = any(k in rule for k in ("extension_in", "file_name_in", "path_contains_any", "requires_main", "import_contains_any"))
    out = [f"coalesce(bool_or({' and '.join(one) or 'true'}), false)"] if scoped else []
    out += [f"coalesce(bool_or({d.size('parts')} > 1 and {d.at('parts', '1')} = '{x.lower()}'), false)" for x in rule.get("requires_directories", ())]
    return "(" + (" and ".join(out) or "true") + ")"


def patterns_sql(d: Spark, rules=PATTERNS) -> str:
    """ord, name, description of the rules that hold; one aggregate over the files for all of them."""
    text = lambda k, missing: d.array(*[d.lit(str(r.get(k, missing))) for r in rules])
    holds = f"select {d.array(*[pattern_condition(d, r) for r in rules])} as p from files"
    each = f"select p, {d.explode(d.sequence('1', str(len(rules))))} as i from ({holds}) x"
    return f"""select cast(i - 1 as int) as ord, {d.at(text('name', 'unnamed_pattern'), 'cast(i as int)')} as name, {d.at(text('description', ''), 'cast(i as int)')} as description
      from ({each}) y where {d.at('p', 'cast(i as int)')}"""


@relation
def patterns(d: Spark) -> str:
    return patterns_sql(d)


@relation
def listing(d: Spark) -> str:
    """All paths there are, scanned or not; the test corpus has some that no scan takes."""
    whose = f"{REPO_OF.replace('d %', 'doc_id %')} as repo, " if d.key() else ""
    return f"select {d.key()}path from corpus union all select {whose}'api/skipped' || doc_id || '.bin' as path from documents union all select {whose}'server/skipped' || doc_id || '.bin' as path from documents where doc_id % 2 = 0"


@relation
def directories(d: Spark) -> str:
    return f"select distinct {d.key()}{d.sub('path', '/[^/]*$', '')} as directory from files where contains(path, '/') and not {d.match('path', r'(^|/)\.[^/]*/')}"


@relation
def directory_coverage(d: Spark) -> str:
    """Of the directories that a scan should reach: files there are, files scanned."""
    parts = d.split("path", "/")
    key = f"case when {d.at(parts, '1')} = 'Libraries' then {d.join(d.cut(parts, '1', '2'), '/')} else {d.at(parts, '1')} end"
    counted = lambda t: f"select {d.key()}{key} as directory, count(*) as n from {t} where contains(path, '/') group by {d.key() and '1, '}{2 if d.key() else 1}"
    return f"""select {d.key()}directory, scanned, actual, {d.half_even('cast(scanned as double) / actual', 3)} as ratio, actual >= 100 and scanned < 0.25 * actual as under, {case('directory', [(x, i) for i, x in enumerate(EXPECTED_DIRS)])} as ord
      from (select {d.key('l')}l.directory, cast(coalesce(f.n, 0) as bigint) as scanned, cast(l.n as bigint) as actual from ({counted('listing')}) l left join ({counted('files')}) f on l.directory = f.directory{d.same('l', 'f')}
      where l.directory in {listed(EXPECTED_DIRS)}) x"""


@relation
def coverage_warning(d: Spark) -> str:
    """The first of five warnings that holds, else an empty text."""
    under = f"coalesce({d.join(d.slice(d.collect('directory', 'ord'), 4), ', ')}, '')"
    dirs = f"(select {d.key()}{under} as dirs from directory_coverage where under{d.group()}) u"
    module = f"(select {d.key()}coalesce(bool_or(path = 'go.mod'), false) as go_mod from listing{d.group()}) l"
    go = f"(select {d.key()}coalesce(bool_or(suf = '.go'), false) as go_files, coalesce(bool_or({X.name('path')} = 'go.mod'), false) as go_mod_scanned from files{d.group()}) g"
    shares = f"""(select {d.key()}total, cast(tests_lines as double) / total as test_share, cast(source_lines as double) / total as source_share from
        (select *, greatest(1, source_lines + tests_lines + tooling_lines + documentation_lines + environment_lines + data_lines) as total from category_lines) z) c"""
    return f"""select {d.key()}case when go_mod and not go_files then 'Scan coverage note: Go module detected (go.mod) but no Go source files scanned. Expected Go source directories like cmd/, api/, server/ may be excluded.'
      when go_mod and not go_mod_scanned then 'Scan coverage note: go.mod exists but was not included in the scan. Results may be affected by extension filtering.'
      when dirs <> '' then 'Scan coverage note: expected directories ' || dirs || ' are below previous baseline.'
      when test_share >= 0.7 and source_share <= 0.2 and source_share > 0 then 'Scan coverage note: tests represent a large share of scanned lines while source directories are lightly represented.'
      when source_share = 0 and total > 100 then 'Scan coverage note: no first-party source lines detected; all scanned content appears to be tests, data, or tooling.' else '' end as warning
      from {shares} {d.paired('c', dirs)} {d.paired('c', module)} {d.paired('c', go)}"""


@relation
def primary_language(d: Spark) -> str:
    """The language of most points, joined by the second one if it has 30 % of its points."""
    shown = lambda x: case(x, [(k, f"'{v}'") for k, v in DISPLAY.items()], x)
    ranked = f"(select *, row_number() over ({d.over()}order by points desc, language) as k from language_scores) x"
    return f"""select {d.key()}coalesce(max(case when k = 1 then case when second is not null then {shown('language')} || '/' || {shown('second')} else language end end), 'unknown') as language from (
      select {d.key('a')}a.k, a.language, case when b.points >= a.points * 0.30 then b.language end as second from (select * from {ranked} where k = 1) a left join (select * from {ranked} where k = 2) b on a.k + 1 = b.k{d.same('a', 'b')}) y{d.group()}"""


@relation
def all_frameworks(d: Spark) -> str:
    """Labels found by imports, and those that files prove; Next.js needs such proof."""
    deps = r"\x22(?:dependencies|devDependencies)\x22\s*:\s*\{[^}]*\x22next\x22\s*:"
    proof = f"""select coalesce(bool_or({X.begins('n', 'next.config')} or {X.begins('bare', 'pages/', 'app/')}), false) or exists (select 1 from corpus c where c.path = 'package.json' and {d.match('c.content', deps)}) as nextjs,
      coalesce(bool_or({X.ends('path', 'pyproject.toml')}), false) as python_packaging, coalesce(bool_or({X.ends('path', 'Cargo.toml', '.rs')}), false) as rust_tooling,
      coalesce(bool_or({X.name('path')} = 'CMakeLists.txt'), false) as cmake_build, coalesce(bool_or(contains(bare, 'tests/') or {X.begins('n', 'test_')}), false) as test_suite from files"""
    flags = ("nextjs", "python_packaging", "rust_tooling", "cmake_build", "test_suite")
    return f"select label from frameworks where label <> 'nextjs' union " + " union ".join(f"select '{f}' from ({proof}) p where {f}" for f in flags)


@relation
def entry_firsts(d: Spark) -> str:
    """The best entry point of some categories, and how many there are."""
    best = lambda cond: f"max(case when {cond} then path end)"
    order = "category_rank, score desc, path"
    three = f"select path, row_number() over (order by {order}) as every from (select * from entry_points order by {order} limit 3) e"
    return f"""select {best("category = 'runtime' and k = 1")} as runtime, coalesce({best("category = 'build' and k = 1")}, {best("category = 'generator' and k = 1")}) as build,
      {best("category = 'environment' and k = 1")} as environment, count(*) as entries, {"(select path from (" + three + ") t where every = 1)"} as first, {"(select path from (" + three + ") t where every = 2)"} as second, {"(select path from (" + three + ") t where every = 3)"} as third
      from (select *, row_number() over (partition by category order by score desc, path) as k from entry_points) x"""


@relation
def readme(d: Spark) -> str:
    """The root README, README.md first."""
    return f"""select f.summary, f.doc_title, {X.lines(d, 'c.content')} as rows from (select path, summary, doc_title from files where path in ('README.md', 'readme.md') order by path limit 1) f
      join corpus c on f.path = c.path"""


@relation
def identity(d: Spark) -> str:
    """project_name and description: known folder name, manifests, README title, folder name; what manifests or the README say."""
    rank = case("path", [(p, i) for i, p in enumerate(MANIFESTS)])
    known = case(f"lower('{ROOT}')", [(k, f"'{v}'") for k, v in KNOWN.items()])
    raw = "trim(meta_name)"
    named = f"case when ({X.begins(raw, '@', 'com.')}) and contains({raw}, '/') then split_part({raw}, '/', -1) else {raw} end"
    manifest = lambda what, cond: f"(select {what} from files where {rank} is not null and {cond} order by {rank} limit 1)"
    title = X.strip_markdown(d, X.strip_html(d, "doc_title"))
    summary = X.plain_text(d, "summary")
    return f"""select case when known is not null and known <> '{ROOT}' then known else coalesce(nullif(manifest, ''), title, known, '{ROOT}') end as project_name,
      coalesce(manifest_description, summary, '') as description from (select {known} as known, {manifest(named, f"{raw} <> ''")} as manifest,
      {manifest('meta_description', f"meta_description is not null and not {X.bad_identity(d, 'meta_description')}")} as manifest_description,
      (select max({title}) from readme where {X.valid_title(d, title)}) as title, (select max({summary}) from readme where not {X.bad_identity(d, summary)}) as summary) x"""


@relation
def project_type(d: Spark) -> str:
    """What kind of project it is, as a phrase of parts."""
    has = lambda c: f"coalesce(bool_or({c}), false)"
    second = d.at("parts", "2")
    subdirs = ", ".join(f"{has(f'{second} = {x!r}')} as d_{x}" for x in ("core", "python", "compiler", "lite", "runtime", "api", "go", "java", "c", "cc", "tools"))
    ml = "(cast(d_python as int) + cast(d_compiler as int) + cast(d_lite as int) + cast(d_core as int) >= 2)"
    some = "(" + " + ".join(f"cast(d_{x} as int)" for x in ("core", "python", "compiler", "lite", "runtime", "api", "go", "java", "c", "cc", "tools")) + " >= 2)"
    names = case("suf", [(k, f"'{v}'") for k, v in {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".rs": "Rust", ".go": "Go", ".cpp": "C++", ".c": "C", ".cc": "C++", ".java": "Java", ".kt": "Kotlin"}.items()], "substr(suf, 2)")
    code = ".py .js .ts .rs .go .cpp .c .h .hpp .cc .java .kt .rb .cs".split()
    most = "machine learning framework with compiler, runtime, API, and extensive test infrastructure"
    first = f"""case archetype when 'browser_engine' then 'C++ browser engine / web browser project' when 'desktop_app' then case when ts then 'TypeScript/Tauri desktop app' else 'Desktop application' end
      when 'cli_server' then case when language = 'go' then 'Go-based CLI/server application' else 'CLI/server application' end when 'monorepo' then 'Monorepo'
      when 'framework_library' then case when {ml} and d_python and d_core then language || ' {most}' when {ml} or {some} then 'mixed-language framework with compiler, runtime, API, and test infrastructure'
        when language = 'c++' then 'C++ framework/library' when language = 'go' then 'Go framework/library' when language <> 'unknown' then language || ' framework/library' else 'Framework/library' end
      when 'app' then case when {ml} and d_python and d_core then language || ' {most}' when {ml} then language || ' framework with compiler, runtime, API, and test infrastructure'
        when language <> 'unknown' then language || ' application' else 'Application' end
      else case when language <> 'unknown' then language || ' project' else 'Software project' end end"""
    joined = f"extensions >= 2 and names <= 3 and language <> 'unknown' and archetype not in ('browser_engine', 'desktop_app')"
    engine = "archetype not in ('browser_engine', 'desktop_app')"
    parts = [
        f"case when {joined} and archetype <> 'framework_library' then joined || ' project' else first end", f"case when {joined} and archetype = 'framework_library' then 'multi-language: ' || joined end",
        "case when python_tooling or rust_tooling then 'with ' || case when python_tooling and rust_tooling then 'Python/Rust' when python_tooling then 'Python' else 'Rust' end || ' tooling' end",
        "case when service then 'with a service/API layer' end", "case when dashboard then 'with an operator dashboard' end",
    ]
    last = [
        "case when js_tests and libweb then 'and a large JavaScript/Web Platform test suite' when has_tests and not contains(lower(head), 'test infrastructure') and not contains(lower(head), 'test suite') then 'with extensive test infrastructure' end",
        f"case when {engine} and frontend and backend then 'with frontend and backend components' when {engine} and frontend then 'with frontend components' when {engine} and backend then 'with backend components' end",
    ]
    return f"""select {text_of(['head', *last], ' ', d)} as project_type from (select *, {text_of(parts, ' ', d)} as head from (select *, {first} as first from (
      select {subdirs}, {has("right(path, 3) = '.ts'")} as ts, {has("is_test_file and " + X.begins('path', 'Tests/LibJS', 'Tests/LibWeb'))} as js_tests, {has('is_test_file')} as has_tests,
        count(distinct case when suf in {listed(code)} then suf end) as extensions from files) f
      cross join (select count(*) as names, {d.join(d.collect('name', 'name'), '/')} as joined from (select distinct {names} as name from files where suf in {listed(code)}) n) l
      cross join (select {has("label = 'python_packaging'")} or exists (select 1 from entry_points where left(path, 5) = 'Meta/') as python_tooling, {has("label = 'rust_tooling'")} as rust_tooling,
        {has("label in ('fastapi', 'flask', 'django')")} as service from all_frameworks) w
      cross join (select {has("contains(lower(key), 'dashboard')")} as dashboard, {has("lower(key) = 'libraries/libweb'")} as libweb, {has("lower(key) in ('src', 'ui', 'web', 'frontend', 'app/ui')")} as frontend,
        {has("lower(key) in ('src-tauri', 'api', 'backend', 'server')")} as backend from kept_components) k
      cross join (select primary_archetype as archetype from archetype) a cross join primary_language p) x) y"""


@relation
def core_roles(d: Spark) -> str:
    """What the main components but tests and documents are for, largest first."""
    return f"""select k, role from (select c.key, r.role, row_number() over (order by c.line_count desc, c.file_count desc, c.key) as k
      from kept_components c join ({R.component_roles(d, 'select key from kept_components')}) r on c.key = r.key where c.key not in ('tests', 'docs')) x"""


@relation
def purpose(d: Spark) -> str:
    """The first of: the description, the README's first real line, its summary, its title's second half, known components, roles."""
    ended = lambda x: d.sub(x, r"\.+$", "") + " || '.'"
    greets = lambda x: X.begins(f"lower({x})", *GREETINGS)
    desc = X.plain_text(d, "description")
    desc = f"case when {d.match(desc, r'^[-_=~*#.]+$')} or {X.any_in(f'lower({desc})', MARKUP)} then '' else {desc} end"
    line = f"{d.sub(X.strip_html(d, 'trim(l)'), X.LINK, '$1')}"
    good = f"""length(trim(l)) >= 20 and not {d.match('trim(l)', r'^[#<!`\-|\[]')} and not {X.any_in('lower(l)', ('http://', 'https://', 'src=', 'badge', 'sponsor', 'donate'))}
      and length({line}) >= 20 and not {X.bad_identity(d, line)} and not contains(lower(l), 'application logic') and not {greets(line)}"""
    body = f"(select max({ended(f'trim({d.sub(X.strip_html(d, "trim(b)"), X.LINK, "$1")})')}) from (select {d.at(d.filter('rows', 'l', good), '1')} as b from readme) r where b is not null)"
    s = X.plain_text(d, "summary")
    summary = f"""(select max({ended(s)}) from readme where summary <> '' and {s} not in ('', '---', '----', '---.', '----.') and not {X.any_in(f'lower({s})', MARKUP)} and lower({s}) <> 'readme'
      and not contains(lower({s}), 'application logic') and not {greets(s)})"""
    title = X.strip_markdown(d, X.strip_html(d, "doc_title"))
    tail = f"trim(coalesce(nullif({d.extract(title, r'^[^:]+:\s*(.+)$')}, ''), {d.extract(title, r'^[^—–-]+[—–-]\s*(.+)$')}))"
    titled = f"(select max({ended(tail)}) from readme where doc_title is not null and not {X.bad_identity(d, title)} and length({tail}) >= 15 and not {X.bad_identity(d, tail)})"
    roles = "select k, role from core_roles where k <= 4 and not contains(lower(role), 'application logic') and not contains(lower(role), 'unknown')"
    names = d.collect("role", "k")
    organized = f"""(select case when count(*) = 0 then null when count(*) = 1 then 'It is organized around ' || max(role) || '.'
      else 'It is organized around ' || {d.join(d.slice(names, 'cast(count(*) - 1 as int)'), ', ')} || ', and ' || {d.at(names, 'cast(count(*) as int)')} || '.' end from ({roles}) q)"""
    built = """(select case when react and rust then ' Built with React frontend and Rust backend.' when react then ' Built with React frontend.' when rust then ' Built with Rust backend.' else '' end
      from (select coalesce(bool_or(contains(lower(role), 'react')), false) as react, coalesce(bool_or(contains(lower(role), 'rust')), false) as rust from core_roles) q)"""
    web = "(select count(distinct lower(key)) from kept_components where lower(key) in ('libraries/libweb', 'libraries/libjs')) = 2"
    low = listed(LOW_SIGNAL)
    return f"""select case when described <> '' and lower(described) not in {low} and contains(lower(described), 'application logic') then '{NO_PURPOSE}'
      when described <> '' and lower(described) not in {low} and not {greets('described')} then {ended('described')}
      else coalesce({body}, {summary}, {titled}, case when {web} then 'Browser engine and web platform runtime with build tooling and extensive standards tests.' end, {organized} || {built}, '{NO_PURPOSE}') end as purpose
      from (select {desc} as described from identity) x"""


@relation
def understanding(d: Spark) -> str:
    """One row: name, type, purpose and summary, each through the same last gate against markup and filler."""
    clean = lambda x: X.strip_markdown(d, X.strip_html(d, x))
    known = case("lower(n0)", [(k, f"'{v}'") for k, v in KNOWN.items()], "n0")
    short = f"""case when contains(n1, '.') and right(n1, 1) <> '.' then case when contains(n1, '/') then n1 else trim(split_part(n1, '.', 1)) end
      when right(n1, 1) = '.' and trim(left(n1, length(n1) - 1)) <> '' and not {X.bad_identity(d, 'left(n1, length(n1) - 1)')} then trim(left(n1, length(n1) - 1)) else n1 end"""
    words = d.split("n2", r"\s+")
    cut = f"case when length(n2) <= 48 then n2 when {d.size(words)} > 4 then {d.join(d.slice(words, 4), ' ')} else '{ROOT}' end"
    bad = lambda x: X.bad_identity(d, x)
    return f"""select project_name, cleaned_type as project_type, cleaned_purpose as purpose, case when not {bad('cleaned_summary')} then cleaned_summary else project_name || ' appears to be ' || cleaned_type || '.'
        || case when contains(lower(cleaned_purpose), 'confidently inferred') then '' else ' ' || cleaned_purpose end end as summary, raw_name, description from (
      select *, {cut} as project_name from (select *, {short} as n2 from (select *, {known} as n1 from (
        select case when {bad(clean('project_name'))} then '{ROOT}' else {clean('project_name')} end as n0, case when {bad(clean('project_type'))} then 'Software project' else {clean('project_type')} end as cleaned_type,
          case when {bad(clean('purpose'))} then '{NO_PURPOSE}' else {clean('purpose')} end as cleaned_purpose, {clean("project_name || ' appears to be ' || project_type || '. ' || purpose")} as cleaned_summary,
          project_name as raw_name, {X.strip_html(d, 'description')} as description from identity cross join project_type cross join purpose) a) b) c) e"""


@relation
def confidence(d: Spark) -> str:
    """aspect, level, reason: of the language, the entry points, the identity and the risks."""
    counted = f"""select count_if(ctx in {listed(FIRST_PARTY)} and {X.one_of('suf', X.C_FAMILY)}) as cpp, count_if(ctx in ('test', 'test_data') and suf in ('.js', '.ts')) as js from files"""
    return f"""select 'language' as aspect, 'high' as level, 'Primary language detected: ' || language || case when lower(language) in ('c++', 'c') and cpp > 10 then '; C++ dominates first-party source directories'
        when lower(language) = 'javascript' and js > 0 then '; JavaScript appears mostly in tests and fixtures' else '' end as reason from primary_language cross join ({counted}) c
      union all select 'entry_points', case when runtime is not null then 'high' else 'medium' end, case when runtime is not null then 'Runtime entry points detected from source files such as ' || runtime
        when build is not null then 'No clear runtime entry point detected; build or generator entry points start at ' || build else 'No explicit entry points found, inferred from source structure' end from entry_firsts
      union all select 'identity', 'high', 'Project name: ' || project_name from identity union all select 'risk', 'high', 'Risk assessment based on file structure and issues'"""


@relation
def workflow_hints(d: Spark) -> str:
    """ord, hint: the first five that hold."""
    has = lambda c: f"coalesce(bool_or({c}), false)"
    inside = lambda *w: has(" or ".join(f"contains(lower(directory), '{x}')" for x in w))
    dirs = f"select {inside('api')} as api, {inside('core', 'runtime')} as core, {inside('compiler')} as compiler, {inside('lite', 'mobile')} as lite, {inside('go')} as go, {inside('tools', 'build')} as tools from directories"
    parts = d.split("directory", "/")
    packages = f"""select {d.join(d.collect('p', 'p'), ', ')} as packages from (select distinct {d.at(parts, '2')} as p from directories where contains(directory, '/')
      and lower({d.at(parts, '1')}) in ('packages', 'apps', 'services', 'crates') order by p limit 4) q"""
    marks = f"""select {has('is_test_file')} as has_tests, {has("contains(path, 'pytest')")} or exists (select 1 from all_frameworks where label = 'pytest') as pytest,
      {has("path in ('pyproject.toml', 'package.json', 'setup.py')")} as manifest, {has("path in ('README.md', 'readme.md')")} as has_readme, {has(f"{X.name('path')} = 'go.mod'")} as go_mod from files"""
    fw = "archetype = 'framework_library'"
    hints = [
        f"""case when {fw} then 'Framework/library repo detected. Choose the relevant API/runtime surface before editing.' when archetype = 'monorepo' then 'Monorepo: split by product/package first.'
          when archetype = 'browser_engine' then 'Browser engine: start from the real runtime/browser entry point.' when runtime is not null then 'Start runtime tracing from ' || runtime || ' (primary detected runtime entry point)'
          when build is not null then 'Start build or generator tracing from ' || build end""",
        f"case when {fw} and api then 'For API changes, start from the API layer.' end", f"case when {fw} and core then 'For runtime/core changes, start from the runtime/core directories.' end",
        f"case when {fw} and compiler then 'For compiler/lowering changes, start from the compiler directories.' end", f"case when {fw} and lite then 'For mobile/lite runtime changes, start from the lite/mobile directories.' end",
        f"case when {fw} and go then 'For Go bindings/tools, start from the go/ directory.' end", f"case when {fw} and tools then 'For tooling/build changes, start from the tools/build directories.' end",
        "case when archetype = 'monorepo' and coalesce(packages, '') <> '' then 'Packages detected: ' || packages end",
        "case when has_tests then case when pytest then 'Use the test suite as the fastest regression signal' else 'Use existing tests before making wide changes' end end",
        "case when manifest then 'Read the project manifest before changing dependencies or startup flow' end", "case when has_readme then 'Use the README as the first source of product intent' end",
        "case when go_mod then 'This is a Go project — look for cmd/, api/, and server/ for entry points' end", "case when environment is not null then 'Environment setup lives in ' || environment end",
    ]
    source = f"(select primary_archetype as archetype from archetype) a cross join entry_firsts e cross join ({dirs}) f cross join ({packages}) p cross join ({marks}) m"
    rows = " union all ".join(f"select {i} as ord, {h} as hint from w" for i, h in enumerate(hints))
    return f"select cast(row_number() over (order by ord) as bigint) as ord, hint from (with w as (select * from {source}) {rows}) x where hint is not null order by ord limit 5"


@relation
def primary_hotspots(d: Spark) -> str:
    """The first five of the runtime hotspots and then the build ones: rank, path."""
    top = "select *, row_number() over (partition by bucket order by score desc, line_count desc, path) as k from hotspots where bucket in ('runtime', 'build_tooling')"
    return f"select cast(row_number() over (order by bucket desc, k) as bigint) as rank, path from ({top}) x where k <= 5 order by rank limit 5"


@relation
def important_files(d: Spark) -> str:
    """rank, path, reason: entry points, project definitions, hotspots and the largest runtime files, each once, at most eight."""
    names = ("README.md", "readme.md", "pyproject.toml", "package.json", "setup.py", "requirements.txt", "go.mod")
    best, first = "bucket desc, score desc, line_count desc, path", "category_rank, score desc, path"
    spots = f"select path, row_number() over (order by {best}) as k from (select * from hotspots where bucket in ('runtime', 'build_tooling') order by {best} limit 4) h"
    entries = f"select path, row_number() over (order by {first}) as ord from (select * from entry_points order by {first} limit 8) e"
    return f"""select cast(row_number() over (order by source, ord, path) as bigint) as rank, path, reason from (select *, row_number() over (partition by path order by source, ord) as again from (
      select 1 as source, ord, path, 'entry point' as reason from ({entries}) a
      union all select 2, {case('path', [(p, i) for i, p in enumerate(names)])}, path, 'project definition' from files where path in {listed(names)}
      union all select 3, k, path, 'high-leverage hotspot' from ({spots}) b
      union all select 4, 0, path, 'high-leverage hotspot' from (select path, hotspot from files order by line_count desc, size desc, path limit 4) c where hotspot = 'runtime') x) y
      where again = 1 order by rank limit 8"""


@relation
def insight(d: Spark) -> str:
    """One sentence: the first of five situations that holds, else a plain one."""
    return """select case when test_signal in ('strong', 'high') and runtime_level in ('high', 'medium') then 'Strong test infrastructure but high runtime complexity — tests are your safety net, but complexity in core paths increases regression risk'
      when open_todos > 100 and high > 0 then open_todos || ' TODO/FIXME markers and ' || high || ' high-risk files suggest accumulated technical debt in critical areas'
      when total_files > 1000 and drift > 10 then 'Large project with ' || drift || ' documentation drift signals — docs may lag behind the actual code in several places'
      when test_signal = 'strong' and runtime_level in ('low', 'unknown') and high = 0 then 'Well-structured project with good test coverage and low hotspot density — ideal for safe, incremental changes'
      when test_signal in ('missing', 'none', 'low') and total_files > 50 then 'Limited test infrastructure for a project of this size — regression risk is higher than necessary'
      else 'Project has ' || total_files || ' files across ' || least(components, 12) || ' main components. Focus on the highest-risk files before broad changes.' end as insight
      from health cross join metrics cross join (select count_if(level = 'high') as high from top_risks) r cross join (select count_if(type = 'doc_code_drift') as drift from all_issues) i
      cross join (select count(*) as components from kept_components) c"""


# Suggestions


@relation
def hot_paths(d: Spark) -> str:
    """The three hottest runtime files, by rank."""
    hot = d.first("path, score, line_count", "from hotspots where bucket = 'runtime'", "score desc, line_count desc, path", 5)
    found = f"select {d.key('x')}x.path, row_number() over ({d.over_of('x')}order by score desc, x.line_count desc, x.path) as k from ({hot}) x join (select {d.key()}path as p, surface from files) f on x.path = f.p{d.same('x', 'f')} where surface = 'runtime'"
    return f"select {d.key()}cast(k as bigint) as rank, path from ({found}) y where k <= 3"


@relation
def trace(d: Spark) -> str:
    """One row: where tracing starts (strong runtime entries, others, build, generator), the hottest files, whether the two fit."""
    weak = lambda x: X.any_in(f"lower({x})", ("/assets/", "/asset/", "/static/", "/docs/", "/docs_src/", "/examples/", "/example/", "/samples/", "/sample/"))
    order = f"case when category = 'runtime' and not {weak('path')} then 0 when category = 'runtime' then 1 when category = 'build' then 2 else 3 end, score desc, path"
    first = d.first("path", "from entry_points where category in ('runtime', 'build', 'generator')", order, 1)
    hot = d.collect("path", "rank")
    entry = f"(select {d.key()}max(path) as entry from ({first}) e{d.group()}) a"
    hottest = f"(select {d.key()}{hot} as hot, {d.join(d.slice(hot, 2), ', ')} as hot2, count(*) as hots, bool_or(not {weak('path')}) as strong from hot_paths{d.group()}) b"
    return f"""select {d.key()}entry, coalesce(hot, {d.no_texts()}) as hot, coalesce(hot2, '') as hot2, coalesce(hots, 0) as hots, archetype,
      case when (entry is null or {weak('coalesce(entry, chr(32))')}) and coalesce(strong, false) then 'low' else 'high' end as surface_confidence
      from (select {d.key()}primary_archetype as archetype from archetype) c {d.paired('c', entry)} {d.paired('c', hottest)}"""


@relation
def test_candidates(d: Spark) -> str:
    """For each modified source file that is testable: the first test file of an expected name, else a path for a new one."""
    stem = d.sub(X.name("c.path"), r"\.py$", "")
    tests = f"select {d.key()}path, {X.name('path')} as name from files where is_test_file"
    return f"""select {d.key('c')}c.path, c.stem, min(t.path) as test, coalesce(min(t.path), 'tests/test_' || c.stem || '.py') as candidate from (
        select {d.key('c')}c.path, {stem} as stem from (select {d.key()}path from diff where status = 'modified') c where not contains(lower(c.path), 'test') and {d.match('lower(c.path)', r'\.(py|js|ts|cpp|c|h|hpp)$')}) c
      left join (select {d.key('t')}t.path, k.stem from ({tests}) t join (select {d.key()}name, {d.sub(d.sub('name', '^test_', ''), r'\.py$', '')} as stem from ({tests}) a where left(name, 5) = 'test_'
        union select {d.key()}name, {d.sub('name', r'_test\.py$', '')} from ({tests}) b where right(name, 8) = '_test.py') k on t.name = k.name{d.same('t', 'k')} where right(t.name, 3) = '.py') t on c.stem = t.stem{d.same('c', 't')} group by {d.key('c')}c.path, c.stem"""


def _first(d: Spark, what: str, source: str, order: str, n: int) -> str:
    """The first values of a column, in order, as an array."""
    return f"coalesce((select {d.collect('v', 'o')} from (select {d.as_r()}{what} as v, row_number() over ({d.over()}order by {order}) as o from {source}) q where o <= {n}{d.mine()}), {d.no_texts()})"


@relation
def raw_suggestions(d: Spark) -> str:
    """What each rule says, in the rules' order: ord, sub, category, priority, title, reason, action, focus, surface_confidence."""
    none = d.no_texts()
    entries = lambda n: _first(d, "path", "entry_points", "category_rank, score desc, path", n)
    issue = lambda t, n, more="": _first(d, "file", f"file_issues where type = '{t}' {more}", "file", n)
    plain = "and not " + X.ends("lower(file)", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg")
    large = f"case when {d.exists('file_issues', f"type = 'large_file' {plain}")} then {issue('large_file', 3, plain)} else {issue('large_file', 3)} end"
    high = "risks where level in ('high', 'medium')"
    risky = _first(d, "file", "top_risks where level in ('high', 'medium')", "score desc, file", 4)
    factors = _first(d, f"file || ' (' || {d.join(d.slice(d.split('factors', ';'), 3), ', ')} || ')'", "top_risks where level in ('high', 'medium')", "score desc, file", 3)
    changed = lambda s, n: _first(d, "path", f"diff where status = '{s}'", "path", n)
    todo = lambda b: d.value("todos", "todo_buckets", f"bucket = '{b}'")
    trace_first = d.concat(d.array("entry"), "hot")
    del high
    rows = [
        f"""select {d.key()}1, '', 'debugging', 'medium', case when archetype = 'framework_library' then 'Map the relevant API/runtime surface before editing' when archetype = 'monorepo' then 'Select the affected package/app/service first, then trace locally'
            when surface_confidence = 'low' and hots > 0 or entry is not null then 'Trace the main execution path before editing' else 'Map runtime hotspots before editing' end,
          case when archetype = 'framework_library' then 'Framework/library repo detected. Relevant surfaces: ' || hot2 when archetype = 'monorepo' then 'Monorepo detected. Local hotspots: ' || hot2
            when surface_confidence = 'low' and hots > 0 then 'Real hotspots detected (' || hot2 || ') but primary runtime entry was uncertain. Use hotspots as the tracing anchor.'
            when entry is null then 'No entry point detected. Focus on the hottest files: ' || hot2 when hots >= 2 then 'Start from ' || entry || ' and trace into ' || hot2 else 'Start from ' || entry || ' and trace into hotspots' end,
          case when archetype = 'framework_library' then 'Map the relevant API/runtime surface before editing' when archetype = 'monorepo' then 'Select the affected package/app/service first, then trace locally'
            when surface_confidence = 'low' and hots > 0 then 'Map the runtime path through current hotspots' when entry is null then 'Analyze hotspots before making changes' else 'Map the runtime path through entry points and current hotspots' end,
          case when archetype in ('framework_library', 'monorepo') or surface_confidence = 'low' and hots > 0 or entry is null then hot else {trace_first} end, surface_confidence
          from trace where archetype in ('framework_library', 'monorepo') or entry is not null or hots > 0""",
        f"select {d.key()}2, '', 'testing', 'high', 'Add tests for your project', 'No test files detected. Tests prevent regressions.', 'Create test files for core functionality', {entries(2)}, 'high' from metrics where not has_tests",
        f"""select {d.key()}2, path, 'testing', 'medium', 'Update tests for ' || path, path || ' changed and may need refreshed test coverage', 'Write or update tests for ' || path,
          case when test is null then {d.array('path')} else {d.array('path', 'test')} end, 'high' from test_candidates""",
        f"""select {d.key()}3, '', 'cleanup', 'medium', 'Prioritise ' || {todo('first_party_source')} || ' first-party source TODO/FIXME markers', 'Total TODOs: ' || open_todos || '. First-party source: ' || {todo('first_party_source')} || '; tooling: ' || {todo('tooling')}
            || '; test/fixture: ' || {todo('tests_fixtures')} || '; documentation: ' || {todo('docs')} || '; vendor/generated: ' || {todo('vendor_generated')} || '.',
          'Review first-party TODOs first, then triage tooling, tests, and documentation separately', {none}, 'high' from metrics where open_todos > 5""",
        f"""select {d.key()}4, '', 'refactoring', 'medium', 'Review ' || n || ' oversized file(s)', 'Large files are maintainability signals, not automatic failures: ' || {d.join('f', ', ')}, 'Map tests and module boundaries before refactoring', f, 'high'
          from (select {d.key()}n, {large} as f from (select {d.key()}count(*) as n from file_issues where type = 'large_file'{d.group()}) w) x where n > 0""",
        f"""select {d.key()}5, '', 'documentation', 'medium', 'Reconcile stale or scaffold-like documentation', 'Documentation drift signals were found in ' || {d.join('f', ', ')}, 'Update docs so they match the current code and remove placeholder claims', f, 'high'
          from (select {d.key()}{issue('doc_code_drift', 4)} as f{d.keys()}) x where {d.size('f')} > 0""",
        f"""select {d.key()}6, '', 'review', 'medium', 'Review highest-risk files before broad changes', 'Risk scoring flagged ' || {d.join('r', '; ')}, 'Inspect high-risk files, map tests, and reduce the riskiest blind spot', f, 'high'
          from (select {d.key()}{risky} as f, {factors} as r{d.keys()}) x where {d.size('f')} > 0""",
        f"select {d.key()}7, '', 'documentation', 'medium', 'Create a README', 'No README found. Documentation helps onboarding and adoption.', 'Write a comprehensive README.md', {entries(3)}, 'high' from metrics where not has_readme",
        f"select {d.key()}8, '', 'structure', 'low', 'Define a clear entry point', 'No main entry point was detected', 'Create or identify the main entry point', {none}, 'high' from metrics where not has_entries and total_files > 3",
        f"""select {d.key()}9, '', case when modified_count > 10 then 'review' else 'integration' end, case when modified_count > 10 then 'medium' else 'low' end, case when modified_count > 10 then 'Review recent batch of changes' else 'Integrate new files' end,
          case when modified_count > 10 then modified_count || ' files changed since the last checkpoint' else 'New files were added: ' || {d.join(changed('new', 5), ', ')} end,
          case when modified_count > 10 then 'Review changes for consistency and correctness' else 'Ensure new files are wired into the project correctly' end,
          case when modified_count > 10 then {changed('modified', 6)} else {changed('new', 5)} end, 'high' from diff_counts where modified_count > 10 or new_count > 0""",
        f"""select {d.key()}10, '', 'setup', 'medium', 'Document or set up dependencies', 'No dependency manifest was detected', 'Create requirements.txt, pyproject.toml, or equivalent', {none}, 'high' from metrics
          where not {d.exists('files', "n in ('requirements.txt', 'pyproject.toml', 'setup.py', 'package.json', 'dockerfile', 'docker-compose.yml')")}""",
        f"""select {d.key()}11, '', 'structure', 'low', 'Improve project structure', 'The project has many files but only a shallow directory structure', 'Organize files into clearer logical directories', {none}, 'high' from metrics
          where total_files > 15 and {d.count('directories')} < 3""",
        f"""select {d.key()}12, '', 'security', 'critical', 'Add .gitignore immediately', '.env file found without .gitignore; secrets may be at risk', 'Create a .gitignore that excludes environment and build artifacts', {_first(d, 'path', "files where contains(path, '.env')", 'path', 1)}, 'high'
          from (select {d.key()}coalesce(bool_or(contains(path, '.env')), false) as e, coalesce(bool_or(contains(path, '.gitignore')), false) as g from files{d.group()}) x where e and not g""",
    ]
    names = f"{d.key()}ord, sub, category, priority, title, reason, action, focus, surface_confidence"
    head = ", ".join(f"{x} as {n}" for x, n in zip(["''"] * bool(d.key()) + ["cast(0 as int)", "''", "''", "''", "''", "''", "''", none, "''"], names.split(", "), strict=True))
    return f"select {names} from (select {head} where false union all " + " union all ".join(rows) + ") x"


@relation
def suggestions(d: Spark) -> str:
    """Each title and action once, with impact, effort, label and confidence; the ten most urgent, in the rules' order on ties."""
    once = f"select *, row_number() over ({d.over('title', 'action')}order by ord, sub) as again from raw_suggestions"
    each = f"(select {d.key()}ord, sub, {d.explode('focus')} as path from once) s"
    hits = f"select {d.key('s')}s.ord, s.sub, count(i.file) as related from {each} join file_issues i on s.path = i.file{d.same('s', 'i')} group by {d.key('s')}s.ord, s.sub"
    known = f"select {d.key('s')}s.ord, s.sub, count(*) as known from {each} join files f on s.path = f.path{d.same('s', 'f')} group by {d.key('s')}s.ord, s.sub"
    impact = "case when priority = 'low' then 'low' when priority in ('critical', 'high') or category in ('security', 'testing') then 'high' else 'medium' end"
    effort = "case when category = 'cleanup' then 'low to triage, high to remediate' when category = 'refactoring' or focused > 5 then 'high' when focused <= 2 then 'low' else 'medium' end"
    label = """case when priority in ('critical', 'high') then 'risky' when impact = 'high' and effort = 'low' then 'quick win' when category in ('architecture', 'refactoring', 'release') then 'strategic'
      when focused = 0 then 'needs user decision' when effort = 'low' then 'quick win' else 'strategic' end"""
    uncertainty = "case when focused > 0 or related > 0 then case when surface_confidence = 'low' then 'medium' else 'low' end else 'medium' end"
    evidence = f"""reason || case when focused > 0 then '; ' || known || '/' || focused || ' focus file(s) known' else '' end || case when related > 0 then '; ' || related || ' related audit issue(s)' else '' end"""
    order = f"{case('priority', [('critical', 4), ('high', 3), ('medium', 2), ('low', 1)], '0')} desc, {case('impact', [('high', 3), ('medium', 2), ('low', 1)], '0')} desc, {case('effort', [('low', 3), ('medium', 2), ('high', 1)], '0')} desc, ord, sub"
    return f"""select * from (select {d.key()}cast(row_number() over ({d.over()}order by {order}) as bigint) as rank, ord, category, priority, title, reason, action, focus, impact, effort, {label} as label, uncertainty,
        case uncertainty when 'low' then 'high' when 'medium' then 'medium' else 'low' end as confidence, surface_confidence, {evidence} as evidence from (
      select *, {impact} as impact, {effort} as effort, {uncertainty} as uncertainty from (
        with once as (select * from ({once}) o where again = 1) select o.*, cast({d.size('o.focus')} as bigint) as focused, case when {d.size('o.focus')} = 0 then {d.count('all_issues')} else coalesce(h.related, 0) end as related, coalesce(w.known, 0) as known
        from once o left join ({hits}) h {d.on('o', 'h', 'ord', 'sub')} left join ({known}) w {d.on('o', 'w', 'ord', 'sub')}) a) b) c where rank <= 10"""


# Context


@relation
def recommended(d: Spark) -> str:
    return """select case when total_files <= 12 and total_lines <= 1500 then 'tiny' when total_files <= 60 and total_lines <= 10000 then 'small'
      when total_files <= 150 and total_lines <= 30000 then 'medium' else 'large' end as budget from metrics"""


@relation
def budgets(d: Spark) -> str:
    """The limits of each budget."""
    return " union all ".join(f"select '{b}' as budget, " + ", ".join(f"{n} as {k}" for k, n in limits.items()) for b, limits in BUDGETS.items())


#: Issues of files first.
ISSUE_ORDER = "case when file is null then 1 else 0 end, file, ord, type"


@relation
def first_issues(d: Spark) -> str:
    """As many as a context lists at most: its limits stand in a join, where Spark does not see them and would number all in one task."""
    return f"select * from all_issues order by {ISSUE_ORDER} limit {max(x['issues'] for x in BUDGETS.values())}"


@relation
def context_lines(d: Spark) -> str:
    """budget, section, ord, line: the compact context of each budget; every list is cut at its budget's limit."""
    top = lambda what, source, order, n: f"(select {d.join(d.collect('v', 'o'), ', ')} from (select {what} as v, row_number() over (order by {order}) as o from {source}) q where o <= {n})"
    one = lambda section, ord_, line, source: f"select budget, {section}, cast({ord_} as bigint), {line} from budgets cross join {source}"
    many = lambda section, limit, line, source: f"select budget, {section}, cast(o as bigint), {line} from budgets join ({source}) s on s.o <= {limit}"
    by_category = [("Runtime Entry Points", "runtime"), ("Build Entry Points", "build"), ("Generator Entry Points", "generator"), ("Environment Setup", "environment")]
    cut = lambda name: f"select {name}, row_number() over (order by"
    first_issues = "first_issues" if d.name == "spark" else "all_issues"
    parts = [
        one(1, 0, "'# Project Knowledge Base'", "(select 1 as z) z"), one(2, 0, "'## Summary'", "(select 1 as z) z"),
        one(2, 1, "'- Project: ' || project_name", "understanding"), one(2, 2, "'- Type: ' || project_type", "understanding"), one(2, 3, "'- Primary Language: ' || language", "primary_language"),
        one(2, 4, "'- Files: ' || total_files", "metrics"), one(2, 5, "'- Total Lines: ' || total_lines", "metrics"), one(2, 6, "'- Review Signals: ' || n", "(select count(*) as n from all_issues) i"),
        one(2, 7, "'- Patterns Found: ' || n", "(select count(*) as n from patterns) p"), one(2, 8, "'- Top Suggestion: ' || title", "(select title from suggestions where rank = 1) s"),
        one(3, 0, "'## Project Understanding'", "(select 1 as z) z"), one(3, 1, "'- Summary: ' || summary", "understanding"), one(3, 2, "'- Purpose: ' || purpose", "understanding"),
        f"select budget, 3, cast(5 as bigint), '- Scan Coverage Warning: ' || warning from budgets cross join coverage_warning where warning <> ''",
        one(4, 0, "'## Main Components'", "(select count(*) as n from kept_components) c where n > 0"),
        many(4, "components", "'- ' || s.key || ': ' || role || ' (' || file_count || ' files / ' || line_count || ' lines)'",
             f"select c.key, c.file_count, c.line_count, r.role, row_number() over (order by c.line_count desc, c.file_count desc, c.key) as o from kept_components c join ({R.component_roles(d, 'select key from kept_components')}) r on c.key = r.key"),
        one(5, 0, "'## Important Files'", "(select count(*) as n from important_files) c where n > 0"), many(5, "files", "'- ' || path || ': ' || reason", "select path, reason, rank as o from important_files"),
        one(6, 0, "'## Architecture'", "(select 1 as z) z"),
        many(9, "issues", "'- [' || severity || '] ' || message || case when file is null then '' else ' (' || file || ')' end", f"{cut('severity, message, file')} {ISSUE_ORDER}) as o from {first_issues}"),
        one(9, 0, "'## Recent Review Signals'", "(select count(*) as n from all_issues) c where n > 0"),
        one(8, 0, "'## Patterns'", "(select count(*) as n from patterns) c where n > 0"), many(8, "patterns", "'- ' || name || ': ' || description", f"{cut('name, description')} ord) as o from patterns"),
        one(10, 0, "'## Suggested Next Move'", "(select count(*) as n from suggestions) c where n > 0"),
        many(10, "suggestions", "'- [' || priority || '] ' || title || ': ' || action || case when budget <> 'tiny' then chr(10) || '  Reason: ' || reason else '' end", "select priority, title, action, reason, rank as o from suggestions"),
    ]
    for limit, section, ord_, label, source, order in (("frameworks", 3, 3, "Frameworks", "(select label as v from all_frameworks) l", "v"), ("frameworks", 3, 4, "Workflow", "(select hint as v, ord from workflow_hints) l", "ord"),
                                               ("files", 6, 1, "Entry Points", "(select path as v, category_rank, score from entry_points) l", "category_rank, score desc, v"),
                                               ("patterns", 6, 6, "Patterns", "(select name as v, ord from patterns) l", "ord"), ("directories", 6, 7, "Directories", "(select directory as v from directories) l", "v")):
        parts += [f"select budget, {section}, cast({ord_} as bigint), '- {label}: ' || t from (select '{b}' as budget, {top('v', source, order, limits[limit])} as t) x where t <> ''" for b, limits in BUDGETS.items()]
    for i, (label, key) in enumerate(by_category):
        parts += [f"select budget, 6, cast({2 + i} as bigint), '- {label}: ' || t from (select '{b}' as budget, {top('path', f"(select path, score from entry_points where category = '{key}') l", 'score desc, path', limits['files'])} as t) x where t <> ''" for b, limits in BUDGETS.items()]
    kinds = [("python", "n in ('requirements.txt', 'pyproject.toml', 'setup.py')"), ("node", "n = 'package.json'"), ("containers", "n in ('dockerfile', 'docker-compose.yml')")]
    for i, (kind, cond) in enumerate(kinds):
        parts.append(f"select budget, 7, cast({1 + i} as bigint), '- {kind}: ' || p from budgets cross join (select max(path) as p from files where {cond}) x where p is not null")
    parts.append(f"select budget, 7, cast(0 as bigint), '## Dependencies' from budgets where exists (select 1 from files where {' or '.join(c for _, c in kinds)})")
    return "select budget, section, ord, line from (select cast('' as " + ("string" if d.name == "spark" else "varchar") + ") as budget, 0 as section, cast(0 as bigint) as ord, '' as line where false union all " + " union all ".join(parts) + ") x"


@relation
def contexts(d: Spark) -> str:
    """budget, text: the sections of a context, an empty line after each."""
    section = f"select budget, section, {d.join(d.collect('line', 'ord'), chr(10))} as text from context_lines group by budget, section"
    return f"select budget, {d.join(d.collect('text', 'section'), chr(10) * 2)} || chr(10) as text from ({section}) x group by budget"


@relation
def llm_readiness(d: Spark) -> str:
    """The budget that fits, tokens of all files and of its context, what that saves, and the files to look at first."""
    focus = """select path, min(o) as o from (select path, rank as o from important_files where rank <= 6 union all select path, 6 + o from (select v as path, o from first_focus) f) x group by path order by o limit 8"""
    first = f"select i as o, {d.at('focus', 'cast(i as int)')} as v from (select focus, {d.explode(d.sequence('1', d.size('focus')))} as i from suggestions where rank = 1) s"
    saved = f"case when full_tokens <= 0 then 0.0 else greatest(0.0, {d.half_even('(1 - cast(compact_tokens as double) / full_tokens) * 100')}) end"
    return f"""select budget, full_tokens, compact_tokens, cast({saved} as bigint) as saved_percent, coalesce(focus_files, '') as focus_files from (
      select r.budget, cast({d.div('m.total_size_bytes + 3', '4')} as bigint) as full_tokens, cast({X.tokens(d, 'c.text')} as bigint) as compact_tokens from recommended r join contexts c on r.budget = c.budget cross join metrics m) t
      cross join (with first_focus as ({first}) select {d.join(d.collect('path', 'o'), ';')} as focus_files from ({focus}) f) g"""


# What each goal asks for, and what its result must have.
OBJECTIVES = {
    "next": "execute the highest-value next engineering step with minimal extra discovery", "debug": "find the most likely root cause and produce the safest fix path",
    "review": "review the architecture, risks, and likely regressions before editing", "plan": "produce a concrete implementation plan grounded in the current codebase",
    "document": "write or improve documentation that matches the real project structure", "test": "improve or repair test coverage around the most important behavior",
}
DELIVERABLES = {
    "next": ["Execute {action}.", "State what you changed and why it is the highest-value move now.", "Verify the result with the narrowest useful checks."],
    "debug": ["Identify the most likely root cause.", "Describe the fix plan before or alongside code changes.", "Verify the fix with focused tests or checks."],
    "review": ["List the highest-risk findings first.", "Call out missing tests, unclear ownership, or brittle areas.", "Recommend the single best next action."],
    "plan": ["Produce a short step-by-step plan with file-level focus.", "Highlight blockers, assumptions, and dependencies.", "Recommend the first implementation slice."],
    "document": ["Summarize the project purpose, architecture, and commands accurately.", "Use the actual entry points and manifests found in the repo.", "Avoid generic documentation filler."],
    "test": ["Target the most important behavior first.", "Add or update focused tests for the changed or risky files.", "Explain what remains untested."],
}
COMMON = ("Explain the reasoning briefly and reference the most relevant files.", "Keep the scope tight and start with the smallest high-leverage change.")


@relation
def objectives(d: Spark) -> str:
    """goal, objective: with the kind of project, the top suggestion's action and the first hotspot."""
    base = case("goal", [(g, f"'{t}'") for g, t in OBJECTIVES.items()])
    goals = " union all ".join(f"select '{g}' as goal" for g in OBJECTIVES)
    prefix = "case when goal = 'next' and archetype = 'framework_library' then 'map the relevant API/runtime surface, then ' when goal = 'next' and archetype = 'monorepo' then 'select the affected package/app/service first, then ' else '' end"
    suffix = f"case when goal = 'next' and action is not null then ': ' || {d.sub('action', r'[.]+$', '')} when goal = 'plan' and hot is not null then '; start from ' || hot else '' end"
    return f"""select goal, {prefix} || {base} || {suffix} as objective from ({goals}) g cross join (select primary_archetype as archetype from archetype) a
      cross join (select max(case when rank = 1 then action end) as action from suggestions) s cross join (select max(case when rank = 1 then path end) as hot from primary_hotspots) h"""


@relation
def deliverables(d: Spark) -> str:
    rows = [(g, i, t.replace("'", "''")) for g, own in DELIVERABLES.items() for i, t in enumerate([*own, *COMMON])]
    every = " union all ".join(f"select '{g}' as goal, cast({i} as bigint) as ord, '{t}' as text" for g, i, t in rows)
    return f"select goal, ord, replace(text, '{{action}}', coalesce(action, 'the recommended next step')) as text from ({every}) x cross join (select max(case when rank = 1 then action end) as action from suggestions) s"

