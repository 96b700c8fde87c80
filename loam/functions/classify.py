"""Classification of paths as CASE chains; the first rule that holds decides."""

from __future__ import annotations

from loam.plans.dialect import Spark

from .extract import any_in, begins, ends, one_of

# Names and directories that decide a file's role.
LOCKFILES = (
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "go.sum", "poetry.lock", "gemfile.lock", "composer.lock",
    "mix.lock", "pipfile.lock",
)
VENDOR_DIRS = ("/vendor/", "/third_party/", "/third-party/", "/node_modules/", "/3rdparty/", "/external/")
SPEC_WORDS = ("spec", "design", "architecture", "adr", "proposal", "rfc")
SOURCE = (
    ".py", ".js", ".ts", ".rs", ".go", ".cpp", ".c", ".h", ".hpp", ".cc", ".cxx", ".hh", ".hxx", ".java", ".kt", ".rb", ".cs",
    ".swift", ".zig", ".scala", ".ex", ".exs", ".ml", ".mli", ".fs", ".fsx",
)
ENTRY_NAMES = (
    "main.rs", "main.go", "main.ts", "index.ts", "index.js", "app.ts", "app.js", "server.ts", "server.js", "main.py", "server.py",
    "app.py", "cli.py", "cli.ts", "main.cpp", "main.cc",
)
MAJOR_BINARIES = ("kube-apiserver", "kubelet", "kube-controller-manager", "kube-scheduler", "kubectl", "kube-proxy", "kubeadm")
MONOREPO = ("packages", "apps", "services", "crates", "modules", "libs")
TWO_LEVEL = (*MONOREPO, "tests", "test", "libraries", "utilities", "ui", "cmd", "api", "server", "infra", "nix")
ONE_LEVEL = (
    "docs", "doc", "documentation", ".devcontainer", "base", "patches", "github", "examples", "example", "samples", "sample",
    "benchmarks", "benchmark", "fuzz", "fuzzers", "fuzzer", "scripts", "tools", "build", "ci", "docker", "containers", "deploy",
    "i18n", "locales", "translations", "vendor", "third_party", "external", "3rdparty", "gen", "generated",
)
SECOND_LEVEL = ("core", "python", "compiler", "lite", "runtime", "api", "go", "java", "cc", "c", "tools", "stream_executor", "tpu")
SHOWN_DIRS = ("/examples/", "/example/", "/samples/", "/sample/", "/demo/", "/demos/", "/assets/", "/asset/", "/static/")
TEST_DIRS = ("/tests/", "/test/", "/e2e/", "/integration/", "/smoke/", "/fixtures/", "/testdata/", "/wpt-import/")
GENERATED_TAILS = (
    "_gen.go", "_generated.go", "_pb2.py", ".pb.go", ".gen.ts", ".generated.ts", ".gen.go", ".generated.go", ".gen.py",
    ".generated.py", ".gen.rs", ".generated.rs", ".gen.java", ".generated.java",
)
# Names of files that runtime code passes through, though it does not start there.
RUNTIME_NAMES = (
    "provider", "providers", "models", "model", "parsing", "parser", "cache", "caching", "session", "sessions", "middleware", "registry", "store", "storage", "database",
    "db", "connection", "service", "services", "handler", "handlers", "config", "configuration", "logging", "logger", "metrics", "telemetry", "plugin", "plugins",
    "extension", "extensions",
)


def is_generated_name(d: Spark, n: str) -> str:
    return f"({ends(n, *GENERATED_TAILS)} or {d.match(n, r'(?:_gen|_generated)\.(?:cc|cpp|cxx|c|h|hpp|hh|py|go|rs)$')})"


def is_test_name(d: Spark, n: str, ext: str) -> str:
    return f"""({d.match(n, r'_test\.(?:go|cc|cpp|cxx|py|rs)$')} or {ext} = '.rs' and ({ends(n, '.tests.rs')} or {n} = 'tests.rs')
      or {any_in(n, ('.test.', '.spec.'))} or {begins(n, 'test_', 'spec_')})"""


def is_runner_name(d: Spark, n: str, lp: str) -> str:
    return f"""({d.match(n, 'test.*runner|runner.*test|import.*test|wpt.*import')}
      or {ends(n, '.sh')} and (contains({n}, 'test') or contains({lp}, 'wpt')) or {any_in(lp, ('/fuzzers/', '/fuzzer/'))})"""


def is_generator(n: str, lp: str) -> str:
    return f"({begins(n, 'generate_', 'gen_')} or {any_in(lp, ('generator', 'codegen', 'genop', 'asmintgen'))})"


def role(d: Spark, lp: str, n: str, ext: str) -> str:
    """``lp``: lower-case path with a leading slash; ``n``: lower-case name."""
    return f"""case
      when {n} = 'build.rs' then 'build_tooling'
      when {one_of(n, LOCKFILES)} or {begins(n, 'requirements')} and {ends(n, '.txt')} or {ends(n, 'requirements.txt')}
        or {begins(n, 'conda-')} and {ends(n, '.lock')} then 'dependency_lock'
      when {any_in(lp, VENDOR_DIRS)} then 'vendor'
      when {any_in(lp, ('/i18n/', '/locales/', '/translations/'))} then 'localization'
      when {any_in(lp, ('/gen/', '/generated/'))} or {is_generated_name(d, n)} then 'generated_sdk'
      when {ext} = '.md' and ({any_in(n, SPEC_WORDS)} or {any_in(lp, ('/specs/', '/adr/', '/spec/'))}) then 'specification'
      when {ext} = '.md' then 'documentation'
      when {any_in(lp, ('/wpt-import/', '/fixtures/', '/testdata/'))} then 'fixture'
      when {any_in(lp, ('/test/', '/tests/', '/e2e/', '/integration/', '/smoke/'))} then
        case when {is_test_name(d, n, ext)} then 'test'
          when {one_of(ext, ('.json', '.txt', '.html', '.css', '.svg', '.xml', '.yaml', '.yml'))} then 'fixture' else 'test_runner' end
      when {is_runner_name(d, n, lp)} then 'test_runner'
      when {is_test_name(d, n, ext)} then 'test'
      when contains({lp}, '/.devcontainer/') then 'environment_setup'
      when {any_in(lp, ('/scripts/', '/script/'))} or {ends(n, '.sh', '.bash')} then 'build_tooling'
      when {is_generator(n, lp)} then 'generator'
      when {begins(n, 'build.', 'configure.', 'install.')} or contains({lp}, '/ci/') then 'build_tooling'
      when contains({lp}, '/meta/') then case when contains({lp}, '/generators/') then 'generator' else 'build_tooling' end
      when {one_of(ext, SOURCE)} then 'source'
      when {one_of(ext, ('.json', '.yaml', '.yml', '.toml', '.ini', '.cfg', '.conf'))} then 'config'
      when {n} in ('cmakelists.txt', 'cmake') or {ext} = '.cmake' then 'build_tooling'
      when {n} in ('dockerfile', 'containerfile') or {begins(n, 'docker-compose')} then 'environment_setup'
      when {n} = 'makefile' then 'build_tooling'
      else 'source' end"""


def surface(r: str) -> str:
    return f"case {r} when 'fixture' then 'test_data' when 'source' then 'runtime' else {r} end"


def is_entry_candidate(d: Spark, lp: str, n: str, st: str) -> str:
    return f"""({one_of(n, ENTRY_NAMES)} or {d.match(lp, r'/cmd/[^/]+/[^/]+\.go$|/cmd/[^/]+/main\.rs$')} or contains({lp}, 'src-tauri/src/main.rs')
      or {st} in ('bootstrap', 'cli') and not {any_in(lp, ('/test/', '/tests/', '/spec/', '/docs/', '/fixtures/', '/examples/'))})"""


def large_file_policy(r: str, lines: str) -> str:
    """What is said of a large file of each role."""
    return f"""case {r}
      when 'dependency_lock' then 'Large dependency/requirements file; review only when dependency generation or upgrade process changes.'
      when 'vendor' then 'Vendor/third-party file; track only, do not refactor by default.'
      when 'localization' then 'Large localization/resource file; large by design. Review only if translation loading, schema, or resource generation changes.'
      when 'generated_sdk' then 'Generated SDK/client file; regenerate from schema/source instead of editing manually.'
      when 'documentation' then 'Large documentation/specification file; review for readability and drift, not source module boundaries.'
      when 'specification' then 'Large documentation/specification file; review for readability and drift, not source module boundaries.'
      when 'config' then 'Large config/data file; validate schema before editing. Do not refactor like source code.'
      when 'build_tooling' then 'File is ' || {lines} || ' lines; build/tooling file. Review if frequently modified.'
      when 'environment_setup' then 'File is ' || {lines} || ' lines; environment/setup file.'
      when 'test' then 'Large test file; review test structure only if frequently edited or flaky.'
      when 'test_runner' then 'Large test file; review test structure only if frequently edited or flaky.'
      when 'fixture' then 'Large test file; review test structure only if frequently edited or flaky.'
      else 'File is ' || {lines} || ' lines; consider reviewing module boundaries' end"""


def part_in(d: Spark, parts: str, names) -> str:
    return "(" + " or ".join(d.has(parts, f"'{x}'") for x in names) + ")"


def context(d: Spark, r: str, lp: str, bare: str, n: str, parts: str) -> str:
    """The finer taxonomy; ``bare`` is the lower-case path as it is, ``parts`` its parts."""
    top, second = d.at(parts, "1"), d.at(parts, "2")
    return f"""case when {r} in ('test', 'test_runner') then 'test' when {r} = 'fixture' then 'test_data'
      when {r} in ('generated_sdk', 'documentation', 'build_tooling', 'generator') then {r}
      when {r} in ('vendor', 'dependency_lock') then 'vendor_generated' when {r} = 'localization' then 'localization_resource'
      when {r} = 'specification' then 'specification_documentation' when {r} = 'environment_setup' then 'environment'
      when {r} = 'config' then 'data_or_config'
      when {any_in(bare, ('wpt-import', 'fixtures'))} then 'test_data'
      when {part_in(d, parts, ('tests', 'test', 'spec'))} then 'test'
      when contains({bare}, '/libraries/libweb/') then 'browser_engine' when contains({bare}, '/libraries/libjs/') then 'javascript_engine'
      when contains({bare}, '/libraries/libmain/') then 'runtime_entry' when contains({bare}, '/libraries/libtest/') then 'test_support'
      when {top} = 'libraries' then 'first_party_source' when {top} = 'ak' then 'core_utility'
      when {top} in ('services', 'ui', 'cmd', 'api', 'server') then 'runtime_source'
      when {top} in ('utilities', 'scripts', 'tools') then case when contains({n}, 'test') and contains({n}, 'runner') then 'test' else 'tooling' end
      when {part_in(d, parts, ('demo-vault', 'demo-vault-v2', 'demo', 'samples', 'examples'))} then 'test_data'
      when {second} = 'python' then 'python_api' when {second} in ('core', 'compiler', 'lite', 'runtime') then 'runtime_source'
      when {second} in ('api', 'go', 'java', 'cc', 'c', 'tools') then 'first_party_source' else 'application' end"""


def entry_category(d: Spark, r: str, bare: str, n: str, st: str, parts: str, has_main: str) -> str:
    top, second = d.at(parts, "1"), d.at(parts, "2")
    parent = d.at(parts, f"{d.size(parts)} - 1")
    return f"""case when {r} in ('test', 'fixture', 'test_runner') then 'test' when {r} in ('generated_sdk', 'generator') then 'generator'
      when {r} = 'build_tooling' then 'build' when {r} = 'environment_setup' then 'environment'
      when {r} in ('documentation', 'specification') then 'documentation' when {r} in ('dependency_lock', 'vendor') then 'build'
      when contains({bare}, '.devcontainer') then 'environment'
      when {part_in(d, parts, ('tests', 'test', 'spec', 'e2e', 'unittests', 'unit'))} or contains({bare}, 'libtest') then 'test'
      when {top} = 'meta' then case when {second} = 'generators' then 'generator' else 'build' end
      when {part_in(d, parts, ('assets', 'asset', 'static', 'docs', 'doc', 'documentation', 'docs_src'))} then 'documentation'
      when {part_in(d, parts, ('examples', 'example', 'samples', 'sample', 'demo', 'demos'))} then 'example'
      when {part_in(d, parts, ('api', 'apis'))} and {r} = 'source' then 'runtime_surface'
      when {n} in ('setup.py', 'package.json', 'pyproject.toml') then 'packaging'
      when {n} = 'build.rs' or {begins(n, 'build.', 'install.')} then 'build'
      when {d.match(bare, r'/tools/.+/main\.(cpp|cc|c)$')} then 'build'
      when {d.match(bare, r'/tools/.+\.(cpp|cc|c)$')} and {begins(n, 'clang', 'llvm-', 'lld', 'llc', 'opt', 'bugpoint')} then 'build'
      when contains({bare}, 'bootstrap/') and {begins(n, 'bootstrap', 'configure')} then 'build'
      when contains({bare}, 'src/tools/') and {n} in ('cargo.rs', 'rustc.rs', 'rustdoc.rs') or contains({bare}, 'src/bootstrap/') then 'build'
      when {top} in ('libraries', 'services', 'ui') then 'runtime'
      when {one_of(n, ("main.rs", "main.go", "main.ts", "index.ts", "index.js", "app.ts", "app.js", "server.ts", "server.js", "main.py", "server.py", "app.py", "cli.py"))} then 'runtime'
      when {d.match(bare, r'/cmd/[^/]+/main\.(go|rs)$')} or contains({bare}, 'src-tauri/src/main.rs') then 'runtime'
      when {part_in(d, parts, ('src', 'source', 'app', 'cmd'))} and {begins(n, 'main.')} then 'runtime'
      when {ends(n, '.go')} and {d.size(parts)} > 2 and {parent} = {st} then 'runtime'
      when {d.match(bare, r'/cmd/[^/]+/[^/]+\.go$')} and {has_main} then 'runtime' else 'tooling' end"""


def entry_score(d: Spark, category: str, st: str, parts: str) -> str:
    """``category`` without knowledge of a main function."""
    parent = d.at(parts, f"{d.size(parts)} - 1")
    has = lambda *names: part_in(d, parts, names)
    points = [
        (has("src", "source", "app", "cmd", "main"), 50),
        (one_of(f"coalesce({parent}, {st})", MAJOR_BINARIES), 80),
        (has("libraries"), 40),
        (has("runtime", "bin", "sbin"), 20),
        (has("tests", "test", "spec"), -50),
        (has("docs", "documentation"), -30),
        (has(".devcontainer", "scripts", "tools"), -20),
        (has("build", "meta", "generators"), -10),
        (has("examples", "example", "samples", "sample", "demo", "demos"), -60),
        (has("assets", "asset", "static"), -80),
    ]
    by = f"""case {category} when 'runtime' then 25 when 'runtime_surface' then 20 when 'example' then -35 when 'build' then 5
      when 'generator' then -15 when 'test' then -45 when 'environment' then -55 when 'packaging' then -5 else 0 end"""
    return f"greatest(0, 100 + {by} + {' + '.join(f'case when {c} then {p} else 0 end' for c, p in points)})"


def hotspot_group(s: str) -> str:
    return f"""case {s} when 'build_tooling' then 'build_tooling' when 'generator' then 'generator' when 'test_runner' then 'test_runner'
      when 'test_data' then 'test_data' when 'test' then 'test_runner' when 'documentation' then 'documentation' when 'vendor' then 'vendor'
      when 'environment_setup' then 'build_tooling' when 'config' then 'build_tooling' else 'runtime' end"""


def component_key(d: Spark, path: str) -> str:
    """The first one or two parts; null for root files and hidden directories (but .devcontainer)."""
    parts = d.split(path, "/")
    top, second = d.at(parts, "1"), d.at(parts, "2")
    hidden = d.match(path, r"(^|/)\.[^/]*/")
    return f"""case when {top} = '.devcontainer' then {top} when {d.size(parts)} < 2 or {hidden} then null
      when {one_of(f'lower({top})', TWO_LEVEL)} then {top} || '/' || {second} when {one_of(f'lower({top})', ONE_LEVEL)} then {top}
      when lower({top}) = 'meta' then case when lower({second}) in ('generators', 'linters', 'cmake') then {top} || '/' || {second} else {top} end
      when {one_of(f'lower({second})', SECOND_LEVEL)} then {top} || '/' || {second} else {top} end"""
