"""What a component is for, by its key."""

from __future__ import annotations

from loam.plans.dialect import Spark

# Roles of well-known directory names.
ROLES = {
    "opencode": "CLI / AI coding agent core", "app": "frontend application", "desktop": "desktop application shell", "console": "console/web app",
    "sdk": "generated SDK/client code", "containers": "container/build tooling", "github": "GitHub integration", "infra": "infrastructure",
    "nix": "Nix/dev environment", "patches": "patches/platform fixes", "e2e": "end-to-end tests", "cmd": "CLI commands", "api": "API layer",
    "server": "server internals", "agent": "AI agent behaviors and coordination", "core": "runtime/core library", "shared": "shared utilities",
    "types": "type definitions", "ui": "user interface components", "mobile": "mobile application", "web": "web application", "cli": "CLI application",
    "utils": "utility modules", "python": "Python API layer", "compiler": "compiler/lowering components", "lite": "lightweight/mobile runtime",
    "c": "C API", "cc": "C++ API", "java": "Java API/bindings", "go": "Go bindings/tools", "tools": "developer/build tooling",
    "examples": "examples/sample apps", "ci": "CI/build infrastructure", "docs": "documentation", "tests": "test suite", "test": "test suite",
    "docker": "container/build environment", "config": "configuration", "scripts": "automation and tooling", "benchmarks": "benchmarks",
    "fuzz": "fuzz testing", "fuzzers": "fuzz testing", "plugins": "plugin system", "extensions": "extension system", "integrations": "integrations",
    "migrations": "database migrations", "seeds": "database seed data", "proto": "protobuf definitions", "graphql": "GraphQL schema/API",
    "grpc": "gRPC service definitions", "openapi": "OpenAPI specification", "specs": "specifications", "spec": "specifications",
    "adr": "architecture decision records", "proposals": "design proposals", "rfcs": "RFC documents", "vendor": "vendor dependency",
    "third_party": "vendor dependency", "external": "vendor dependency", "generated": "generated SDK/client code", "gen": "generated SDK/client code",
    "i18n": "internationalization/localization", "locales": "localization resources", "translations": "translation files",
    "security": "security/policy documentation and review files", "stream_executor": "GPU/accelerator runtime abstraction",
    "dtensor": "distributed tensor computing", "tpu": "TPU runtime and compilation support",
}
# Roles of libraries named Lib*.
LIBRARIES = {
    "compress": "compression and archive codecs", "core": "platform and event-loop utilities", "crypto": "cryptography and certificate handling",
    "database": "database and storage layer", "devtools": "developer tools integration", "diff": "diff and patch utilities",
    "dns": "DNS protocol and resolution", "filesystem": "filesystem abstraction", "gc": "garbage collector infrastructure",
    "gfx": "graphics, fonts, and image codecs", "http": "HTTP networking stack", "idl": "IDL parsing and bindings support",
    "ipc": "interprocess communication", "js": "JavaScript engine code", "line": "command-line editing utilities",
    "main": "runtime entrypoint support", "media": "media playback and container support", "regex": "regular expression engine",
    "requests": "network request orchestration", "syntax": "syntax parsing and highlighting", "test": "test support library",
    "textcodec": "text encoding data and codecs", "threading": "threading and concurrency primitives", "tls": "TLS and secure transport",
    "unicode": "Unicode data and text processing", "url": "URL parsing and canonicalization", "wasm": "WebAssembly runtime and validation",
    "web": "browser engine code", "websocket": "WebSocket protocol support", "webview": "browser embedding and view integration",
    "xml": "XML parsing and DOM support", "imagedecoderclient": "image decoder client bindings",
}


def dimension(rows: dict[str, str]) -> str:
    return "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + ") as t(word, role)"


def component_roles(d: Spark, source: str) -> str:
    """key, role of the rows of ``source`` (column key), by three joins with the small table of names."""
    p = d.split("k", "/")
    return f"""select x.key, coalesce(a.role, case when k in ('demo-vault', 'demo-vault-v2', 'demo', 'samples', 'sample') then 'demo/sample data' when k = 'tests/libweb' then 'test suite / WPT fixtures'
        when k = 'tests/libjs' then 'JavaScript engine tests' when k = 'ak' then 'core utility library'
        when top in ('packages', 'apps', 'services', 'crates', 'modules', 'libs') and sub is not null then coalesce(s.role, case when right(sub, 9) in ('-electron', '_electron') then 'Electron desktop shell'
          when contains(sub, 'desktop') then 'desktop application shell' when right(sub, 4) in ('-app', '_app') then 'frontend application' when right(sub, 7) in ('-server', '_server') then 'server runtime'
          when sub = 'src-tauri' then 'Tauri desktop backend' else sub || ' package' end)
        when k = 'libraries/libcore' then 'platform and event-loop utilities' when k in ('libraries/libgfx', 'libraries/libwasm', 'libraries/libmedia', 'libraries/libwebview', 'libraries/libjs', 'libraries/libweb') then l.role
        when top = 'libraries' and sub is not null then coalesce(w.role, sub || ' library')
        when top = 'tests' and sub is not null then case when left(sub, 6) = 'libweb' then 'test suite / WPT fixtures' when left(sub, 5) = 'libjs' then 'JavaScript engine tests' else 'test suite / test infrastructure' end
        when top in ('third_party', 'vendor', 'external', '3rdparty') and sub is not null then case when s.role is not null then 'bundled ' || s.role else 'bundled ' || sub || ' library/dependency' end
        when left(k, 5) = 'tests' then 'test suite' when left(k, 4) = 'docs' or left(k, 13) = 'documentation' then 'documentation' when left(k, 13) = '.devcontainer' then 'development environment'
        when left(k, 4) = 'meta' then 'build and developer tooling' else coalesce(t.role, 'application logic') end) as role
      from (select key, k, {d.at(p, '1')} as top, {d.at(p, '2')} as sub, {d.at(p, d.size(p))} as tail from (select distinct key, lower(key) as k from ({source}) q) r) x
      left join role_names a on x.k = a.word left join role_names s on x.sub = s.word left join role_names t on x.tail = t.word
      left join library_names l on substr(x.sub, 4) = l.word left join library_names w on x.sub = w.word"""
