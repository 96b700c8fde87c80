"""Settings of a scan and what surrounds it: loading and checking them, caches, git context, paths that a scan leaves out."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from collections.abc import Mapping
from copy import deepcopy
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import merged

DEFAULTS: dict[str, Any] = {
    "scan_interval_seconds": 300, "important_extensions": [".py", ".js", ".ts", ".go", ".rs", ".md", ".json", ".toml"], "ignore_dirs": [".git", "node_modules", "__pycache__", ".venv"],
    "max_file_size_bytes": 1 << 20, "checkpoint_on_significant_change": True, "auto_suggest": True, "knowledge_base_path": "state/knowledge", "checkpoints_path": "state/checkpoints",
    "reports_path": "reports", "log_file": "state/log", "audit_rules_path": "config/rules.json", "patterns_path": "config/patterns.json",
    "performance_budgets": {"scan_seconds": 5.0, "files": 500, "context_tokens": 4000},
}
BUDGETS = ("tiny", "small", "medium", "large")
TRUE = {"1", "true", "yes", "on", "apply", "run"}


def read_json(path: str, default: Any) -> Any:
    """A file's value; a copy of ``default`` where it is missing or no JSON."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return deepcopy(default)


def write_json(path: str, value: Any) -> Path:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, indent=2, sort_keys=True), encoding="utf-8")
    return target


def load(path: str | None = None, variable: str = "LOAM_CONFIG") -> dict[str, Any]:
    """The defaults, overridden by the file that is given, or that an environment variable names; ValueError lists what is wrong."""
    path = path or os.environ.get(variable)
    config = merged(DEFAULTS, read_json(path, {}) if path else {})
    errors = validate(config)
    if errors:
        raise ValueError("; ".join(errors))
    return config


def validate(config: Mapping[str, Any]) -> list[str]:
    """What is wrong with a configuration: missing keys, types, ranges, list elements, budgets that are no numbers."""
    errors = []
    words = {bool: "true or false", int: "an integer", list: "list", str: "str"}
    for key, value in DEFAULTS.items():
        if key == "performance_budgets":
            continue
        kind = type(value)
        if key not in config:
            errors.append(f"Missing config key: {key}")
        elif not isinstance(config[key], kind) or kind is int and isinstance(config[key], bool):
            errors.append(f"Config key {key} must be {words[kind]}")
        elif kind is int and config[key] < 1:
            errors.append(f"Config key {key} must be >= 1")
        elif kind is list and any(not isinstance(x, str) or not x for x in config[key]):
            errors.append(f"Config key {key} must contain only non-empty strings")
    budgets = config.get("performance_budgets")
    if budgets is not None and not isinstance(budgets, Mapping):
        errors.append("Config key performance_budgets must be an object")
    elif budgets:
        errors += [f"Performance budget {k} must be numeric" for k in ("scan_seconds", "files", "context_tokens") if budgets.get(k) is not None and not isinstance(budgets[k], int | float)]
    return errors


def doctor(spark: SparkSession, config: Mapping[str, Any], root: str, stale: int = 0) -> DataFrame:
    """name, ok, message: the configuration, the folders and files that it names, and whether exported focus files still exist."""
    errors = validate(config)
    rows = [("config", not errors, "; ".join(errors) or "valid"), ("project_dir", Path(root).exists(), root)]
    for key in ("knowledge_base_path", "checkpoints_path"):
        parent = resolved(root, str(config.get(key, ""))).parent
        rows.append((f"{key}_parent", parent.exists(), str(parent)))
    for key in ("reports_path", "audit_rules_path", "patterns_path"):
        there = resolved(root, str(config.get(key, "")))
        rows.append((key, there.exists(), str(there)))
    rows.append(("focus_files", stale == 0, "all focus files exist" if not stale else "focus files are stale or invalid"))
    return spark.createDataFrame(rows, "name string, ok boolean, message string")


def resolved(base: str, path: str) -> Path:
    target = Path(path).expanduser()
    return target if target.is_absolute() else (Path(base) / target).resolve()


def own_paths(config: Mapping[str, Any], root: str, more: list[str] | None = None) -> list[str]:
    """The state files and reports of the tool itself, which its scans leave out."""
    keys = ("knowledge_base_path", "checkpoints_path", "reports_path", "log_file")
    return [str(resolved(root, config[k])) for k in keys] + [str(resolved(root, p)) for p in more or []]


def budget_name(name: str | None, default: str = "small") -> str:
    lowered = (name or "").strip().lower()
    return lowered if lowered in BUDGETS else default


def now() -> str:
    return datetime.now().astimezone().isoformat(timespec="seconds")


def as_bool(value: Any, default: bool = False) -> bool:
    return default if value is None else value if isinstance(value, bool) else str(value).strip().lower() in TRUE


def as_int(value: Any, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def as_list(value: Any) -> list[str]:
    """Its elements, or the parts of a text between commas and line ends; trimmed, without empty ones."""
    parts = value if isinstance(value, list) else re.split(r"[\n,]+", str(value))
    return [str(x).strip() for x in parts if str(x).strip()]


def file_hash(path: str, block: int = 8192) -> str:
    h = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while part := f.read(block):
                h.update(part)
    except OSError:
        return "unreadable"
    return h.hexdigest()


def without_doctype(xml: Column) -> Column:
    """XML without its document type, which could define entities; for ``from_xml`` or a reader that fails fast."""
    return F.regexp_replace(xml, r"(?is)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", "")


def git_context(root: str, timeout: int = 5) -> dict[str, Any]:
    """enabled, branch (or ``detached``) and dirty of a work tree; only enabled = False elsewhere."""

    def git(*args: str) -> subprocess.CompletedProcess:
        return subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=timeout, check=False)

    try:
        inside = git("rev-parse", "--is-inside-work-tree")
        if inside.returncode or inside.stdout.strip() != "true":
            return {"enabled": False}
        return {"enabled": True, "branch": git("branch", "--show-current").stdout.strip() or "detached", "dirty": bool(git("status", "--short").stdout.strip())}
    except (OSError, subprocess.SubprocessError):
        return {"enabled": False}


def git_source(source: str) -> str:
    """An existing path resolved; any other address as it is."""
    path = Path(source).expanduser()
    return str(path.resolve()) if path.exists() else source
