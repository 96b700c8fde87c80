"""Symbols, imports and calls of Python modules, read with the standard parser in Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, kind string, name string, qualname string, parent string, line int, end_line int, doc string, target string, ord int"
_COLUMNS = [x.split()[0] for x in ROWS.split(", ")]
_TYPES = [pa.int32() if x.endswith(" int") else pa.string() for x in ROWS.split(", ")]
IGNORED = {".git", "__pycache__", ".venv", "venv", "node_modules", "dist", "build", ".mypy_cache", ".pytest_cache", "site-packages"}


def _called(node: ast.expr) -> str:
    """The dotted name of what is called; a call's result counts as what was called; otherwise empty."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        else:
            break
    if isinstance(node, ast.Name):
        parts.append(node.id)
    elif parts and not isinstance(node, ast.Name):
        pass
    return ".".join(reversed(parts))


def module_of(path: str) -> str:
    """The dotted name of a module's file; a package's own file is the package."""
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def _aliases(node: ast.AST, own: str) -> list[tuple[str, str]]:
    """(local name, dotted target) of an import; of ``import a.b`` the name is ``a.b``. Relative ones are resolved from the module ``own``."""
    if isinstance(node, ast.Import):
        return [(a.asname or a.name, a.name) for a in node.names]
    if not isinstance(node, ast.ImportFrom):
        return []
    above = own.split(".")[: -node.level] if node.level else []
    base = ".".join([*above, *([node.module] if node.module else [])])
    return [(a.asname or a.name, f"{base}.{a.name}" if base else a.name) for a in node.names if a.name != "*"]


def module_rows(path: str, text: str) -> list[tuple]:
    """Rows of kind class, function, async_function, import, alias (a local name and its dotted ``target``), call or error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "error", type(e).__name__, "", "", getattr(e, "lineno", 0) or 0, 0, "", str(e)[:200], 0)]
    out: list[tuple] = []
    seen: set[str] = set()
    own = module_of(path)
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function"}

    def visit(node: ast.AST, scope: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            kind = kinds.get(type(child))
            if kind:
                doc = (ast.get_docstring(child) or "").strip().split("\n")[0][:160]
                out.append((path, kind, child.name, ".".join([*scope, child.name]), ".".join(scope), child.lineno, child.end_lineno or child.lineno, doc, "", len(out)))
                visit(child, [*scope, child.name])
                continue
            if isinstance(child, ast.Call) and scope:
                name = _called(child.func)
                if name:
                    out.append((path, "call", name, ".".join(scope), "", child.lineno, child.lineno, "", name, len(out)))
            for local, target in _aliases(child, own):
                out.append((path, "alias", local, ".".join(scope), "", child.lineno, child.lineno, "", target, len(out)))
            names = [a.name for a in child.names] if isinstance(child, ast.Import) else ["." * child.level + (child.module or "")] if isinstance(child, ast.ImportFrom) else []
            for name in names:
                if name and name not in seen:
                    seen.add(name)
                    out.append((path, "import", name, "", "", child.lineno, child.lineno, "", name, len(out)))
            visit(child, scope)

    visit(tree, [])
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = [r for p, t in zip(rows.column("path").to_pylist(), rows.column("content").to_pylist(), strict=True) for r in module_rows(p, t or "")]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_COLUMNS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _COLUMNS)


def python_sources(corpus: DataFrame) -> DataFrame:
    """The Python files outside ignored folders, with the module that each is."""
    parts = F.split("path", "/")
    return corpus.where(F.col("path").endswith(".py") & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in sorted(IGNORED)]))).withColumn("module", _module())


def python_graph(corpus: DataFrame) -> DataFrame:
    """All rows of the Python files of ``corpus`` (path, content), outside ignored folders."""
    return python_sources(corpus).select("path", "content").mapInArrow(_parse, ROWS)


def _paths(limit: int, depth: int, fan: int):
    def run(edges):
        import pandas as pd

        entry = edges["entry"].iloc[0]
        after: dict[str, list[str]] = {}
        for s, d in zip(edges["src"], edges["dst"], strict=True):
            after.setdefault(s, []).append(d)
        queue, visited, found = [[entry]], {entry}, []
        while queue and len(found) < limit:
            path = queue.pop(0)
            nexts = [x for x in after.get(path[-1], [])[:fan] if x not in visited] if len(path) <= depth else []
            if not nexts and len(path) > 1:
                found.append(path)
            for x in nexts:
                visited.add(x)
                queue.append([*path, x])
        return pd.DataFrame({"entry": entry, "k": range(len(found)), "steps": [" -> ".join(p) for p in found]})

    return run


def runtime_paths(edges: DataFrame, entries: DataFrame, limit: int = 25, depth: int = 4, fan: int = 4) -> DataFrame:
    """Breadth-first import paths from each entry module, with one visited set for each.

    Only edges reachable within ``depth`` steps and the first ``fan`` of each module are brought to an entry's group, so a group has
    at most fan ** depth edges whatever the graph's size.
    """
    ranked = edges.selectExpr("src", "dst", "row_number() over (partition by src order by ord, dst) as k").where(F.col("k") <= fan)
    front = entries.select(F.col("module").alias("entry"), F.col("module").alias("src")).distinct()
    reached = None
    for _ in range(depth):
        step = front.join(ranked, "src").select("entry", "src", "dst", "k")
        reached = step if reached is None else reached.unionByName(step)
        front = step.select("entry", F.col("dst").alias("src")).distinct()
    ordered = reached.distinct().orderBy("entry", "src", "k")
    return ordered.groupBy("entry").applyInPandas(_paths(limit, depth, fan), "entry string, k long, steps string")


def _module(path: str = "path"):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), "/", ".")


def symbol_table(graph: DataFrame) -> DataFrame:
    """symbol (module and qualified name), kind, path; of names that a module defines again the first."""
    rows = graph.where(F.col("kind").isin("class", "function", "async_function"))
    named = rows.select(F.concat_ws(".", _module(), "qualname").alias("symbol"), F.struct("ord", "kind", "path").alias("row"))
    return named.groupBy("symbol").agg(F.min("row").alias("row")).select("symbol", "row.kind", "row.path")


def resolved_calls(graph: DataFrame) -> DataFrame:
    """path, owner, line, name, target, resolved: every call, with the qualified name that it means and whether the corpus defines it.

    A name is looked up as Python finds it: ``self.x`` in the class around, a plain or dotted name in its module, else the longest of its
    dotted beginnings that an import binds in that module, put in the place of what is bound. All of it is equality joins: of a
    call's few beginnings with the aliases of its file, and of targets with the symbol table. A symbol that very many calls mean
    is one row of that table, and Spark splits the partition of its calls.
    """
    module, dotted = _module(), F.split("name", r"\.")
    calls = graph.where(F.col("kind") == "call").select("path", module.alias("module"), "qualname", "line", "name", "ord")
    around = F.regexp_extract("qualname", r"^(.*)\.[^.]*$", 1)
    own = F.when(F.startswith("name", F.lit("self.")) & (around != ""), F.concat_ws(".", "module", around, F.substring("name", F.lit(6), F.length("name")))).otherwise(F.concat_ws(".", "module", "name"))
    heads = F.transform(F.sequence(F.lit(1), F.size(dotted)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(dotted, F.lit(1), i), ".").alias("head"), F.array_join(F.slice(dotted, i + 1, F.size(dotted)), ".").alias("rest")))
    bound = graph.where(F.col("kind") == "alias").groupBy("path", F.col("name").alias("head")).agg(F.max_by("target", "ord").alias("bound"))  # the last import of a name holds
    by_alias = calls.select("path", "ord", F.explode(heads).alias("h")).select("path", "ord", "h.*").join(bound, ["path", "head"])
    target = F.when(F.col("rest") == "", F.col("bound")).otherwise(F.concat_ws(".", "bound", "rest"))
    by_alias = by_alias.groupBy("path", "ord").agg(F.max_by(target, "n").alias("by_alias"))
    known = symbol_table(graph).select("symbol")
    found = calls.withColumn("own", own).join(known.withColumnRenamed("symbol", "own").withColumn("here", F.lit(True)), "own", "left").join(by_alias, ["path", "ord"], "left")
    found = found.withColumn("target", F.when(F.col("here"), F.col("own")).otherwise(F.coalesce("by_alias", "name")))
    found = found.join(known.withColumn("resolved", F.lit(True)), F.col("target") == F.col("symbol"), "left")
    return found.select("path", F.concat_ws(".", "module", "qualname").alias("owner"), "line", "name", "target", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def graph_totals(graph: DataFrame, calls: DataFrame) -> DataFrame:
    """modules, symbols, imports, call_sites, resolved_calls, parse_errors: one row."""
    kind = lambda *k: F.count(F.when(F.col("kind").isin(*k), 1))
    sums = graph.agg(F.countDistinct("path").alias("modules"), kind("class", "function", "async_function").alias("symbols"), kind("import").alias("imports"), kind("error").alias("parse_errors"))
    return sums.crossJoin(calls.agg(F.count("*").alias("call_sites"), F.count(F.when(F.col("resolved"), 1)).alias("resolved_calls")))
