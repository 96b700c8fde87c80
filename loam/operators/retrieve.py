"""Questions about a corpus: terms, ranked files and symbols, and a short answer."""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.functions import extract as X
from loam.plans.dialect import SPARK
from loam.plans.engine import Engine
from loam.sources.store import written

from .catalog import GOAL_BOOST
from .textindex import TextIndex, ranked, scanned_scores, scanned_snippets

#: Words that say nothing about a file.
STOP = {"a", "an", "and", "are", "for", "from", "how", "implemented", "in", "is", "of", "on", "or", "the", "to", "what", "where", "which", "who", "why", "with"}
#: Call hints that one part of an answer's text holds at most.
PART = 10_000


def terms_of(question: str) -> list[str]:
    """Words of two or more characters that are no stop words; repeated ones stay. ValueError if none is left."""
    terms = [t for t in re.findall(r"[a-zA-Z0-9_]+", question.lower()) if len(t) > 1 and t not in STOP]
    if not terms:
        raise ValueError("the question has no searchable words")
    return terms


def _score(terms: list[str]) -> Column:
    return F.expr(" + ".join(X.term_score(SPARK, "hay", t) for t in terms))


def index_of(engine: Engine) -> TextIndex:
    """The engine's index, built when it is first asked for."""
    if "index" not in engine.kept:
        engine.kept["index"] = TextIndex.build(engine.relation("files"), engine.sql("select path, content from corpus"))
    return engine.kept["index"]


def rank_files(engine: Engine, question: str, goal: str = "", limit: int = 8) -> DataFrame:
    """path, score, line_count: best first, then the shorter."""
    return index_of(engine).rank(engine.relation("files"), terms_of(question), GOAL_BOOST.get(goal, ()), limit)


def rank_symbols(symbols: DataFrame, question: str, files: DataFrame, limit: int = 16) -> DataFrame:
    """Symbols (rows of ``python_graph``) by term score, two more in one of the ranked files (at most a few, broadcast)."""
    hay = F.lower(F.concat_ws(" ", "name", "qualname", "kind", "path", "doc"))
    found = symbols.where(F.col("kind").isin("class", "function", "async_function")).withColumn("hay", hay)
    chosen = F.broadcast(files.select("path", F.lit(2).alias("bonus")))
    scored = found.join(chosen, "path", "left").withColumn("score", _score(terms_of(question)) + F.coalesce("bonus", F.lit(0)))
    return scored.where("score > 0").select("path", "qualname", "kind", "line", "score", "ord").orderBy(F.desc("score"), "path", "ord", "line", "qualname").limit(limit)


def answer(engine: Engine, question: str, symbols: DataFrame | None = None, goal: str = "") -> str:
    """One paragraph from the best file and symbol."""
    files = rank_files(engine, question, goal)
    best = files.first()
    if best is None:
        return "Nothing in the corpus matches the question."
    text = f"Start with {best.path} (score {best.score}, {best.line_count} lines)."
    symbol = rank_symbols(symbols, question, files).first() if symbols is not None else None
    return text + (f" The closest symbol is {symbol.qualname} at {symbol.path}:{symbol.line}." if symbol else "")


def include_symbol_files(files: list[dict], symbols: list[dict], known: dict[str, dict], limit: int) -> list[dict]:
    """The files of the symbols that are not among ``files`` yet, each in place of the last one where there is no room."""
    files = list(files)
    for s in symbols:
        if s["path"] in {f["path"] for f in files} or s["path"] not in known:
            continue
        if len(files) >= limit:
            files.pop()
        files.append({"path": s["path"], "score": s["score"], "line_count": known[s["path"]]["line_count"], "summary": known[s["path"]]["summary"]})
    return files[:limit]


def _of_paths(column: Column, paths: list[str]) -> Column:
    """Whether a module's path is one of ``paths`` or the end of one: all ends of these few are one set, looked up once for each row."""
    return column.isin(sorted({p[i:] for p in paths for i in range(len(p) + 1)})) if paths else F.lit(False)


def import_hints(graph: DataFrame, paths: list[str], most: int = 10) -> DataFrame:
    """path, imports: the first imports of the modules of ``paths`` (a few)."""
    rows = graph.where((F.col("kind") == "import") & _of_paths(F.col("path"), paths))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where(F.col("k") <= most)
    return ranked.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("imports"))


def call_hints(graph: DataFrame, terms: list[str], paths: list[str], most: int = 12) -> DataFrame:
    """owner, calls: the first calls of the functions whose module is in ``paths``, or whose name holds a term."""
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    rows = graph.where(F.col("kind") == "call").withColumn("owner", F.concat_ws(".", module, "qualname"))
    owner_path = F.concat(F.regexp_replace(F.regexp_replace("owner", r"\.[^.]*$", ""), r"\.", "/"), F.lit(".py"))
    held = reduce(lambda a, b: a | b, [F.contains(F.lower("owner"), F.lit(t)) for t in terms], F.lit(False))
    ranked = rows.where(held | _of_paths(owner_path, paths)).withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy("ord"))).where(F.col("k") <= most)
    return ranked.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("calls"))


def hint_lines(calls: DataFrame) -> tuple[DataFrame, int]:
    """part, nth, line: the call hints by owner as a text shows them, PART to a part, and how many characters they take with their line ends.

    A term that is in many functions' names has a hint for each of them, so they are sorted by ranges, stored, and numbered by how
    many the ranges before hold; only these counts come to the driver.
    """
    spark, line = calls.sparkSession, F.concat(F.lit("- "), "owner", F.lit(": "), F.array_join("calls", ", "))
    ranges = written(calls.select("owner", line.alias("line")).orderBy("owner").select("line", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "hints")
    found = ranges.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum(F.length("line") + 1).alias("chars")).orderBy("range").collect()
    starts = [(r.range, before - r.first) for r, before in zip(found, accumulate((r.n for r in found), initial=0), strict=False)]
    nth = F.col("at") + F.col("start")
    lines = ranges.join(F.broadcast(spark.createDataFrame(starts, "range int, start long")), "range").select(F.floor(nth / PART).cast("int").alias("part"), nth.alias("nth"), "line")
    return lines, sum(r.chars for r in found)


def text_parts(head: str, lines: DataFrame) -> DataFrame:
    """part, text: a text in parts that follow each other, the first of which begins with ``head``; no task has more than its parts."""
    parts = lines.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return parts.select("part", F.concat(F.when(F.col("part") == 0, F.lit(head)).otherwise(""), "text", F.lit("\n")).alias("text"))


def retrieved(engine: Engine, question: str, graph: DataFrame, goal: str = "", limit: int = 8) -> dict:
    """Files, symbols, snippets, imports and calls for a question, the text that shows them in parts, and the tokens that it saves.

    Only the ``limit`` files and 2 * ``limit`` symbols that are shown come to the driver. The calls are those of their modules and of
    functions named by a term, which may be as many as there are modules: they and the parts of the text (part, text) stay tables.
    Where no index was built (``index_of``), one question builds none: it passes over the facts, and over the contents of the files shown.
    """
    terms, index = terms_of(question), engine.kept.get("index")
    facts, boosts = engine.relation("files"), GOAL_BOOST.get(goal, ())
    files = [r.asDict() for r in (index.rank(facts, terms, boosts, limit) if index else ranked(facts, scanned_scores(facts, terms, boosts), limit)).collect()]
    chosen = engine.spark.createDataFrame([(p,) for p in dict.fromkeys(f["path"] for f in files)], "path string")
    symbols = [r.asDict() for r in rank_symbols(graph, question, chosen, max(1, 2 * limit)).collect()]
    paths = [f["path"] for f in files] + [s["path"] for s in symbols]
    known = {r.path: r.asDict() for r in facts.where(F.col("path").isin(paths)).select("path", "line_count", "summary").orderBy("line_count", "summary").collect()}
    files = include_symbol_files([f | {"summary": known[f["path"]]["summary"]} for f in files], symbols, known, limit)
    paths = [f["path"] for f in files]
    found = index.snippets(terms, paths) if index else scanned_snippets(engine.sql("select path, content from corpus"), terms, paths)
    found = [r.asDict() for r in found.orderBy("k", "n").collect()]
    imports, calls = import_hints(graph, paths), call_hints(graph, terms, paths)
    lines = ["RETRIEVAL", f"Query: {question}", f"Goal: {goal}", "", "Relevant Files:", *[f"- {f['path']} (score {f['score']}, {f['line_count']} lines): {f['summary']}" for f in files], "", "Relevant Symbols:"]
    lines += [f"- {s['qualname']} [{s['kind']}] at {s['path']}:{s['line']}" for s in symbols[:12]] or ["- None matched"]
    lines += ["", "Snippets:", *([x for s in found for x in (f"--- {s['path']}:{s['start_line']}", s["text"])] or ["- No direct line matches; start with the relevant files above."])]
    lines += ["", "Import Hints:", *([f"- {r.path}: {', '.join(r.imports)}" for r in imports.orderBy("path").toLocalIterator()] or ["- None"])]
    lines += ["", "Call Hints:"]
    hints, chars = hint_lines(calls)
    head = "\n".join(lines if chars else [*lines, "- None"]) + "\n"
    parts = text_parts(head, hints) if chars else engine.spark.createDataFrame([(0, head)], "part int, text string")
    full = engine.relation("metrics").first().total_size_bytes // 4
    emitted = max(1, (len(head) + chars - 1 + 3) // 4)
    saved = 0 if full <= 0 else max(0, round((1 - emitted / full) * 100))
    return {"files": files, "symbols": symbols, "snippets": found, "imports": imports, "calls": calls, "parts": parts, "full_tokens": full, "retrieved_tokens": emitted, "saved_percent": saved}


def retrieve(engine: Engine, question: str, graph: DataFrame, goal: str = "", limit: int = 8) -> dict:
    """``retrieved`` with its whole ``text`` on the driver, for a reader; where the text may be long, take the parts."""
    got = retrieved(engine, question, graph, goal, limit)
    return got | {"text": "".join(r.text for r in got["parts"].orderBy("part").toLocalIterator())}
