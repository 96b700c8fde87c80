"""Reports as text: relations of a few rows are collected and laid out; lists are cut by their queries."""

from __future__ import annotations

import html
import json
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from loam.plans.engine import Engine

from .catalog import QUERIES
from .retrieve import retrieve

#: Rows of each list that a report shows.
MOST = {"issues": 40, "risks": 15, "components": 12, "suggestions": 8}


def _rows(engine: Engine, sql: str) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in engine.sql(sql).collect()]


def report(engine: Engine) -> dict[str, Any]:
    """What the reports are made of."""
    one = lambda relation: _rows(engine, f"select * from {relation}")[0]
    return {
        "metrics": one("metrics"), "health": one("health"), "understanding": one("understanding"), "archetype": one("archetype"), "language": one("primary_language")["language"],
        "insight": one("insight")["insight"], "coverage": one("coverage_warning")["warning"], "readiness": one("llm_readiness"), "confidence": _rows(engine, "select * from confidence"),
        "issues": _rows(engine, f"select severity, type, file, message from all_issues order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, file, type limit {MOST['issues']}"),
        "risks": _rows(engine, f"select file, score, level, factors from top_risks order by score desc, file limit {MOST['risks']}"),
        "components": _rows(engine, f"select key, file_count, line_count from kept_components order by line_count desc, key limit {MOST['components']}"),
        "suggestions": _rows(engine, f"select rank, priority, title, reason, action, label, impact, effort, confidence, focus from suggestions order by rank limit {MOST['suggestions']}"),
        "hints": [r["hint"] for r in _rows(engine, "select hint, ord from workflow_hints order by ord")],
        "important": _rows(engine, "select path, reason from important_files order by rank"),
        "frameworks": [r["label"] for r in _rows(engine, "select label from all_frameworks order by label")],
    }


def overview(r: dict[str, Any]) -> str:
    """A page of plain text."""
    u, h, m = r["understanding"], r["health"], r["metrics"]
    lines = [u["project_name"], u["summary"], "", f"Type: {u['project_type']}", f"Language: {r['language']}", f"Health: {h['score']}%", f"Files: {m['total_files']}, lines: {m['total_lines']}", f"Insight: {r['insight']}"]
    lines += ["", "Start here:", *(f"- {x['path']}: {x['reason']}" for x in r["important"])]
    lines += ["", "Hints:", *(f"- {x}" for x in r["hints"])]
    lines += ["", "Next:", *(f"- [{s['priority']}] {s['title']}: {s['action']}" for s in r["suggestions"][:3])]
    return "\n".join(lines + (["", r["coverage"]] if r["coverage"] else [])) + "\n"


def _sections(r: dict[str, Any]) -> list[tuple[str, list[str], list[list[str]]]]:
    """(title, columns, rows) of the reports' tables."""
    h, m = r["health"], r["metrics"]
    return [
        ("Health", ["measure", "value"], [["score", f"{h['score']}%"], ["maintainability risk", h["maintainability_risk"]], ["runtime", h["runtime_level"]], ["tests", h["test_signal"]], ["files", str(m["total_files"])], ["lines", str(m["total_lines"])]]),
        ("Components", ["path", "files", "lines"], [[c["key"], str(c["file_count"]), str(c["line_count"])] for c in r["components"]]),
        ("Risks", ["file", "score", "level", "factors"], [[x["file"], str(x["score"]), x["level"], x["factors"].replace(";", ", ")] for x in r["risks"]]),
        ("Suggestions", ["rank", "priority", "title", "why", "action"], [[str(s["rank"]), s["priority"], s["title"], s["reason"], s["action"]] for s in r["suggestions"]]),
        ("Review signals", ["severity", "type", "file", "message"], [[i["severity"], i["type"], i["file"] or "", i["message"]] for i in r["issues"]]),
        ("Confidence", ["aspect", "level", "reason"], [[c["aspect"], c["level"], c["reason"]] for c in r["confidence"]]),
    ]


def markdown(r: dict[str, Any]) -> str:
    u = r["understanding"]
    out = [f"# {u['project_name']}", "", u["summary"], "", f"> {r['insight']}", ""]
    for title, columns, rows in _sections(r):
        if rows:
            cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
            out += [f"## {title}", "", f"| {' | '.join(columns)} |", "|" + " --- |" * len(columns), *(f"| {' | '.join(map(cell, row))} |" for row in rows), ""]
    return "\n".join(out)


def page(r: dict[str, Any]) -> str:
    """A page of HTML that needs no other file; all texts are escaped."""
    e, u = html.escape, r["understanding"]
    body = [f"<h1>{e(u['project_name'])}</h1><p>{e(u['summary'])}</p><blockquote>{e(r['insight'])}</blockquote>"]
    for title, columns, rows in _sections(r):
        if rows:
            head = "".join(f"<th>{e(c)}</th>" for c in columns)
            body.append(f"<h2>{e(title)}</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{e(x)}</td>" for x in row) + "</tr>" for row in rows) + "</table>")
    style = "body{font:15px sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:.3em;text-align:left}table{border-collapse:collapse}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{e(u["project_name"])}</title><style>{style}</style></head><body>{"".join(body)}</body></html>\n'


def context(engine: Engine, budget: str) -> str:
    return _rows(engine, f"select text from contexts where budget = '{budget}'")[0]["text"]


def prompt_pack(engine: Engine, goal: str = "next", budget: str = "small") -> dict[str, Any]:
    """An instruction for a goal: objective, next step, focus files, risks, what to deliver, and the context of a budget."""
    r, known = report(engine), goal if goal in ("next", "debug", "review", "plan", "document", "test") else "next"
    objective = _rows(engine, f"select objective from objectives where goal = '{known}'")[0]["objective"]
    wanted = [x["text"] for x in _rows(engine, f"select text, ord from deliverables where goal = '{known}' order by ord")]
    from loam.plans.dialect import SPARK

    focus = [x["path"] for x in _rows(engine, f"select path, k from ({QUERIES['w17_focus_files'](SPARK)}) f where budget = '{budget}' order by k")]
    top = r["suggestions"][0] if r["suggestions"] else None
    lines = [f"Project: {r['understanding']['project_name']}", f"Goal: {objective}", f"Summary: {r['understanding']['summary']}"]
    lines += [f"Next step: [{top['priority']}] {top['title']}", f"Why: {top['reason']}", f"Action: {top['action']}"] if top else []
    lines += ["Focus files:", *(f"- {p}" for p in focus)] if focus else []
    runtime = _rows(engine, "select file, score, factors from top_risks where surface = 'runtime' order by score desc, file limit 3")
    risks = [f"{x['file']}; {', '.join(dict.fromkeys(f.lower().strip() for f in x['factors'].split(';')[:2]))}" + (f": risk score {x['score']}" if x["score"] >= 40 else "") for x in runtime]
    lines += ["Risks:", *(f"- {x}" for x in risks or [i["message"] for i in r["issues"][:3]])]
    lines += ["Deliver:", *(f"- {x}" for x in wanted), "", "Context:", context(engine, budget).strip()]
    text = "\n".join(lines).strip() + "\n"
    return {"goal": goal, "budget": budget, "objective": objective, "deliverables": wanted, "focus_files": focus, "text": text, "tokens": max(1, (len(text.strip()) + 3) // 4)}


def graph_pack(graph) -> dict[str, Any]:
    """Totals of a module graph, its files of most symbols, and what could not be parsed (the first of each)."""
    totals = {r.kind: r["count"] for r in graph.groupBy("kind").count().collect()}
    symbols = graph.where(F.col("kind").isin("class", "function", "async_function")).groupBy("path").count().orderBy(F.desc("count"), "path").limit(25)
    errors = graph.where("kind = 'error'").select("path", "name", "line").orderBy("path").limit(25)
    return {"totals": totals, "symbols": [r.asDict() for r in symbols.collect()], "errors": [r.asDict() for r in errors.collect()]}


def answer_page(engine: Engine, question: str, graph, goal: str = "", limit: int = 8) -> str:
    """A question's answer: where to start, then what was found."""
    got = retrieve(engine, question, graph, goal, limit)
    first = f"Start with {got['files'][0]['path']}." if got["files"] else "Nothing in the corpus matches the question."
    symbol = f" The closest symbol is {got['symbols'][0]['qualname']}." if got["symbols"] else ""
    return f"{first}{symbol}\n\n{got['text']}"


def save_bundle(engine: Engine, folder: str, budget: str | None = None) -> list[str]:
    """Writes six files: the report as JSON, Markdown and HTML, the overview, a context and a prompt."""
    r = report(engine)
    budget = budget or r["readiness"]["budget"]
    files = {
        "report.json": json.dumps(r, indent=2, sort_keys=True, default=str) + "\n", "report.md": markdown(r), "report.html": page(r), "overview.txt": overview(r),
        "context.txt": context(engine, budget), "prompt.txt": prompt_pack(engine, "next", budget)["text"],
    }
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (target / name).write_text(text, encoding="utf-8")
    return sorted(files)

