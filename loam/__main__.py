"""Command line: ``python -m loam COMMAND FOLDER ...`` over a tree of files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from loam.operators import pygraph, registry, render, state
from loam.plans.engine import Engine
from loam.sources import config
from loam.sources.files import read_tree, without_ignored


def options() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loam", description="Analyses of a tree of source files")
    parser.add_argument("command", choices=["scan", "overview", "markdown", "html", "context", "prompt", "ask", "graph", "bundle", "doctor", "release", "list"])
    parser.add_argument("folder", nargs="?", default=".")
    parser.add_argument("--config")
    parser.add_argument("--budget", default="small")
    parser.add_argument("--goal", default="next")
    parser.add_argument("--question", default="")
    parser.add_argument("--out", default="report")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = options().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    settings, budget = config.load(args.config), config.budget_name(args.budget)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "doctor":
        rows = config.doctor(spark, settings, args.folder).collect()
        print("\n".join(f"{'ok ' if r.ok else 'no '} {r.name}: {r.message}" for r in rows))
        return 0 if all(r.ok for r in rows) else 1
    root = str(config.resolved(".", args.folder))
    tree = read_tree(spark, root, settings["important_extensions"], settings["ignore_dirs"], settings["max_file_size_bytes"])
    own = [p[len(root) + 1 :] for p in config.own_paths(settings, root) if p.startswith(root + "/")]
    tree = without_ignored(tree, spark.createDataFrame([(p,) for p in own], "path string"))
    engine = Engine.from_corpus(tree)
    if args.command == "scan":
        out = state.scan_once(engine, state.Tables(spark, str(config.resolved(root, settings["knowledge_base_path"]))), config.now())
        alerts = state.budget_alerts(engine, settings["performance_budgets"])
        print(json.dumps({"measured": engine.measured, "alerts": [r.message for r in alerts.collect()], "health": out["health"].first().asDict(), "suggestions": [r.title for r in out["suggestions"].orderBy("rank").collect()]}, indent=2, default=str))
    elif args.command == "release":
        rows = state.release_checks(engine, settings, root, options().format_help()).orderBy("ord").collect()
        print("\n".join(f"{'ok ' if r.ok else 'no '} {r.name}: {r.message}" for r in rows))
        return 0 if all(r.ok for r in rows) else 1
    elif args.command == "bundle":
        print("\n".join(render.save_bundle(engine, args.out, budget)))
    elif args.command in ("ask", "graph"):
        graph = pygraph.python_graph(tree.select("path", "content"))
        print(render.answer_page(engine, args.question, graph) if args.command == "ask" else json.dumps(render.graph_pack(graph), indent=2))
    elif args.command == "context":
        print(render.context(engine, budget), end="")
    elif args.command == "prompt":
        print(render.prompt_pack(engine, args.goal, budget)["text"], end="")
    else:
        show = {"overview": render.overview, "markdown": render.markdown, "html": render.page}[args.command]
        print(show(render.report(engine)), end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
