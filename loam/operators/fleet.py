"""Audits of many repositories in one plan: the relations of ``plans`` with a repository key, one stored table of facts for all.

A repository is a group, never a job: aggregates group by it, joins have it in their keys, rankings are windows within it. The
SQL that each query is held against runs the single-corpus relations once for each repository, on its files alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.plans.dialect import BY_REPO, DUCK
from loam.plans.engine import Engine
from loam.plans.relations import RELATIONS, REPOS, corpus_of_documents, needed, root_files

#: name -> what is selected of one corpus, without its key.
AUDITS = {
    "s24_fleet_metrics": "select total_files, total_lines, total_size_bytes, open_todos, avg_lines_per_file, has_tests, has_docs, has_readme, test_files from metrics",
    "s24_fleet_health": "select score, maintainability, maintainability_risk, documentation, runtime_level, test_signal, todo_density from health",
    "s24_fleet_risks": "select file, score, level, factors, risk_categories, surface, test_status, test_file from top_risks",
    "s24_fleet_archetypes": "select primary_archetype, confidence, vendor_heavy, generated_heavy, documentation_heavy, test_suite, mixed_language from archetype",
    "s24_fleet_issues": "select type, severity, category, file, message from all_issues",
    "s24_fleet_suggestions": "select rank, ord, category, priority, title, reason, action, array_to_string(focus, ';') as focus, impact, effort, label, confidence, evidence from suggestions",
    "s24_fleet_changes": "select new_count, modified_count, deleted_count from diff_counts",
}
#: One row for each repository, as a benchmark over fixtures has it.
TABLE = "select m.total_files as files, m.total_lines as lines, h.score as health, a.primary_archetype as archetype from metrics m cross join health h cross join archetype a"


def fleet(spark: SparkSession, sf_dir: str) -> Engine:
    """Of the test corpus, whose largest repository has three in seven of its files."""
    return Engine.from_documents(spark, sf_dir, BY_REPO)


def audit_table(engine: Engine) -> DataFrame:
    """repo, files, lines, health, archetype."""
    return engine.sql("select m.repo, m.total_files as files, m.total_lines as lines, h.score as health, a.primary_archetype as archetype from metrics m join health h on m.repo = h.repo join archetype a on m.repo = a.repo")


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fleet(spark, sf_dir).sql(AUDITS[name].replace("array_to_string", "array_join").replace("select ", "select repo, ", 1))

    run.__name__ = name
    return run


def one_by_one(query: str) -> str:
    """The query's SQL for the checking engine: once for each repository, over nothing but its files."""
    # What the corpora are made of names no function that the engines differ in.
    shared = {"corpus": f"{corpus_of_documents(repo=True)} union all {root_files(DUCK, True)}", **{k: RELATIONS[k](BY_REPO) for k in ("old_corpus", "listing")}}
    parts = []
    for i, repo in enumerate(REPOS):
        own = {k: f"select path{', content' if k != 'listing' else ''} from all_{k} where repo = '{repo}'" for k in shared}
        bodies = own | needed(DUCK, query, own)
        chain = ", ".join(f"{k} as materialized ({v})" for k, v in bodies.items())
        parts.append(f"select '{repo}' as repo, * from (with {chain} {query}) q{i}")
    shared["listing"] = shared["listing"].replace("from corpus", "from all_corpus")
    head = ", ".join(f"all_{k} as materialized ({v})" for k, v in shared.items())
    return f"with {head} " + " union all ".join(parts)


def a24_fleet_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_table(fleet(spark, sf_dir))


FLEET: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {name: (_run(name), one_by_one(query)) for name, query in AUDITS.items()}
FLEET["a24_fleet_audit"] = (a24_fleet_audit, one_by_one(TABLE))
