"""Name -> (Spark function, SQL for the checking engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.plans.dialect import DUCK, SPARK
from loam.plans.engine import Engine
from loam.plans.relations import plan

from .catalog import QUERIES
from .extra import EXTRA
from .fleet import FLEET


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine.from_documents(spark, sf_dir).sql(QUERIES[name](SPARK))

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in QUERIES} | {name: f for name, (f, _) in (EXTRA | FLEET).items()}


def oracle_sql() -> dict[str, str]:
    return {name: plan(DUCK, f(DUCK)) for name, f in QUERIES.items()} | {name: sql for name, (_, sql) in (EXTRA | FLEET).items() if sql}
