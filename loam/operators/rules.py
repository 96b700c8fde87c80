"""Pattern rules as data: a table of conditions, read at run time, evaluated by joins with the files' features.

A rule is a record with name, description and conditions. ``requires_directories`` must all be top folders of the corpus. The others
restrict one file that must meet all of them together: ``extension_in``, ``file_name_in`` (one of), ``path_contains_any``,
``import_contains_any`` (a part of one of), ``requires_main``. A rule without conditions on files holds by its directories alone.

Rules become rows (rule, kind, value). Extensions, names and folders meet them by equality joins; parts of paths and imports are found
by one pass of an automaton over each, whatever the number of rules, and joined then. A file meets a rule if as many kinds of
conditions hold for it as the rule has, which is a count by (rule, file), summed before it is shuffled.

Cases: all comparisons are in lower case; a condition with an empty list, or ``requires_main`` that is false, asks for no more than that
there is a file; names and descriptions may hold any characters; without rules or files nothing holds but rules without conditions.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .related import found_words

FILE_KINDS = ("extension_in", "file_name_in", "path_contains_any", "import_contains_any", "requires_main")


def read_rules(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """The rules of a JSON file ({"patterns": [...]}), in any file system that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    return json.loads(text.value).get("patterns", []) if text else []


def rule_table(spark: SparkSession, rules: Sequence[Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """(rule, name, description, scoped, kinds, directories) and (rule, kind, value)."""
    heads, rows = [], []
    for k, r in enumerate(rules):
        own = [(k, kind, str(v).lower()) for kind in FILE_KINDS[:4] for v in dict.fromkeys(r.get(kind) or ())]
        own += [(k, "requires_main", "true")] if r.get("requires_main") else []
        folders = sorted({str(v).lower() for v in r.get("requires_directories") or ()})
        heads.append((k, r.get("name", "unnamed_pattern"), r.get("description", ""), any(kind in r for kind in FILE_KINDS), len({kind for _, kind, _ in own}), len(folders)))
        rows += own + [(k, "requires_directories", v) for v in folders]
    return (
        spark.createDataFrame(heads, "rule int, name string, description string, scoped boolean, kinds int, directories int"),
        spark.createDataFrame(rows, "rule int, kind string, value string"),
    )


def matching_rules(files: DataFrame, rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """ord, name, description of the rules that hold. ``files`` has path, extension, has_main, imports; the rest is of ``rule_table``."""
    kind = lambda k: F.lit(k).alias("kind")
    low = files.select("path", F.lower("path").alias("bare"), F.lower("extension").alias("extension"), "has_main", F.transform("imports", lambda i: F.lower(i)).alias("imports"))
    wanted = lambda k: conditions.where(F.col("kind") == k).select("value").distinct()
    features = low.select("path", kind("extension_in"), F.col("extension").alias("value"))
    features = features.unionByName(low.select("path", kind("file_name_in"), F.element_at(F.split("bare", "/"), -1).alias("value")))
    features = features.unionByName(low.where("has_main").select("path", kind("requires_main"), F.lit("true").alias("value")))
    features = features.unionByName(found_words(low.select("path", F.col("bare").alias("text")), wanted("path_contains_any")).select("path", kind("path_contains_any"), F.col("word").alias("value")))
    imported = low.select("path", F.explode("imports").alias("text"))
    features = features.unionByName(found_words(imported, wanted("import_contains_any")).select("path", kind("import_contains_any"), F.col("word").alias("value")))
    met = features.join(conditions, ["kind", "value"]).groupBy("rule", "path").agg(F.countDistinct("kind").alias("met"))
    by_file = met.join(rules.select("rule", "kinds"), "rule").where("met = kinds").select("rule").distinct().withColumn("by_file", F.lit(True))
    parts = F.split("bare", "/")
    tops = low.where(F.size(parts) > 1).select(F.get(parts, F.lit(0)).alias("value")).distinct()
    folders = conditions.where("kind = 'requires_directories'").join(tops, "value", "left_semi").groupBy("rule").agg(F.count("*").alias("there"))
    some = files.limit(1).agg(F.count("*").alias("some"))
    held = rules.join(by_file, "rule", "left").join(folders, "rule", "left").crossJoin(some)  # one row
    file_ok = ~F.col("scoped") | F.when(F.col("kinds") == 0, F.col("some") > 0).otherwise(F.coalesce("by_file", F.lit(False)))
    return held.where(file_ok & (F.coalesce("there", F.lit(0)) == F.col("directories"))).select(F.col("rule").alias("ord"), "name", "description")
