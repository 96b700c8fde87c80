"""PII: detected entities get keyed surrogates of their type, format, script and gender.

Names are found after titles (which are no part of them), as two capitalised words or more after phrases and headers that introduce a
name, as listed given names with a surname, and wherever the same text repeats a name so found or a part
of it, capitalised; each word of a name is an entity. A name that none of these ever marks in its text is not found.

Texts are searched once; what is found is stored beside them. Each distinct entity draws a surrogate (``surrogates``). A draw is
refused if it is itself an entity of the corpus, if an entity with a smaller normal form drew the same, or if it was given away
before; who is refused draws again, until nobody is. So different entities get different surrogates, one entity gets the same
everywhere, and no surrogate is a real entity, the original included. All of this is joins over the distinct entities. Only those
that drew more than once have to be known to the tasks that write: they are sent while there are at most SENT of them; beyond,
each document gets its own by a join.

Cases: null stays null; texts without entities are returned unchanged; repeated rows are each rewritten alike; an empty table gives
an empty table; other columns, whatever their names, are ignored (operator) or kept (``with_surrogates``). Two entities whose texts
differ in case only are one. If MOST_DRAWS do not do, an error is raised: nothing is ever written with its own original.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh, table, text_chunks, written
from .surrogates import Detector, Surrogates, maybe, replaced, units

STEP, SENT, MOST_DRAWS = 1 << 20, 50_000, 64
#: The session's setting that holds the secret key.
KEY_SETTING = "spark.loam.pii.key"
#: For the registered queries over synthetic tables, where the setting is unset.
QUERY_KEY = "a key for synthetic tables"
FOUND = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType()), StructField("units", ArrayType(StringType()))]))
ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("units", pa.list_(pa.string()))]))
_KEYS = ["kind", "norm"]


def query_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_SETTING, QUERY_KEY).encode()


@cache
def _application_key(application: str) -> bytes:
    return secrets.token_bytes(32)


def secret_key(spark: SparkSession) -> bytes:
    """The session's key; where none is set, a random one that only this application has, so nobody can try out surrogates."""
    key = spark.conf.get(KEY_SETTING, None)
    return key.encode() if key else _application_key(spark.sparkContext.applicationId)


def _detected(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Detector()
        for rows, data, offsets in text_chunks(batches, STEP):
            raw, out = data.tobytes(), []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                text = raw[a:b]
                found = find(text.decode()) if maybe(text) else ()
                out.append([{"start": x.start, "end": x.end, "kind": x.kind, "units": units(x.kind, x.norm)} for x in found])
            yield rows.append_column(column, pa.array(out, ARROW))

    return run


def _draw(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for rows in batches:
            drawn = [made(k, n, attempt) for k, n in zip(rows.column("kind").to_pylist(), rows.column("norm").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("kind"), rows.column("norm"), pa.array(drawn, pa.string())], ["kind", "norm", "surrogate"])

    return run


def redrawn(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, surrogate: of the entities (stored, distinct) whose first draw was refused."""
    real = entities.select("kind", F.col("norm").alias("surrogate"))
    pending, given = entities, []
    for attempt in range(MOST_DRAWS):
        drawn = written(pending.mapInArrow(_draw(key, attempt), "kind string, norm string, surrogate string"), "drawn")
        taken = real
        for g in given:
            taken = taken.unionByName(g.select("kind", "surrogate"))
        free = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).join(taken, ["kind", "surrogate"], "left_anti")
        given.append(written(free.select("kind", "norm", "surrogate"), "given"))
        pending = written(drawn.select(*_KEYS).join(given[-1], _KEYS, "left_anti"), "pending")
        if pending.isEmpty():
            break
    else:
        raise RuntimeError("entities without a free surrogate")
    odd = given[0].where("false")
    for g in given[1:]:
        odd = odd.unionByName(g)
    return odd


def _rewritten(key: bytes, sent: dict[tuple[str, str], str], found: str, own: str | None, counts: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, known = Surrogates(key), {}
        for rows, data, offsets in text_chunks(batches, STEP):
            raw, texts = data.tobytes(), []
            nulls, all_found = rows.column("text").is_null().to_pylist(), rows.column(found).to_pylist()
            exceptions = rows.column(own).to_pylist() if own else None
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                new = raw[a:b]
                if all_found[i]:
                    text, out, at = new.decode(), [], 0
                    mine = {(x["kind"], x["norm"]): x["surrogate"] for x in exceptions[i] or ()} if own else sent
                    for x in all_found[i]:
                        drawn = []
                        for u in x["units"]:
                            k = (x["kind"], u)
                            s = mine.get(k) or known.get(k)
                            if s is None:
                                if len(known) > 100_000:
                                    known.clear()
                                s = known[k] = made(*k)
                            drawn.append(s)
                        out += [text[at : x["start"]], replaced(x["kind"], drawn, text[x["start"] : x["end"]])]
                        at = x["end"]
                    new = "".join([*out, text[at:]]).encode()
                texts.append(None if nulls[i] else new)
            cols = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            if counts:
                cols["n_entities"] = pa.array([len(f) for f in all_found], pa.int64())
                cols["kinds"] = pa.array([",".join(sorted({x["kind"] for x in f})) for f in all_found], pa.string())
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else rows.column(c) for c in columns], columns)

    return run


def _replace(docs: DataFrame, key: bytes, most_sent: int, counts: bool) -> DataFrame:
    """``docs`` (``text`` is a string) with surrogates, and with ``counts`` also n_entities and kinds."""
    found, row, own = (fresh(c, docs.columns) for c in ("found", "row", "own"))
    schema = StructType([*docs.schema.fields, StructField(found, FOUND)])
    stored = written(docs.mapInArrow(_detected(found), schema).withColumn(row, F.monotonically_increasing_id()), "detected")
    each = stored.select(F.col(row).alias("row"), F.explode(found).alias("x")).select("row", "x.kind", F.explode("x.units").alias("norm"))
    entities = written(each.select(*_KEYS).distinct(), "entities")
    odd = redrawn(entities, key)
    rows = odd.limit(most_sent + 1).collect()
    columns, sent = [*docs.columns, *(["n_entities", "kinds"] if counts else [])], {}
    out = StructType([*docs.schema.fields, *([StructField("n_entities", LongType()), StructField("kinds", StringType())] if counts else [])])
    if len(rows) <= most_sent:
        sent, own = {(r.kind, r.norm): r.surrogate for r in rows}, None
        stored = stored.drop(row)
    else:
        mine = each.distinct().join(odd, _KEYS).groupBy("row").agg(F.collect_set(F.struct("kind", "norm", "surrogate")).alias(own))
        stored = stored.join(mine.withColumnRenamed("row", row), row, "left").drop(row)
    return stored.mapInArrow(_rewritten(key, sent, found, own, counts, columns), out)


def with_surrogates(docs: DataFrame, key: bytes, most_sent: int = SENT) -> DataFrame:
    """``docs`` with entities in ``text`` replaced; all columns stay."""
    return _replace(docs, key, most_sent, False)


def replace_entities(docs: DataFrame, key: bytes, most_sent: int = SENT) -> DataFrame:
    """doc_id, n_entities, kinds, text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _replace(docs, key, most_sent, True).select("doc_id", "n_entities", "kinds", "text")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), query_key(spark))
