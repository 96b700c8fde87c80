"""Registered runs of the DataFrame operators (sources, state, module graph, retrieval), each with SQL written apart from its code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import extract as X
from loam.plans.dialect import DUCK
from loam.plans.engine import Engine
from loam.plans.relations import plan
from loam.plans.understanding import PATTERNS, patterns_sql
from loam.sources import config, files, scancache
from loam.sources.keyed import Conflict, KeyedTable
from loam.sources.store import remove, work_dir, written
from loam.streaming.watch import watch

from . import catalog, pygraph, related, retrieve, rules, state

EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def registered(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        EXTRA[f.__name__] = (f, sql)
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


@registered("select doc_id, coalesce(text, '') as text from documents")
def s7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8, set between and after valid ones, are dropped."""
    raw = F.concat(F.lit(b"\xff\x80"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(b"\xc3"))
    return _documents(spark, sf_dir).select("doc_id", files._decoded_column(raw).alias("text"))


@registered("select doc_id, case when doc_id % 5 = 0 then 'absent' when doc_id % 7 = 0 then 'changed' else 'held' end as state, doc_id % 5 <> 0 and doc_id % 7 <> 0 as hit from documents")
def s8_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that lacks some files and has others with an older time: which facts hold."""
    listing = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.coalesce(F.length("text"), F.lit(0)).alias("size"), (F.col("doc_id") % 7).alias("modified"))
    cache = listing.where("cast(path as long) % 5 <> 0").withColumn("modified", F.when(F.col("modified") == 0, -1).otherwise(F.col("modified")))
    fresh, held = files.fresh_and_cached(listing, cache)
    said = F.when(F.col("path").cast("long") % 5 == 0, "absent").otherwise("changed")
    return fresh.select(F.col("path").cast("long").alias("doc_id"), said.alias("state"), F.lit(False).alias("hit")).unionByName(
        held.select(F.col("path").cast("long").alias("doc_id"), F.lit("held").alias("state"), F.lit(True).alias("hit"))
    )


@registered("select page_id, regexp_replace(html, '(?is)<!DOCTYPE[^>]*>', '', 'g') as html from (select page_id, '<!DOCTYPE html>' || html as html from pages) x")
def s13_without_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").withColumn("html", F.concat(F.lit("<!DOCTYPE html>"), "html"))
    return pages.select("page_id", config.without_doctype(F.col("html")).alias("html"))


_RATES = "select path as filename, cast(line_count % 10 as double) / 10 as line_rate from files where line_count % 3 <> 0"


@registered(plan(DUCK, f"select r.file, r.score, c.line_rate from top_risks r left join ({_RATES}) c on r.file = c.filename where c.line_rate is null or c.line_rate < 0.7 order by r.score desc, r.file limit 10"))
def j8_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Riskiest files of low or no coverage; rates are made of line counts."""
    engine = Engine.from_documents(spark, sf_dir)
    return files.coverage_gaps(engine.relation("top_risks").select("file", "score"), engine.sql(_RATES)).select("file", "score", "line_rate")


@registered("""select doc_id, case when doc_id % 3 = 0 then 'new' else coalesce(lang, '') end as lang from documents where doc_id % 4 <> 1 and (doc_id % 10 <> 0 or doc_id % 3 = 0)
  union all select doc_id, 'new' from documents where doc_id % 3 = 0 and doc_id % 4 = 1""")
def st5_st6_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserted rows replace or join the table, deleted keys go unless they are upserted, no other row does."""
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    table, updates = docs.where("doc_id % 4 <> 1"), docs.where("doc_id % 3 = 0").withColumn("lang", F.lit("new"))
    return state.merged(table, updates, docs.where("doc_id % 10 = 0").select("doc_id"), "doc_id")


@registered("""select doc_id as k, min(source) as source from (select doc_id, 0 as source from documents where doc_id % 50 = 0 union all select doc_id, 1 from documents where doc_id % 20 = 0
  union all select doc_id, 2 from documents where doc_id % 7 = 0) x group by doc_id order by source, k limit 25""")
def set2_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("k"))
    return state.ordered_union([docs.where(f"k % {n} = 0") for n in (50, 20, 7)], "k", 25)


@registered("select distinct coalesce(source, '') as source, lang from documents where lang is not null")
def set8_appended_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _documents(spark, sf_dir).where("lang is not null").select(F.coalesce("source", F.lit("")).alias("source"), "lang")
    return state.appended_if_absent(pairs.where("source < 'n'").distinct(), pairs)


@registered("select doc_id from (select doc_id, row_number() over (partition by lang order by doc_id desc) as k from documents) x where k <= 10")
def w22_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten of each group stay."""
    return state.retained(_documents(spark, sf_dir).select("doc_id", "lang"), ["doc_id"], 10, ["lang"]).select("doc_id")


@registered(plan(DUCK, "select distinct v as path from (select unnest(focus) as v from suggestions union all select 'gone/a.py') f where v <> '' and not exists (select 1 from files x where x.path = f.v)"))
def st20_p12_stale_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus files of the suggestions, and one more, that do not exist."""
    engine = Engine.from_documents(spark, sf_dir)
    focus = engine.relation("suggestions").select(F.explode("focus").alias("path"))
    return state.stale_focus(focus.unionByName(spark.createDataFrame([("gone/a.py",)], "path string")), engine.relation("files"))


# A module of each document, of a fixed form, so that its graph can be written down.
_MODULE = """import os
from pkg.m{next} import run

class C{id}:
    '''Holds it.'''
    def run(self):
        helper(1)
        os.path.join("a").strip()

async def helper(x):
    return C{id}().run()

print(run)
"""


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _MODULE.replace("{next}", "{id1}").split("{")
    text = [F.lit(parts[0])]
    for p in parts[1:]:
        name, rest = p.split("}", 1)
        text += [(F.col("doc_id") + (1 if name == "id1" else 0)).cast("string"), F.lit(rest)]
    return _documents(spark, sf_dir).select(F.concat(F.lit("pkg/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(*text).alias("content"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pygraph.python_graph(_modules(spark, sf_dir))


@registered("""select 'pkg/m' || doc_id || '.py' as path, kind, name, qualname, parent, line, end_line, doc from documents cross join lateral (values ('class', 'C' || doc_id, 'C' || doc_id, '', 4, 8, 'Holds it.'),
  ('function', 'run', 'C' || doc_id || '.run', 'C' || doc_id, 6, 8, ''), ('async_function', 'helper', 'helper', '', 10, 11, '')) v(kind, name, qualname, parent, line, end_line, doc)""")
def g1_g4_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graph(spark, sf_dir).where("kind in ('class', 'function', 'async_function')")
    return rows.select("path", "kind", "name", "qualname", "parent", "line", "end_line", "doc")


@registered("""select 'pkg/m' || doc_id || '.py' as path, owner, name, line from documents cross join lateral (values ('C' || doc_id || '.run', 'helper', 7), ('C' || doc_id || '.run', 'os.path.join.strip', 8), ('C' || doc_id || '.run', 'os.path.join', 8),
  ('helper', 'C' || doc_id || '.run', 11), ('helper', 'C' || doc_id, 11)) v(owner, name, line)""")
def g5_g6_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls inside a scope; the call of a module's own level is none of them."""
    return _graph(spark, sf_dir).where("kind = 'call'").select("path", F.col("qualname").alias("owner"), "name", "line")


@registered("select 'pkg/m' || doc_id || '.py' as path, 'os' as name from documents union all select 'pkg/m' || doc_id || '.py', 'pkg.m' || (doc_id + 1) from documents")
def g7_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).where("kind = 'import'").select("path", "name")


@registered("select 'm' || d as entry, cast(0 as bigint) as k, 'm' || d || ' -> m' || (d + 1) || ' -> m' || (d + 2) || ' -> m' || (d + 3) || ' -> m' || (d + 4) as steps from (select distinct doc_id as d from documents where doc_id % 40 = 0) x")
def g8_runtime_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import paths of a ring of modules from every fortieth one."""
    docs = _documents(spark, sf_dir).select("doc_id").distinct()
    steps = docs.select(F.explode(F.array(*[F.col("doc_id") + i for i in range(5)])).alias("i")).distinct()
    edges = steps.select(F.concat(F.lit("m"), "i").alias("src"), F.concat(F.lit("m"), F.col("i") + 1).alias("dst"), F.lit(1).alias("ord"))
    return pygraph.runtime_paths(edges, docs.where("doc_id % 40 = 0").select(F.concat(F.lit("m"), "doc_id").alias("module")))


@registered("""select 'pkg/m' || doc_id || '.py' as path, qualname, kind, score from (select doc_id, 'C' || doc_id || '.run' as qualname, 'function' as kind, 4 + case when doc_id < 3 then 2 else 0 end as score, 1 as i from documents) x
  order by score desc, path limit 16""")
def sc5_w13_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols for the question "run"; those of three chosen files first."""
    chosen = spark.createDataFrame([(f"pkg/m{i}.py",) for i in range(3)], "path string")
    found = retrieve.rank_symbols(_graph(spark, sf_dir), "run", chosen, 16)
    return found.select("path", "qualname", "kind", F.col("score").cast("int").alias("score"))


@registered("""select owner, calls from (select 'pkg.m' || doc_id || '.C' || doc_id || '.run' as owner, 'helper;os.path.join.strip;os.path.join' as calls, doc_id from documents where cast(doc_id as varchar) like '%7'
  union all select 'pkg.m' || doc_id || '.helper', 'C' || doc_id || '.run;C' || doc_id, doc_id from documents where doc_id in (1, 2)) x""")
def j17_call_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of functions of two modules' own level, and of methods whose name ends with a term."""
    rows = _graph(spark, sf_dir)
    found = retrieve.call_hints(rows, [f"{d}7.run" for d in range(10)] + ["c7.run"], ["pkg/m1.py", "pkg/m2.py"])
    return found.select("owner", F.array_join("calls", ";").alias("calls"))


@registered(None)
def r1_r5_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer: files, symbols, snippets, hints and text for a question over the test corpus; a row for each part of the text."""
    engine = Engine.from_documents(spark, sf_dir)
    # Symbols, imports and calls are asked of one graph: modules are parsed once.
    got = retrieve.retrieved(engine, "main title helper", written(_graph(spark, sf_dir), "graph"), "review")
    once = {"files": ";".join(f["path"] for f in got["files"]), "symbols": ";".join(s["qualname"] for s in got["symbols"]), "snippets": len(got["snippets"])}
    counts = [F.lit(got[c]).cast(t).alias(c) for c, t in (("full_tokens", "long"), ("retrieved_tokens", "long"), ("saved_percent", "int"))]
    return got["parts"].select(*[F.lit(v).alias(c) for c, v in once.items()], *counts, "text", "part")


def _snippets_sql() -> str:
    """Line by line for the first eight files."""
    terms = "(" + " or ".join(f"contains(lower(line), '{t}')" for t in catalog.TERMS) + ")"
    return f"""select * from (with ranked as (select path, row_number() over (order by score desc, line_count, path) as k from ({catalog._ranked(DUCK, 'review', 8)}) z),
      texts as (select k, c.path, {X.lines(DUCK, 'content')} as l from corpus c join ranked r on c.path = r.path),
      numbered as (select k, path, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from texts),
      hits as (select k, path, i, row_number() over (partition by path order by i) as n from numbered where {terms}),
      shown as (select *, (select count(*) from hits h where h.k < hits.k and h.n <= 2) as before from hits where n <= 2)
      select cast(s.k as int) as k, cast(s.n as int) as n, s.path, min(x.i) as start_line, max(x.i) as end_line, string_agg(x.i || ': ' || x.line, chr(10) order by x.i) as text
      from shown s join numbered x on x.path = s.path and abs(x.i - s.i) <= 2 where s.before < 12 group by s.k, s.n, s.path) w"""


@registered(plan(DUCK, _snippets_sql()))
def w14_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two matching lines of each retrieved file, with two lines around each; none of files after twelve."""
    engine = Engine.from_documents(spark, sf_dir)
    question = " ".join(catalog.TERMS)
    paths = [r.path for r in retrieve.rank_files(engine, question, "review", 8).collect()]
    return retrieve.index_of(engine).snippets(retrieve.terms_of(question), paths)


_WORDS_SQL = f"""select word, count(distinct case when field = 'about' then path end) as about, count(distinct case when field = 'text' then path end) as text from (
  select 'about' as field, path, unnest(regexp_extract_all({catalog._hay(DUCK)}, '[\\p{{L}}\\p{{N}}_]+')) as word from files
  union all select 'text', path, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) from corpus) x group by word"""


@registered(plan(DUCK, _WORDS_SQL))
def x20_index_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the index with the number of files that it describes and stands in."""
    return retrieve.index_of(Engine.from_documents(spark, sf_dir)).words.select("word", "about", "text")


@registered(plan(DUCK, f"select path, score, line_count from ({catalog._ranked(DUCK, 'review', 20)}) z"))
def r1_index_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files ranked from postings, as a pass over all facts ranks them."""
    return retrieve.rank_files(Engine.from_documents(spark, sf_dir), " ".join(catalog.TERMS), "review", 20)


@registered(plan(DUCK, "select t.term, count(distinct f.path) as files, sum(case when contains(lower(l.line), t.term) then 1 else 0 end)::bigint as lines from (select unnest(['thing', 'ma', 'un', 'zzz', 'helper', 'e_']) as term) t, "
  f"(select path, unnest({X.lines(DUCK, 'content')}) as line from corpus) l join files f using (path) where contains(lower(l.line), t.term) group by t.term"))  # fmt: skip
def x20_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines that contain each of some terms, from grams and postings alone."""
    index = retrieve.index_of(Engine.from_documents(spark, sf_dir))
    hits = index.postings_of(index.matching(["thing", "ma", "un", "zzz", "helper", "e_"]), "text").select("term", "path", F.explode("lines").alias("i")).distinct()
    return hits.groupBy("term").agg(F.countDistinct("path").alias("files"), F.count("*").alias("lines"))


@registered("""with d as (select doc_id as i, coalesce(text, '') as t from documents),
one as (select i, 'd' || i as path, 'new' as status, t from d),
two as (select i, case when i % 5 = 0 then 'modified' else 'deleted' end as status from d where i % 5 = 0 or i % 7 = 0),
three as (select i, case when i % 14 = 0 then case when i % 5 = 0 then 'modified' else 'new' end else 'deleted' end as status from d where i % 14 = 0 or i % 9 = 0 and (i % 7 <> 0 or i % 5 = 0))
select 'change 0' as what, path, status as value from one union all select 'change 1', 'd' || i, status from two union all select 'change 2', 'd' || i, status from three
union all select 'state', 'd' || i, sha256(case when i % 14 = 0 then 'back' when i % 5 = 0 then t || ' v2' else t end) from d where i % 14 = 0 or (i % 9 <> 0 and (i % 7 <> 0 or i % 5 = 0))""")
def st1_st4_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of a continuous scan, the last one run twice as after a failure: what each changed, and the state they lead to."""
    root, i = work_dir(spark), F.col("doc_id")
    docs = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), i).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    batches = [
        docs.withColumn("deleted", F.lit(False)),
        docs.where("doc_id % 5 = 0 or doc_id % 7 = 0").withColumn("deleted", i % 5 != 0).withColumn("content", F.concat("content", F.lit(" v2"))),
        docs.where("doc_id % 14 = 0 or doc_id % 9 = 0").withColumn("deleted", i % 14 != 0).withColumn("content", F.lit("back")),
    ]

    def keep(changes: DataFrame, k: int) -> None:
        changes.write.mode("overwrite").parquet(f"{root}/changes/batch={k}")

    def run() -> None:
        watch(spark, f"{root}/landing", f"{root}/state", f"{root}/checkpoint", keep).awaitTermination()

    for b in batches:
        b.select("path", "content", "deleted").write.mode("append").parquet(f"{root}/landing")
        run()
    remove(spark, f"{root}/checkpoint/commits/2")
    run()
    changes = spark.read.parquet(f"{root}/changes").select(F.concat(F.lit("change "), F.col("batch")).alias("what"), "path", F.col("status").alias("value"))
    return changes.unionByName(KeyedTable(spark, f"{root}/state", ["path"]).read().select(F.lit("state").alias("what"), "path", F.col("hash").alias("value")))


@registered("""with d as (select doc_id as i, coalesce(text, '') as t, doc_id % 7 as m from documents),
listed as (select 'd' || i as path, i, strlen(t) as size, m + case when i % 5 = 0 then 10 else 0 end as modified, t from d where i % 11 <> 0 union all select 'n' || i, i, strlen(t), m, t from d where i % 13 = 0),
c as (select (select count(*) from d where i % 11 <> 0 and i % 5 <> 0) as hits, (select count(*) from d where i % 11 <> 0 and i % 5 = 0) + (select count(*) from d where i % 13 = 0) as misses, (select count(*) from d where i % 11 = 0) as deleted)
select path, size::bigint as size, modified::bigint as modified, length(t)::bigint as chars, hits, misses, misses as writes, deleted, true as cheaper from listed cross join c""")
def s1_s9_incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a second scan after changes, new files and deletions, with its counts; it writes fewer bytes than the first."""
    cache, text = f"{work_dir(spark)}/cache", F.coalesce("text", F.lit(""))
    docs = _documents(spark, sf_dir).select("doc_id", text.alias("content"), F.octet_length(text).cast("long").alias("size"), (F.col("doc_id") % 7).cast("long").alias("modified"))
    named = lambda df, p: df.withColumn("path", F.concat(F.lit(p), "doc_id")).drop("doc_id")
    second = named(docs.where("doc_id % 11 <> 0").withColumn("modified", F.col("modified") + F.when(F.col("doc_id") % 5 == 0, 10).otherwise(0)), "d")
    second = second.unionByName(named(docs.where("doc_id % 13 = 0"), "n"))

    def extract(rows: DataFrame) -> DataFrame:
        return rows.select("path", "size", "modified", F.length("content").cast("long").alias("chars"))

    first = scancache.incremental_scan(named(docs, "d"), cache, "full", extract)[1]
    facts, counts = scancache.incremental_scan(second, cache, "full", extract)
    return facts.select("*", *[F.lit(counts[c]).cast("long").alias(c) for c in ("hits", "misses", "writes", "deleted")], F.lit(counts["bytes"] < first["bytes"]).alias("cheaper"))


@registered("""with d as (select doc_id as i, coalesce(lang, '') as lang from documents), v1 as (select 1 as version, i, lang from d),
v2 as (select 2 as version, i, case when i % 3 = 0 then 'xx' else lang end as lang from d where i % 3 = 0 or i % 10 <> 0),
v3 as (select 3 as version, i, lang from v2 union all select 3, i + 1000000, 'new' from d where i % 50 = 0)
select version, lang, count(*) as n, sum(i)::bigint as ids, true as refused from (select * from v1 union all select * from v2 union all select * from v3 union all select 4, i, lang from v3) x group by version, lang""")
def st6_st7_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a keyed table: upserts with deletions, an append by another writer, a compaction; a writer that came late is refused."""
    table = KeyedTable(spark, f"{work_dir(spark)}/table", ["doc_id"])
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    base = table.commit(docs)
    table.commit(docs.where("doc_id % 3 = 0").withColumn("lang", F.lit("xx")), docs.where("doc_id % 10 = 0"), base=base)
    table.commit(docs.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("lang")))
    try:
        table.commit(docs.withColumn("lang", F.lit("late")), base=base)
        refused = False
    except Conflict:
        refused = True
    table.compact()
    rows = [table.read(v).withColumn("version", F.lit(v)) for v in range(1, 5)]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.groupBy("version", "lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).withColumn("refused", F.lit(refused))


#: Modules whose functions are named by the words of a document: at most so many.
_FUNCTIONS = 6


def _spoken_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module of each document: a function for each of its first words, which calls the next one, and one of the next document's."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{3,12})"), 1)), 1, _FUNCTIONS)
    docs = _documents(spark, sf_dir).where("doc_id is not null").select(F.col("doc_id").alias("i"), words.alias("w"))
    after = docs.select((F.col("i") - 1).alias("i"), F.coalesce(F.get("w", F.lit(0)), F.lit("absent")).alias("there"))
    docs = docs.join(after, "i", "left").withColumn("there", F.coalesce("there", F.lit("absent")))
    nxt = F.concat(F.lit("pkg.m"), (F.col("i") + 1).cast("string"))
    head = F.concat(F.lit("import os\nimport "), nxt, F.lit(" as mod\nfrom "), nxt, F.lit(" import f_"), F.col("there"), F.lit(" as other\n\n"))
    one = lambda w, k: F.concat(F.lit("def f_"), w, F.lit("(x):\n    f_"), F.coalesce(F.get("w", k + 1), F.get("w", F.lit(0))), F.lit("(x)\n    other(x)\n    mod.f_"), F.col("there"), F.lit("(os.getcwd())\n\n"))
    last = F.concat(F.lit("class C"), F.col("i").cast("string"), F.lit(":\n    def run(self):\n        self.stop(missing())\n\n    def stop(self, x):\n        return x\n"))
    return docs.select(F.concat(F.lit("pkg/m"), F.col("i").cast("string"), F.lit(".py")).alias("path"), F.concat(head, F.array_join(F.transform("w", one), ""), last).alias("content"))


_SPOKEN = f"""with w as (select doc_id as i, list_distinct_in_order[1:{_FUNCTIONS}] as w from (select doc_id, list_filter(a, lambda x, k: list_position(a, x) = k) as list_distinct_in_order from (
    select doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z]{{3,12}})', 1) as a from documents where doc_id is not null) q) z),
m as (select a.i, a.w, coalesce(b.w[1], 'absent') as there, b.w[1] is not null as known, 'pkg.m' || a.i as me, 'pkg.m' || (a.i + 1) as nxt from w a left join w b on b.i = a.i + 1),
f as (select *, unnest(range(1, len(w) + 1)) as t from m),
calls as (select 'pkg/m' || i || '.py' as path, me || '.f_' || w[t] as owner, unnest(['f_' || coalesce(w[t + 1], w[1]), 'other', 'mod.f_' || there, 'os.getcwd']) as name,
    unnest([me || '.f_' || coalesce(w[t + 1], w[1]), nxt || '.f_' || there, nxt || '.f_' || there, 'os.getcwd']) as target, unnest([true, known, known, false]) as resolved from f
  union all select 'pkg/m' || i || '.py', me || '.C' || i || '.run', unnest(['self.stop', 'missing']), unnest([me || '.C' || i || '.stop', 'missing']), unnest([true, false]) from m)"""


@registered(f"{_SPOKEN} select path, owner, name, target, resolved from calls")
def g5_resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between modules that differ by their documents' words, with the qualified names that they mean."""
    return pygraph.resolved_calls(pygraph.python_graph(_spoken_modules(spark, sf_dir))).select("path", "owner", "name", "target", "resolved")


@registered(f"""{_SPOKEN} select (select count(*) from m) as modules, (select sum(len(w) + 3)::bigint from m) as symbols, (select count(*) * 2 from m)::bigint as imports, 0::bigint as parse_errors,
  (select count(*) from calls) as call_sites, (select count(*) from calls where resolved) as resolved_calls""")
def a12_call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = pygraph.python_graph(_spoken_modules(spark, sf_dir))
    return pygraph.graph_totals(graph, pygraph.resolved_calls(graph))


@registered(f"{_SPOKEN} select 'pkg/m' || i || '.py' as path, 'f_' || w[t] as name, me || '.f_' || w[t] as symbol from f")
def g1_spoken_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of modules that differ by row."""
    rows = pygraph.symbol_table(pygraph.python_graph(_spoken_modules(spark, sf_dir))).where("kind = 'function' and symbol like '%.f!_%' escape '!'")
    return rows.select("path", F.substring_index("symbol", ".", -1).alias("name"), "symbol")


@registered(f"{_SPOKEN} select target, count(*) as calls, count(distinct path) as modules from calls where resolved group by target order by calls desc, target limit 40")
def j17_most_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = pygraph.resolved_calls(pygraph.python_graph(_spoken_modules(spark, sf_dir))).where("resolved")
    return calls.groupBy("target").agg(F.count("*").alias("calls"), F.countDistinct("path").alias("modules")).orderBy(F.desc("calls"), "target").limit(40)


@registered(plan(DUCK, catalog.related_tests_sql(DUCK)))
def j12_related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of new and modified files, of changed stems, and those whose text holds a changed stem: one automaton for all stems."""
    engine = Engine.from_documents(spark, sf_dir)
    changed = engine.relation("diff").where("status in ('new', 'modified')").select("path")
    return related.related_tests(engine.relation("files"), engine.sql("select path, content from corpus"), changed)


@registered(plan(DUCK, "select count(*) as files, sum(size)::bigint as bytes, sum(line_count)::bigint as lines, count(*) filter (line_count = 0) as empty, true as timed from files"))
def o18_scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan counted while it stored its facts."""
    m = Engine.from_documents(spark, sf_dir).measured
    return spark.range(1).select(*[F.lit(int(m[k])).cast("long").alias(k) for k in ("files", "bytes", "lines", "empty")], F.lit(m["scan_seconds"] > 0).alias("timed"))


@registered(plan(DUCK, "select name, budget from (select 'scan_seconds' as name, 0::double as budget, 1 as actual union all select 'files', 150, total_files from metrics union all select 'context_tokens', 10, compact_tokens from llm_readiness) b where actual > budget"))
def a20_measured_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets that the scan went over, its duration among them."""
    return state.budget_alerts(Engine.from_documents(spark, sf_dir), {"scan_seconds": 0, "files": 150, "context_tokens": 10, "other": 1}).select("name", "budget")


@registered("""with t as (select conv_id, turn, (length(trim(coalesce(text, ''), ' ')) + 3) // 4 as n from conversations),
e as (select conv_id, sum(n)::bigint as full_tokens, max_by(n, turn)::bigint as emitted from t group by conv_id),
s as (select sum(full_tokens)::bigint as full_tokens, sum(emitted)::bigint as emitted_tokens from e)
select full_tokens, emitted_tokens, greatest(0, full_tokens - emitted_tokens) as saved, case when full_tokens <= 0 then 0.0 else greatest(0.0, round_even(100 * (1 - emitted_tokens / full_tokens::double), 0)) end as percent from s""")
def r2_st14_savings_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers recorded with their savings, a third of them twice and all of them again: each counts once."""
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    n = F.floor((F.length(F.trim(F.coalesce("text", F.lit("")))) + 3) / 4)
    events = turns.groupBy("conv_id").agg(F.sum(n).alias("full_tokens"), F.max_by(n, F.col("turn")).alias("emitted_tokens"))
    events = events.select(F.lit("2024").alias("ts"), F.lit("ask").alias("command"), F.col("conv_id").cast("string").alias("scan"), "full_tokens", "emitted_tokens")
    tables = state.Tables(spark, f"{work_dir(spark)}/kb")
    tables.record_once(events.unionByName(events.where("cast(scan as long) % 3 = 0")))
    return tables.record_once(events)


@registered(plan(DUCK, "select path, cast(to_json({'extension': extension, 'imports': imports, 'line_count': line_count, 'path': path, 'role': role, 'symbols': symbols}) as varchar) as json from files"))
def p13_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's facts as JSON with sorted keys."""
    names = sorted(["path", "extension", "role", "line_count", "imports", "symbols"])
    return Engine.from_documents(spark, sf_dir).relation("files").select("path", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))


#: Beside the rules that there are: each kind of condition, alone and together, and names that SQL would stumble over.
_RULES = [
    *PATTERNS,
    {"name": "it's \"quoted\"", "description": "a \\ b", "extension_in": [".GO"]},
    {"name": "entry in src", "description": "", "path_contains_any": ["SRC/", "nowhere"], "requires_main": True, "extension_in": [".py", ".cpp"]},
    {"name": "frameworks", "description": "by import", "import_contains_any": ["FastAPI", "lib1"], "file_name_in": ["main.py"]},
    {"name": "no such file", "description": "", "import_contains_any": ["fastapi"], "extension_in": [".md"]},
    {"name": "folders", "description": "all there", "requires_directories": ["Docs", "vendor", "src"]},
    {"name": "no such folder", "description": "", "requires_directories": ["docs", "nowhere"]},
    {"name": "both", "description": "", "requires_directories": ["src"], "file_name_in": ["package.json"]},
    {"name": "anything", "description": ""},
    {"description": "without a name", "requires_directories": []},
]


@registered(plan(DUCK, patterns_sql(DUCK, _RULES)))
def p3_p4_rules_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a table of rules hold."""
    return rules.matching_rules(Engine.from_documents(spark, sf_dir).relation("files"), *rules.rule_table(spark, _RULES))


@registered(plan(DUCK, "select cast(row_number() over (order by path) as bigint) as k, path, size, line_count from files"))
def w1_ordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts in the order of their paths, as a scan lists them."""
    return state.numbered(Engine.from_documents(spark, sf_dir).relation("files").select("path", "size", "line_count"), ["path"], "k").select("k", "path", "size", "line_count")


#: Classes of one coverage report, about.
_CLASSES = 10_000


@registered("select 'd' || doc_id || '.py' as filename, n / 1000.0::double as line_rate, round_even(n / 1000.0::double * 100, 1) as percent from (select doc_id, length(coalesce(text, '')) % 1000 as n from documents) x")
def s12_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage files with a class for each document, read back."""
    at, rate = f"{work_dir(spark)}/coverage", F.concat(F.lit("0."), F.lpad((F.length(F.coalesce("text", F.lit(""))) % 1000).cast("string"), 3, "0"))
    one = F.concat(F.lit('<class name="x" filename="d'), F.col("doc_id").cast("string"), F.lit('.py" line-rate="'), rate, F.lit('"><lines/></class>'))
    # A report is one document with its classes below it, a file of some megabyte: as many reports as that makes, not one for each hundred
    # classes, since each file that is listed and opened costs the same however short it is.
    docs = _documents(spark, sf_dir)
    shards = -(-docs.count() // _CLASSES) or 1
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.lit(1).alias("ord"), one.alias("value"))
    ends = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.create_map(F.lit(0), F.lit("<coverage><classes>"), F.lit(2), F.lit("</classes></coverage>"))).alias("ord", "value"))
    rows.unionByName(ends).repartition(shards, "shard").sortWithinPartitions("shard", "ord").select("shard", "value").write.partitionBy("shard").text(at)
    return files.coverage_report(spark, at).select("filename", "line_rate", "percent")


_HIDDEN = "select distinct case when line_count % 3 = 0 then path else regexp_replace(path, '/[^/]*$', '') end as path from files where line_count % 7 = 0 and contains(path, '/')"


@registered(plan(DUCK, f"select f.path from files f where not exists (select 1 from ({_HIDDEN}) h where f.path = h.path or starts_with(f.path, h.path || '/'))"))
def s22_without_own_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not, and are not below, paths that a scan leaves out."""
    engine = Engine.from_documents(spark, sf_dir)
    return files.without_ignored(engine.relation("files").select("path"), engine.sql(_HIDDEN))


@registered(plan(DUCK, "select path, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.') as module from files where ends_with(path, '.py') and not list_has_any(string_split(path, '/'), ['.git', '__pycache__', '.venv', 'venv', 'node_modules', 'dist', 'build', '.mypy_cache', '.pytest_cache', 'site-packages'])"))
def s23_python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pygraph.python_sources(Engine.from_documents(spark, sf_dir).relation("files").select("path")).select("path", "module")


@registered(plan(DUCK, """select 'issue' as what, file as key, type || ': ' || message as value from all_issues union all select 'issue', 'README.md', 'manual: look at it'
  union all select * from (select 'decision', cast(rank as varchar), title || ' because ' || reason from suggestions order by rank desc limit 3) d
  union all select 'file', path, hash from files where line_count % 5 <> 0 union all select 'file', path, 'changed' from files where line_count % 5 = 0 and line_count % 10 <> 0"""))
def st8_st11_st19_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues replaced and one added, decisions appended and the newest listed, files updated and removed; all in state tables."""
    engine, tables = Engine.from_documents(spark, sf_dir), state.Tables(spark, f"{work_dir(spark)}/kb")
    every = engine.relation("files").select("path", "hash", "line_count")
    tables.replace_issues(engine.relation("all_issues").limit(1).select("type", "severity", "category", "file", "message"))
    tables.replace_issues(engine.relation("all_issues").select("type", "severity", "category", "file", "message"))
    tables.add_issue("1", "look at it", file="README.md")
    tables.append("decisions", engine.relation("suggestions").select(F.lpad(F.col("rank").cast("string"), 3, "0").alias("ts"), F.col("title").alias("decision"), "reason"))
    tables.sync_files(every, every.limit(0).select("path"))
    tables.sync_files(every.where("line_count % 5 = 0 and line_count % 10 <> 0").withColumn("hash", F.lit("changed")), every.where("line_count % 10 = 0").select("path"))
    said = tables.read("issues").select(F.lit("issue").alias("what"), F.col("file").alias("key"), F.concat("type", F.lit(": "), "message").alias("value"))
    said = said.unionByName(tables.last("decisions", 3).select(F.lit("decision").alias("what"), F.col("ts").cast("int").cast("string").alias("key"), F.concat("decision", F.lit(" because "), "reason").alias("value")))
    return said.unionByName(tables.read("files").select(F.lit("file").alias("what"), F.col("path").alias("key"), F.col("hash").alias("value")))


@registered(plan(DUCK, """select '1' as ts, total_files as new_count, 0::bigint as modified_count, 0::bigint as deleted_count, score as health_score, total_files as files_scanned, title as top_suggestion from metrics cross join health cross join (select title from suggestions where rank = 1) s
  union all select '2', 0, 0, 0, score, total_files, title from metrics cross join health cross join (select title from suggestions where rank = 1) s"""))
def st16_scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of one state: all files are new, then none is."""
    engine, tables = Engine.from_documents(spark, sf_dir), state.Tables(spark, f"{work_dir(spark)}/kb")
    for ts in ("1", "2"):
        state.scan_once(engine, tables, ts)
    return tables.last("scans").select("ts", "new_count", "modified_count", "deleted_count", "health_score", "files_scanned", "top_suggestion")
