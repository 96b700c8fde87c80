"""Mixing sources to target weights: hash-threshold histograms.

Each document has a 48-bit hash of its doc_id. Words are summed by source and leading hash bits; the bucket in which a
source's running sum passes its budget is the only one that is looked into further, 12 bits at a time. What comes out is one
threshold for each source, so choosing documents is a filter on (source, hash): nothing is sorted, no text is shuffled, and a
source that holds a third of all rows is summed on the map side into 4,096 rows a task at most. For a smaller budget the same
hashes give a smaller threshold, so mixes of growing budgets are nested.

Cases: a null text has size 0; null is a source of its own, ordered last; rows with the same doc_id have the same hash and are
taken together; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, table, written

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, BITS = 4, 12
#: The sources are the mix's configuration: one number each is held by the driver and broadcast.
MAX_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """48 bits, uniform and the same in every run and every engine: the leading hexadecimal digits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit("mix "), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, LEVELS * BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], share: float, cap: int) -> list[float]:
    """Shares ``share`` times all sizes by weight; what exceeds ``cap`` times a size is shared again among the others."""
    left, open_ = Fraction(share) * sum(sizes), {i for i, s in enumerate(sizes) if s}
    out = [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] > Fraction(cap) * sizes[i] * total}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = Fraction(cap) * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= full
    return [float(x) for x in out]


def plan_mix(
    sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, max_sources: int = MAX_SOURCES
) -> DataFrame:
    """One row for each source: source, source_size, target, whole (copies that all get), threshold (below it: one more).

    ``sized`` has source, size and h. It is read once for the sums and once for each level, so pass a stored table.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("s")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold them")
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.s or 0) for r in rows]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    whole = [min(cap, int(t // s)) if s else 0 for t, s in zip(want, sizes, strict=True)]
    left = [max(0, round(t - w * s)) if w < cap else 0 for t, w, s in zip(want, whole, sizes, strict=True)]
    prefix = [0] * len(rows)
    open_ = [i for i in range(len(rows)) if left[i] > 0]
    for level in range(LEVELS):
        if not open_:
            break
        shift = (LEVELS - 1 - level) * BITS
        at = spark.createDataFrame(
            [(rows[i].source, prefix[i], left[i]) for i in open_], "source string, prefix long, budget long"
        )
        inside = (
            sized.join(F.broadcast(at.withColumnRenamed("source", "of")), sized.source.eqNullSafe(F.col("of")))
            .where(F.shiftrightunsigned("h", shift + BITS) == F.col("prefix"))
            .groupBy("source", "budget", F.shiftrightunsigned("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("s"))
        )
        up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        found = (
            inside.withColumn("upto", F.sum("s").over(up))
            .where("upto >= budget")
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "s")).alias("m"))
            .collect()
        )
        by = {r.source: r.m for r in found}
        nearer = []
        for i in open_:
            m = by.get(rows[i].source)
            if m is None:  # the budget lies at the bucket's end: all that is in it is taken
                prefix[i], left[i] = (prefix[i] + 1) << BITS, -1
                prefix[i] <<= shift
                continue
            before = left[i] - (m.upto - m.s)
            prefix[i] = m.bucket
            if level == LEVELS - 1:
                prefix[i] += int(2 * before >= m.s)  # the last document goes in if that comes nearer to the target
            else:
                left[i] = before
                nearer.append(i)
        open_ = nearer if level < LEVELS - 1 else []
    data = [
        (r.source, s, t, w, p if w < cap else 0)
        for r, s, t, w, p in zip(rows, sizes, want, whole, prefix, strict=True)
    ]
    return spark.createDataFrame(data, "source string, source_size long, target double, whole int, threshold long")


def with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and copies; ``plan`` has one row for each source (at most MAX_SOURCES), so it is broadcast."""
    plan = plan.withColumnRenamed("source", "of")
    return (
        sized.join(F.broadcast(plan), sized.source.eqNullSafe(F.col("of")))
        .withColumn("copies", F.col("whole") + (F.col("h") < F.col("threshold")).cast("int"))
        .drop("of", "whole", "threshold")
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = written(sized(table(spark, sf_dir, "documents")), "sizes")
    return with_copies(small, plan_mix(small)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with its number (from 1) in ``copy``.

    Where ``docs`` has columns of such names, they stay and the new one gets another: ``copy_``.
    """
    plan = plan_mix(written(sized(docs), "sizes"), **options)
    copy, of, whole, below, n = (fresh(c, docs.columns) for c in ("copy", "of", "whole", "below", "n"))
    plan = plan.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("threshold").alias(below))
    return (
        docs.join(F.broadcast(plan), docs["source"].cast("string").eqNullSafe(F.col(of)))
        .withColumn(n, F.col(whole) + (hash_of(F.col("doc_id")) < F.col(below)).cast("int"))
        .where(F.col(n) > 0)
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy))
    )


#: The same in DuckDB: the targets by filling up to the caps, then whole copies and the documents of the least hashes.
ORACLE = r"""
with d as (select doc_id, cast(source as varchar) as source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('mix ' || coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from d group by source),
full_ as (select *, row_number() over (order by 2.0 * source_size / w, source) as k from s where source_size > 0),
upto as (select *, coalesce(sum(2 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as capped, sum(w) over (order by k rows between current row and unbounded following) as open_w,
    (select sum(source_size) from s) as every from full_),
level as (select min(k) as k from upto where (3 * every - 2 * capped) * w <= 4 * source_size * open_w),
target as (select u.source, u.source_size, case when l.k is null or u.k < l.k then cast(2 * u.source_size as double)
    else cast((3 * b.every - 2 * b.capped) * u.w as double) / cast(2 * b.open_w as double) end as target from upto u cross join level l left join upto b on b.k = l.k
  union all select source, source_size, cast(0 as double) from s where source_size = 0),
plan as (select *, case when source_size > 0 then least(2, cast(floor(target / source_size) as int)) else 0 end as whole from target),
budget as (select *, case when whole < 2 then greatest(0, cast(round_even(target - whole * source_size, 0) as bigint)) else 0 end as budget from plan),
groups as (select source, h, sum(size) as size from d group by source, h),
run as (select g.*, b.budget, sum(g.size) over (partition by g.source order by g.h) as upto from groups g join budget b on g.source is not distinct from b.source where b.budget > 0),
edge as (select source, min(h) as h from run where upto >= budget group by source),
last as (select e.source, e.h + case when 2 * (r.budget - (r.upto - r.size)) >= r.size then 1 else 0 end as below from edge e join run r on e.source is not distinct from r.source and e.h = r.h)
select d.doc_id, d.size, b.source_size, b.target, cast(d.size * (b.whole + case when b.budget > 0 and (l.below is null or d.h < l.below) then 1 else 0 end) as bigint) as taken, d.source,
  cast(b.whole + case when b.budget > 0 and (l.below is null or d.h < l.below) then 1 else 0 end as int) as copies
from d join budget b on d.source is not distinct from b.source left join last l on d.source is not distinct from l.source
"""
