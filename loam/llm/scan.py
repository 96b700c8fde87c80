"""Prefix sums of a table in the order of its rows, spread over tasks.

The rows are dealt out by ranges of their order and sorted; each task numbers and sums its own, and of each task one row, its totals,
comes to the driver: as many rows as tasks. What went before a task is added to its rows afterwards. No task holds more than a batch,
and a segment of any size lies over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from .common import written


def _local(segment: Sequence[str], sums: Sequence[str], xors: Sequence[str]):
    """Numbers and sums the sorted rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: list | None = None
        seg, at, carry = -1, -1, {c: np.int64(0) for c in (*sums, *xors)}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in segment:
                column = batch.column(c)
                new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
            new[0] = last is None or last != [batch.column(c)[0].as_py() for c in segment]
            last = [batch.column(c)[n - 1].as_py() for c in segment]
            rows = np.arange(n)
            start = np.maximum.accumulate(np.where(new, rows, -1))  # where the row's segment begins, -1: before this batch
            begun, first = start >= 0, np.maximum(start, 0)
            segs = seg + np.cumsum(new)
            places = np.where(begun, rows - start, at + 1 + rows)
            out = [pa.array(np.full(n, part, np.int32)), pa.array(segs == 0), pa.array(segs), pa.array(places)]
            for c in sums:
                v = np.asarray(batch.column(c)).astype(np.int64)
                total = np.cumsum(v)
                total = np.where(begun, total - (total[first] - v[first]), total + carry[c])
                carry[c] = total[-1]
                out.append(pa.array(total))
            for c in xors:
                v = np.asarray(batch.column(c)).astype(np.int64)
                total = np.bitwise_xor.accumulate(v)
                total = np.where(begun, total ^ total[first] ^ v[first], total ^ carry[c])
                carry[c] = total[-1]
                out.append(pa.array(total))
            seg, at = int(segs[-1]), int(places[-1])
            names = [*batch.schema.names, "part", "head", "seg", "at", *[f"run_{c}" for c in (*sums, *xors)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names)

    return run


def prefix_sums(df: DataFrame, segment: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), xors: Sequence[str] = (), tag: str = "scan") -> DataFrame:
    """``df`` in the order of (segment, order), with seg (rank of the row's segment, from 0), at (its place there, from 0) and
    run_<c>: for c of ``sums`` the sum, for c of ``xors`` the exclusive or, of the segment's values up to the row.

    ``segment`` may be empty: one segment. Its columns have no nulls; those of ``order`` may (first); sums and xors are longs.
    """
    spark = df.sparkSession
    schema = StructType(list(df.schema.fields)).add("part", IntegerType()).add("head", BooleanType()).add("seg", LongType()).add("at", LongType())
    for c in (*sums, *xors):
        schema = schema.add(f"run_{c}", LongType())
    dealt = df.repartitionByRange(*segment, *order).sortWithinPartitions(*segment, *order)
    stored = written(dealt.mapInArrow(_local(segment, sums, xors), schema), tag)
    runs = [f"run_{c}" for c in (*sums, *xors)]
    key = F.struct(*segment) if segment else F.lit(0)
    ends = F.max(F.struct("seg", "at", *runs))
    parts = stored.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), ends.alias("end")).orderBy("part").collect()
    zero, offsets = (0,) * (1 + len(runs)), []
    known, tail, total = None, zero, 0
    for p in parts:
        goes_on = known is not None and known == p["first"]
        carry = tail if goes_on else zero
        base = total - 1 if goes_on else total
        offsets.append((p.part, base, *carry))
        end = (p.end["at"] + 1, *[p.end[r] for r in runs])
        if goes_on and p.end["seg"] == 0:
            added = [x + y for x, y in zip(end[: 1 + len(sums)], carry[: 1 + len(sums)], strict=True)]
            end = (*added, *[x ^ y for x, y in zip(end[1 + len(sums) :], carry[1 + len(sums) :], strict=True)])
        known, tail, total = p["last"], end, base + p.end["seg"] + 1
    names = ["part", "seg0", "at0", *[f"{r}0" for r in runs]]
    before = F.broadcast(spark.createDataFrame(offsets, ", ".join(f"{c} {'int' if c == 'part' else 'long'}" for c in names)))
    own = lambda c, how: F.when(F.col("head"), how(F.col(c), F.col(f"{c}0"))).otherwise(F.col(c)).alias(c)
    add, xor = (lambda x, y: x + y), (lambda x, y: x.bitwiseXOR(y))
    return stored.join(before, "part").select(
        *df.columns, (F.col("seg") + F.col("seg0")).alias("seg"), own("at", add), *[own(f"run_{c}", add) for c in sums], *[own(f"run_{c}", xor) for c in xors]
    )
