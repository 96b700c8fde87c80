"""Prefix trie of conversations, encoded by preorder intervals.

1. Turns are reduced to digests; the conversations are rebuilt by equality joins on their ids.
2. Conversations are ranked lexicographically, a prefix before what it begins. Up to BLOCK turns make a block; the distinct blocks are
   sorted over all tasks and named by their ranks, up to BLOCK names make a block of the next level, until one name is left of each
   conversation: three rounds for 32,768 turns, each over a thirty-second of the rows before.
3. A node is a depth and a digest of the turns so far (128 bits, an exclusive or of hashes of turn and place, as a prefix sum over all
   turns). Its members are the conversations of an interval of ranks; sorted by (first rank, depth) the nodes are in preorder.
4. The subtree of a node ends at the last node whose first rank is at most the node's last one. Leaves and savings are differences
   of prefix sums over the preorder between these two places.
5. The ids that end at a node are joined in pieces by tasks that hold ranges of (rank, id), and hashed piece after piece.

No step holds a conversation, a node's members or a node's children together: all are partial sums, range sorts and equality joins.

Cases: rows without conv_id belong to no conversation; null role or text is empty; of equal turns (or null ones, which come first) the
order is that of the digests of role and text, so repeated rows each count and reruns agree; a conversation may be rebuilt to no
turns and is then a member of the root alone; an empty table has no conversation and so no node, not even the root; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .scan import prefix_sums

BLOCK = 32
#: How conversations are rebuilt: of each family of so many ids the first lends up to MOST_LENT turns.
FAMILY, MOST_LENT = 5, 8


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place, from 0), key (digest of role and text), bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    return prefix_sums(rows, ["conv_id"], ["turn", "key"], tag="turns").select("conv_id", "at", "key", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 1, key, bytes) of the rebuilt conversations, and (conv_id, len) of all of them, also of those without turns."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base, lent = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string")) % (MOST_LENT + 1)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    info = convs.withColumn("base", base).withColumn("h", lent).join(bases, "base", "left").withColumn("kept", F.least("h", F.coalesce("there", F.lit(0))))
    info = written(info.select("conv_id", "base", "h", "kept", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    own = turns.withColumn("h", lent).where("at >= h").join(info.select("conv_id", "kept"), "conv_id").select("conv_id", (F.col("at") - F.col("h") + F.col("kept") + 1).alias("pos"), "key", "bytes")
    first = turns.where(F.col("at") < MOST_LENT).withColumnRenamed("conv_id", "base")
    given = info.select("conv_id", "base", "kept").join(first, "base").where("at < kept").select("conv_id", (F.col("at") + 1).alias("pos"), "key", "bytes")
    return own.unionByName(given), info.select("conv_id", "len")


def _joined(value: Column, place: str) -> Column:
    """Values of a group of BLOCK rows at most, in order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, value.alias("v")))), lambda x: x["v"]), "")


def ranked(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, len, rank: the lexicographic rank of the conversation's turns among the distinct ones, prefixes first."""
    blocks = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(_joined(F.col("key"), "pos").alias("name"))
    blocks = blocks.unionByName(convs.where("len = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit("").alias("name")))
    while True:
        named = prefix_sums(blocks, ["name"], ["conv_id", "block"], tag="names").select("conv_id", "block", "seg")
        if (named.agg(F.max("block")).first()[0] or 0) == 0:
            return named.join(convs, "conv_id").select("conv_id", "len", F.col("seg").alias("rank"))
        name = F.lpad(F.hex("seg"), 16, "0")
        blocks = named.groupBy("conv_id", F.floor(F.col("block") / BLOCK).alias("up")).agg(_joined(name, "block").alias("name")).withColumnRenamed("up", "block")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by (rank, conv_id) -> rank, len, first id, the ids of a batch joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rank, ids = np.asarray(batch.column("rank")), batch.column("conv_id").to_pylist()
        starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        joined = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        lens = np.asarray(batch.column("len"))[starts]
        yield pa.RecordBatch.from_arrays([pa.array(rank[starts]), pa.array(lens), pa.array([ids[i] for i in starts], pa.int64()), pa.array(joined)], ["rank", "len", "first_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (rank, first id) -> rank, len, SHA-256 of all ids of the rank; a piece at a time."""
    at, length, sha = None, 0, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([length]), pa.array([sha.hexdigest()])], ["rank", "len", "sha"])
    for batch in batches:
        out: list[tuple] = []
        for rank, n, ids in zip(*(batch.column(c).to_pylist() for c in ("rank", "len", "ids")), strict=True):
            if rank != at:
                if sha is not None:
                    out.append((at, length, sha.hexdigest()))
                at, length, sha = rank, n, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["rank", "len", "sha"])
    if sha is not None:
        yield row()


def ends_of(ranks: DataFrame) -> DataFrame:
    """first (the rank), depth, ends_sha256: of the ids of the conversations that are equal to it, ascending."""
    pieces = ranks.repartitionByRange("rank", "conv_id").sortWithinPartitions("rank", "conv_id").mapInArrow(_pieces, "rank long, len long, first_id long, ids string")
    whole = pieces.repartition("rank").sortWithinPartitions("rank", "first_id").mapInArrow(_digests, "rank long, len long, sha string")
    return whole.select(F.col("rank").alias("first"), F.col("len").alias("depth"), F.col("sha").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end."""
    turns, convs = rebuilt(turns_of(conversations))
    turns = turns.withColumn("a", F.xxhash64("pos", "key")).withColumn("b", F.xxhash64(F.lit("second"), "key", "pos"))
    turns = prefix_sums(turns, ["conv_id"], ["pos"], xors=["a", "b"], tag="prefixes")
    ranks = written(ranked(turns, convs), "ranks")
    zero = F.lit(0).cast("long")
    rows = turns.join(ranks, "conv_id").select("conv_id", "len", "rank", F.col("pos").alias("depth"), "bytes", "a", "run_a", "run_b", F.col("run_a").bitwiseXOR(F.col("a")).alias("up_a"), F.col("run_b").bitwiseXOR(F.col("b")).alias("up_b"))
    rows = rows.unionByName(ranks.select("conv_id", "len", "rank", *[zero.alias(c) for c in ("depth", "bytes", "a", "run_a", "run_b", "up_a", "up_b")]))
    nodes = rows.groupBy("depth", "run_a", "run_b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("len").alias("longest"),
        F.min("bytes").alias("bytes"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("a").alias("a"), F.max("a").alias("a_max"),
    )
    # Members of a node have the same last turn; the digests of two sequences that differ must not be the same.
    nodes = nodes.withColumn("same", F.when(F.col("a") == F.col("a_max"), F.lit(1)).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("int")))
    nodes = nodes.where("same = 1").drop("a", "a_max", "same").withColumn("saves", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("longest") == F.col("depth")).cast("long"))
    placed = written(prefix_sums(nodes, [], ["first", "depth"], sums=["saves", "leaf"], tag="preorder").drop("seg", "longest", "bytes"), "nodes")
    # The last node in preorder of each first rank; sums never fall, so the largest are its.
    ends = placed.groupBy("first").agg(F.max("at").alias("subtree_end"), F.max("run_saves").alias("end_saves"), F.max("run_leaf").alias("end_leaf")).withColumnRenamed("first", "last")
    up = placed.select((F.col("depth") + 1).alias("depth"), F.col("run_a").alias("up_a"), F.col("run_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    below = placed.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("run_a"), F.col("up_b").alias("run_b")).agg(F.count("*").alias("children"))
    found = placed.join(below, ["depth", "run_a", "run_b"], "left").join(up, ["depth", "up_a", "up_b"], "left").join(ends, "last").join(ends_of(ranks), ["first", "depth"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", zero).alias("n_children"), (F.col("end_leaf") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saves") - F.col("run_saves") + F.col("saves")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("at").alias("preorder"), "subtree_end",
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


#: CRC-32 of a text of ASCII digits, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split({0}, ''), lambda s: ord(s)::bigint), lambda c, x:
  list_reduce([0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384), xor(c, x)), 4294967295::bigint), 4294967295::bigint)"""

#: The same in DuckDB: every node with every one of its prefixes.
ORACLE = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
k as (select conv_id, turn, left(sha256(length(role) || ':' || role || text), 32) as k, strlen(text)::bigint as bytes from t),
o as (select conv_id, k, bytes, row_number() over (partition by conv_id order by turn nulls first, k) as p from k),
c as (select conv_id, count(*) as n, conv_id - conv_id % 5 as base, {_CRC32.format('conv_id::varchar')} % 9 as h from o group by conv_id),
i as (select c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) as kept from c left join c b on b.conv_id = c.base),
r as (select i.conv_id, o.p, o.k, o.bytes from i join o on o.conv_id = i.base where o.p <= i.kept
  union all select i.conv_id, o.p - i.h + i.kept, o.k, o.bytes from i join o on o.conv_id = i.conv_id where o.p > i.h),
m as (select conv_id, string_agg(k, '') over (partition by conv_id order by p) as path, bytes from r union all select conv_id, '', 0 from c),
n as (select path, min(conv_id) as conv_id, count(*) as n_convs, min(bytes) as bytes, (length(path) // 32)::bigint as depth from m group by path),
kids as (select left(path, length(path) - 32) as path, count(*) as n_children from n where path <> '' group by 1),
full_n as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (path)),
above as (select left(path, (32 * d)::int) as path, sum((n_convs - 1) * bytes)::bigint as saved, count(*) filter (n_children = 0) as leaves from (select *, unnest(range(0, depth + 1)) as d from full_n) x group by 1),
whole as (select conv_id, arg_max(path, length(path)) as path from m group by conv_id),
e as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from whole group by path)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, a.leaves as n_leaves, a.saved as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from full_n f join above a using (path) left join n u on f.path <> '' and u.path = left(f.path, length(f.path) - 32) left join e on e.path = f.path
"""
