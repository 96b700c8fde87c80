"""The conversation trie against a version that makes every prefix."""

import collections
import hashlib
import math
import random
import zlib

import pytest

from loam.llm import scan, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((-math.inf if t is None else t, digest(r or "", x or ""), (r or "", x or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members, below = collections.defaultdict(list), collections.defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                below[s[: d - 1]].add(s[:d])
    done, out = {}, []
    for s in sorted(members, key=len, reverse=True):
        saved = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(done[k][0] for k in below[s])
        leaves = sum(done[k][1] for k in below[s]) if below[s] else 1
        done[s] = saved, leaves
        ends = ",".join(str(c) for c in sorted(members[s]) if len(built[c]) == len(s))
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(below[s]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, schema=SCHEMA):
    got = trie.prefix_trie(spark.createDataFrame(rows, schema))
    return got, sorted((tuple(r)[:8] for r in got.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 101, 10**15]:
        if c % 7 == 3:
            continue
        n = rng.choice([1, 2, 3, 4, 9, 33, 70])
        same = rng.random() < 0.6  # many begin alike
        rows += [(c, rng.choice([t, t, None]) if t < 2 else t, rng.choice(["user", None]), f"é{t}" if same or rng.random() < 0.5 else rng.choice(["", None, f"x{c}", "y"])) for t in range(n)]
    rows += [(None, 1, "user", "nobody's")] + rows[:5]
    got, nodes = found(spark, rows)
    assert nodes == brute(rows)
    # The intervals nest: a node's subtree is the next n nodes of the preorder.
    by_place = sorted((r.preorder, r.subtree_end, r.depth) for r in got.collect())
    for at, end, depth in by_place:
        inside = by_place[at + 1 : end + 1]
        assert all(d > depth and e <= end for _, e, d in inside) and (end + 1 == len(by_place) or by_place[end + 1][2] <= depth)


def test_hot_conversation_and_copies(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(3000)] + [(c, 0, "user", "hello") for c in range(1000, 4000)]
    assert found(spark, rows)[1] == brute(rows)


def test_small_tables(spark):
    assert found(spark, [])[1] == []
    # conv 3 borrows from the absent 0 and has fewer turns than it gives up: no turns, the root's only member
    only = [(c, 1, "user", "a") for c in (3,)]
    assert found(spark, only)[1] == brute(only)
    wide = [(5, 1, "user", "a", 1, "x"), (6, 1, None, None, None, None)]
    assert found(spark, wide, SCHEMA + ", SEG long, name string")[1] == brute([r[:4] for r in wide])


def test_prefix_sums(spark):
    rows = [(i % 3 // 2, i, i * 7 % 11, i) for i in range(5000)]
    got = scan.prefix_sums(spark.createDataFrame(rows, "s long, o long, v long, x long").repartition(7), ["s"], ["o"], ["v"], ["x"]).collect()
    want, at, total, xor = {}, collections.Counter(), collections.Counter(), collections.Counter()
    for s, o, v, x in sorted(rows):
        total[s] += v
        xor[s] ^= x
        want[o] = (s, at[s], total[s], xor[s])
        at[s] += 1
    assert {r.o: (r.seg, r["at"], r.run_v, r.run_x) for r in got} == want
