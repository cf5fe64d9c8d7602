from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) if children[n] else 1
        saved[n] = sum(saved[k] for k in children[n]) + (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest()) for n, m in members.items()),
        key=str,
    )


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(df, registry.op13_source, registry.op13_head, 8, **more)
    assert all(kind == "bigint" for c, kind in got.dtypes if c != "ends_sha256")
    return sorted(map(tuple, got.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice("abc")) for c in range(60) if c % 7 for t in range(rng.randint(1, 12))]
    rows += [(200, None, None, None), (200, 0, "user", "é"), (201, 3, None, "x"), (None, 1, "user", "lost"), (202, 1, "u", "x"), (202, 1, "u", "x"), (202, 1, "u", "x")]
    return rows


@pytest.mark.parametrize("fan", [3, 1024])
def test_equals_brute_force(spark, fan):
    rows = corpus(fan)
    assert run(spark, rows, fan=fan) == brute(rows)


def test_long_chain_and_wide_node_in_few_rounds(spark):
    """A chain of 900 nodes, a star of 500 leaves, and a broom of both."""
    edges = [(0, None)] + [(i, i - 1) for i in range(1, 900)] + [(1000 + i, 0) for i in range(500)] + [(2000 + i, 899) for i in range(40)]
    tree = spark.createDataFrame([(i, p, i % 7, 1) for i, p in edges], "id long, parent long, w long, n long")
    got = {r.id: (r.w, r.n) for r in prefix_trie.contract(tree, ["w", "n"], max_rounds=30).collect()}
    wanted = {i: [i % 7, 1] for i, _ in edges}
    for i, p in sorted(edges, reverse=True):
        if p is not None:
            wanted[p][0] += wanted[i][0]
            wanted[p][1] += wanted[i][1]
    assert got == {i: tuple(v) for i, v in wanted.items()}


def test_one_conversation_over_many_partitions(spark):
    rows = [(5, t, "u", str(t % 3)) for t in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(4))
        assert numbered.select("i").distinct().count() == 700 and numbered.agg(F.max("i")).first()[0] == 699
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packed_ends_hash_like_one_list(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK", 10)
    ends = spark.createDataFrame([(1, 2, c) for c in range(-5, 95)] + [(3, 4, 7)], "k1 long, k2 long, conv_id long")
    wanted = {(1, 2): ",".join(map(str, range(-5, 95))), (3, 4): "7"}
    assert {(r.k1, r.k2): r.ends_sha256 for r in prefix_trie.end_hashes(ends).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in wanted.items()}


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "u", "x")]) == []
    rows = [(6, 0, "u", "x")]  # nothing before it to take, and its own turn is among those replaced
    assert run(spark, rows) == brute(rows)
