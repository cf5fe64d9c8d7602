from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.llm import mixing

DOCS = "doc_id long, text string, source string, size string, target string"


def brute_targets(sizes, weights, budget, cap):
    fixed = {}
    while True:
        open_ = [s for s in sizes if s not in fixed]
        if not open_:
            return fixed
        level = (budget - sum(fixed.values())) / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > cap * sizes[s]]
        if not over:
            return fixed | {s: weights[s] * level for s in open_}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_caps_and_reruns(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        source = rng.choice(["big"] * 12 + ["a", "b", "é", "zz", None, "tiny"])
        text = rng.choice([None, "", "   "]) if rng.random() < 0.05 else "w " * rng.randint(1, 40)
        rows.append((i, text, source, "x", "y"))
    rows += [(3, "w w w", "a", "x", "y"), (3, "w w w", "a", "x", "y"), (None, "w w", "b", None, None), (None, "w w", "b", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, order = {}, sorted({r[2] for r in rows if r[2] is not None}) + [None]
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = brute_targets(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = mixing.mix(df.orderBy(F.rand(4))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a", "", ""), (2, " ", None, "", "")], DOCS)).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]
