from __future__ import annotations

import math
import random

from tidemark.llm import topk_search

TABLE = "vec_id long, embedding array<float>, score string, id string"


def brute(rows, every, k, scale=256):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(scale * x) for x in v]
    out = []
    for q in sorted(good):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q and len(good[c]) == len(good[q]))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "VECTOR_BLOCK", 60)
    rng = random.Random(2)
    f = lambda: rng.randint(-2048, 2048) / 1024
    rows = [(i, [f() * (1 if d < 6 else 0.1) for d in range(40)], "a", "b") for i in range(300)]
    rows += [(i, list(rows[i % 7][1]), None, None) for i in range(300, 340)]
    rows += [(400, None, "", ""), (401, [], "", ""), (450, [], "", ""), (402, [1.0, None], "", ""), (403, [float("nan")] * 40, "", ""), (404, [float("inf")] * 40, "", ""), (None, [1.0] * 40, "", ""), (500, [1.0, 2.0], "", ""), (501, [3.0, 1.0], "", "")]
    df = spark.createDataFrame(rows, TABLE).repartition(5)
    for wave_bytes in (64 << 20, 1000):  # one wave, and a query or two a wave
        got = sorted(map(tuple, topk_search.top_k(df, lambda i: i % 50 == 0, wave_bytes=wave_bytes).collect()))
        assert got == brute(rows, 50, 5)


def test_huge_components_and_empty(spark):
    rows = [(0, [3.0e4, -2.0], "", ""), (1, [1.0e12, 1.0], "", ""), (2, [-1.0e12, 1.0], "", "")]
    got = sorted(map(tuple, topk_search.top_k(spark.createDataFrame(rows, TABLE), lambda i: i % 50 == 0).collect()))
    assert [r[2] for r in got] == [1, 2] and got[0][3] > 0 > got[1][3]
    assert topk_search.top_k(spark.createDataFrame([], TABLE), lambda i: i % 50 == 0).count() == 0
