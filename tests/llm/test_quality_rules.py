from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from tidemark.llm import quality_rules

DOCS = "doc_id long, text string, kept string, _qr_x int, w string"


def brute(rows, trusted, buckets=1 << 14, threshold=-0.06):
    def grams(w):
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        two = [xxhash.xxh64_intdigest(y.to_bytes(8, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)) for x, y in zip(one, one[1:])]  # noqa: B905
        return [h // (2**64 // buckets) for h in one + two]

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    raw, target = Counter(), Counter()
    for r in rows:
        g = grams(split(r[1]))
        raw.update(g)
        if r[0] in trusted:
            target.update(g)
    n, t = sum(raw.values()) + buckets, sum(target.values()) + buckets
    out = []
    for r in rows:
        text, w = r[1] or "", split(r[1])
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if split(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        g = grams(w)
        score = sum(math.log((target[b] + 1) / t) - math.log((raw[b] + 1) / n) for b in g) / len(g) if g and target else 0.0 if g else None
        out.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, score, not failed and score >= threshold))
    return out


def corpus():
    rng = random.Random(8)
    vocabulary = ["the", "of", "né", "x😀", "A&B"] + [f"w{i}" for i in range(60)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [None, "", " \n ", "one", "a\x85b c\xa0d", "k " * 500, "a b c d e f g h " * 3, "l1 x\nl1 x\n\nl1 x\n \nl2"]
    texts += [prose(rng.randint(1, 200)) for _ in range(60)]
    texts += ["\n".join([prose(12)] * rng.randint(1, 4)) + " " + prose(rng.randint(1, 90)) for _ in range(40)]
    texts += [" ".join(f"{rng.choice(vocabulary)}###" for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "k", 1, "w") for i, t in enumerate(texts)]
    return rows + [(9, texts[9], "k", 1, "w"), (None, texts[10], None, None, None)]


def check(spark, rows, trusted):
    got = quality_rules.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i,) for i in trusted], "doc_id long"))
    assert got.columns == ["doc_id", "text", "kept", "_qr_x", "w", "quality_rules"]
    key = lambda r: tuple(str(x) for x in r[:7])
    found, want = sorted(((r.doc_id, *r.quality_rules) for r in got.collect()), key=key), sorted(brute(rows, set(trusted)), key=key)
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert f[:7] == w[:7] and f[8] == w[8]
        assert f[7] == pytest.approx(w[7])


def test_matches_brute_force(spark):
    check(spark, corpus(), [*range(8, 108), 3, 3])


def test_shuffled_join_and_no_trusted(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)
    check(spark, corpus()[:40], [8, 9, 10])
    check(spark, corpus()[:40], [])


def test_empty_table(spark):
    assert quality_rules.score(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long")).count() == 0
