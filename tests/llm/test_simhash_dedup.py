from __future__ import annotations

import random

import xxhash

from tidemark.llm import simhash_dedup
from tidemark.llm.common import connected

DOCS = "doc_id long, text string, fp string, component_id int, key string"


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_matches_brute_force_with_awkward_texts(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice(["the", "of", "Anre", "blé", "x y", "ß"]) for _ in range(400))
    texts = [None, "", " \n\t", "one", "one two", "One\vTWO three", "one two three", base, base, base + " tail", base.upper(), "x " * 3000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = [(i if i != 5 else None, t, "clash", 1, None) for i, t in enumerate(texts)] + [(7, base, "clash", 1, None)]
    got = simhash_dedup.components(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    fps = {r[0]: brute_fp(r[1]) for r in rows}
    roots = brute_components(set(fps.values()))
    first = {}
    for d, f in fps.items():
        if d is not None:
            first[roots[f]] = min(first.get(roots[f], d), d)
    for r in got:
        assert r.fp & (2**64 - 1) == fps[r.doc_id]
        assert r.component_id == first.get(roots[fps[r.doc_id]])


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    fps = {center}
    for _ in range(260):
        f = rng.choice(sorted(fps)) if rng.random() < 0.5 else center
        for _ in range(rng.choice([1, 2, 3, 5])):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = brute_components(fps)
    for limit, long_keys, broadcast_keys in ((2, 1 << 27, 10**6), (10, 1 << 27, 0), (10_000, 1 << 27, 10**6), (2, 1, 10**6), (6, 1, 0), (10_000, 1, 10**6)):
        edges = simhash_dedup.links(df, 2, limit, long_keys, broadcast_keys)
        got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in connected(edges).collect()}
        groups = lambda m: {frozenset(k for k in fps if m.get(k, k) == r) for r in {m.get(k, k) for k in fps}}
        assert groups(got) == groups(want)


def test_long_keys_cover_every_pair_within_two_bits(spark):
    """Each pair of the fingerprints that is two bits apart meets under a key with a piece of the other half."""
    rng = random.Random(11)
    pairs = []
    for i in range(64):
        for j in rng.sample(range(64), 12):
            f = rng.getrandbits(64)
            pairs.append((f, f ^ (1 << i) ^ ((1 << j) if j != i else 0)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for p in pairs for f in p], "fp long").distinct()
    found = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in simhash_dedup.links(df, long_keys=1).collect()}
    assert {frozenset(p) for p in pairs} <= found


def test_empty_table(spark):
    assert simhash_dedup.components(spark.createDataFrame([], DOCS)).count() == 0
