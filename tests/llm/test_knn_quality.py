from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import knn_quality, registry

DOCS = "doc_id long, text string, label int, score double, x string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "é"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(25, 90))]
        bad = rng.random() < 0.3
        kind = rng.randrange(3)
        if bad:
            words = [w + "###" if kind == 0 else w.upper() + "!!" for w in words] if kind < 2 else [w for w in words for _ in range(5)]
        docs.append((i, " ".join(words), 7, 0.1, "x"))
        if rng.random() < 0.7:
            labels.append((i, 0 if bad else 1, 0, "t"))
    return docs, labels, {d[0]: int(not ("###" in d[1] or "!!" in d[1] or len(set(d[1].split())) * 3 < len(d[1].split()))) for d in docs}


def test_held_out_accuracy_and_contract(spark, tmp_path):
    docs, labels, truth = corpus()
    docs += [(900, None, 1, 0.1, "x"), (901, "", 1, 0.1, "x"), (902, "re " * 20000, 1, 0.1, "x"), (None, "anre tion", 1, 0.1, "x"), (3, docs[3][1], 1, 0.1, "x")]
    labels += [(None, 1, 0, ""), (5, None, 0, ""), (900, 1, 0, ""), (901, 0, 0, ""), (901, 1, 0, "")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.op9_knn_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    back = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in set(back)) for i in truth)
    assert np.mean([by[i].predicted == truth[i] for i in back]) >= 0.93


def test_vote_is_the_exact_neighbours(spark):
    docs, labels, _ = corpus(120)
    x = np.array([knn_quality.features(d[1]) for d in docs])
    y = np.array([float(i % 2) for i in range(len(x))])
    space = knn_quality.fit(x, y, rank=8)
    v = space.latent(x)
    for i, score in enumerate(space.vote(x)):
        sims = v @ v[i]
        near = np.argsort(-sims)[: knn_quality.VOTERS]
        w = np.maximum(sims[near], 0) ** 4
        assert abs(score - (w * y[near]).sum() / w.sum()) < 1e-3


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame(corpus(5)[0], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert knn_quality.train(df, none, ~registry.held_out()) is None
    assert {r.score for r in knn_quality.classify(df, None).collect()} == {0.5}
    assert knn_quality.classify(spark.createDataFrame([], DOCS), None).count() == 0


def brute_features(text):
    """The terms of a text one by one: words, n-grams of character classes, repetition."""
    import xxhash

    mask, counts = 0xFFFFFFFF, {}
    words = (text or "").encode().split()
    if not words:
        return {}

    def kind(x):
        if x == "\n":
            return 6
        if x.isalpha() and not x.isupper():
            return 1
        if x.isupper():
            return 2
        if x.isdigit():
            return 3
        if x.isspace():
            return 4
        return 16 + ord(x) if ord(x) < 128 else 5

    h = [xxhash.xxh32_intdigest(w, 5) for w in words]
    for x in h:
        counts[x >> 22] = counts.get(x >> 22, 0) + 1
    c = []
    for x in map(kind, text):
        if not c or c[-1] != x:
            c.append(x)
    for i in range(len(c)):
        v = c[i]
        for n in range(4):
            at = 1024 + ((v * 2246822519 & mask) >> 22)
            counts[at] = counts.get(at, 0) + 1
            if i + n + 1 >= len(c):
                break
            v = (v * 2654435761 + c[i + n + 1]) & mask
    pairs = list(zip(h[1:], h, strict=False))
    counts[2048], counts[2049], counts[2050] = sum(a == b for a, b in pairs), len(pairs) - len(set(pairs)), max(0, 20 - len(words))
    return {k: (v / len(words)) ** 0.5 for k, v in counts.items() if v}


def test_scores_match_brute_force(spark, tmp_path):
    """Every score again, from features made anew and all cosines by loops, in the fitted space."""
    docs, labels, _ = corpus(160, seed=6)
    docs.append((900, None, 1, 0.1, "x"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.score for r in registry.op9_knn_quality(spark, str(tmp_path)).collect()}
    space = knn_quality.train(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")), ~registry.held_out())
    assert len(space.vectors) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in labels)
    for i, text, *_ in docs:
        latent = [0.0] * space.project.shape[1]
        for term, v in brute_features(text).items():
            for r in range(len(latent)):
                latent[r] += v * space.project[term, r]
        norm = max(sum(v * v for v in latent) ** 0.5, 1e-12)
        sims = sorted(((sum(a * b for a, b in zip(latent, v, strict=True)) / norm, y) for v, y in zip(space.vectors, space.labels, strict=True)), key=lambda x: -x[0])[: knn_quality.VOTERS]
        w = [max(s, 0) ** 4 for s, _ in sims]
        want = sum(a * y for a, (_, y) in zip(w, sims, strict=True)) / sum(w) if sum(w) > 1e-6 else space.prior
        assert abs(got[i] - want) < 2e-3


def test_repeated_ids_teach_once(spark):
    docs, labels, _ = corpus(40)
    many = [(3, f"anre tion {i}", 1, 0.1, "x") for i in range(4000)]
    df = spark.createDataFrame(docs + many, DOCS).repartition(5)
    labelled = spark.createDataFrame([(i, 1 if i % 2 else 0, 0, "") for i in range(40)] * 3, LABELS)
    space = knn_quality.train(df, labelled, F.lit(True), sample=30)
    assert len(space.vectors) == 30
    again = knn_quality.train(df.orderBy(F.rand(2)), labelled, F.lit(True), sample=30)
    assert np.array_equal(space.vectors, again.vectors)
