from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import substring_dedup

DOCS = "doc_id long, text string, key string, at int, lo double"


def brute(rows, width):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    count = Counter(tuple(w[i : i + width]) for _, w in texts for i in range(len(w) - width + 1))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "é", "x.", "Y"] + [f"w{i}" for i in range(400)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [prose(60) for _ in range(4)]
    rows = []
    for i in range(n):
        w = prose(rng.randint(0, 120))
        if rng.random() < 0.4:
            w += shared[int(rng.random() ** 2 * 4)][rng.randint(0, 20) :] + prose(rng.randint(0, 30))
        rows.append((i if i % 50 else None, rng.choice([" ", "\n", "\t"]).join(w), "k", 1, 0.5))
    rows += [(901, None, "k", 1, 0.5), (902, "", None, None, None), (903, "a " * 90, "k", 1, 0.5), (904, "a b c " * 40, "k", 1, 0.5), (905, rows[3][1], "k", 1, 0.5), (7, rows[7][1], "k", 1, 0.5)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1, 300)
    got = substring_dedup.digest(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 35)))


def test_dealt_buckets_and_long_texts(spark, monkeypatch):
    rows = corpus(2, 150)
    long = random.Random(9)
    rows.append((999, " ".join(long.choice("abcdefgh") for _ in range(4000)) + " " + rows[5][1], "k", 1, 0.5))
    monkeypatch.setattr(substring_dedup, "_STRETCH", 64)
    df = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"key": "k1"}).drop("lo")
    found = substring_dedup.remove_repeats(df, width=12, seed_words=3, bucket_rows=2)
    want = {(r[0], r[1]): r[2] for r in brute([(r[0], r[1]) for r in rows], 12)}
    for r in found.collect():
        words = (r.text or "").encode().split()
        _, gone = substring_dedup.kept_words(words, [(x.lo, x.hi) for x in r.ranges or []])
        assert want[(r.doc_id, len(words))] == gone
    assert found.columns == ["doc_id", "text", "k1", "at", "ranges"]


def test_one_word_over_and_over_stays_small():
    words = [b"a"] * 10_000
    runs = list(substring_dedup.super_kmers(words, 35, 6))
    sizes = [int(b - a + 1) + 34 for _, first, last, _ in runs for a, b in zip(first, last, strict=True)]
    assert sum(sizes) < 2.1 * len(words) and max(sizes) <= 69
    assert all(again.all() for _, first, last, again in runs if (last > first).all())


def test_ties_of_minimisers(spark):
    rows = [(i, t, "k", 1, 0.5) for i, t in enumerate(["a " * 35, "a " * 34, "a " * 36, "b " * 200, "a b " * 40, "c d e " * 12 + "c d", "x y " * 17 + "x", "z x y " * 30 + "q", "f g h " * 200 + "i"])]
    got = substring_dedup.digest(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 35)))


def test_cut_keeps_other_blanks():
    assert substring_dedup.cut("a  b\nc d\te ", [(1, 3), (2, 4)]) == "a  e "
    assert substring_dedup.cut(" a b", [(0, 2)]) == " "
    assert substring_dedup.cut("é ü", []) == "é ü"


def test_clashing_columns_come_through(spark):
    names = ["_sd_doc", "_sd_text", "_sd_ranges", "ranges", "packed", "salt"]
    df = spark.createDataFrame([(1, "a b c d e", *names), (2, "a b c d e", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    found = substring_dedup.remove_repeats(df, width=3, seed_words=2, out="spans")
    assert found.columns == ["doc_id", "text", *names, "spans"]
    assert all([r[n] for n in names] == names and r.spans for r in found.collect())


def test_empty_table(spark):
    assert substring_dedup.digest(spark.createDataFrame([], DOCS)).count() == 0
    assert substring_dedup.digest(spark.createDataFrame([(1, "a b", "", 1, 0.0)], DOCS)).select(F.sum("n_removed")).first()[0] == 0
