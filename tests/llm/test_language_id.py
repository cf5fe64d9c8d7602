from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, registry

DOCS = "doc_id long, text string, lang string, score double, held_out string"
SYLLABLES = {"aa": ["ta", "ro", "mi"], "bb": ["schü", "len", "gär"], "cc": ["é", "oua", "ièn"], "dd": ["ци", "по", "ра"], "ee": ["ñó", "llo", "qua"], "ff": ["th", "wh", "ing"], "gg": ["ος", "αλ", "μι"]}


def corpus(languages, n, seed=1):
    rng = random.Random(seed)
    word = lambda v: "".join(rng.choice(SYLLABLES[v]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        v = rng.choice(languages)
        rows.append((i, " ".join(word(v) for _ in range(rng.randint(4, 60))), v if rng.random() < 0.9 else None, 0.5, v))
    return rows


@pytest.mark.parametrize("n", [2, 4, 7])
def test_held_out_accuracy_and_contract(spark, tmp_path, n):
    rows = corpus(sorted(SYLLABLES)[:n], 500)
    odd = [(900, None, "aa", 0.0, ""), (901, "", "aa", 0.0, ""), (902, "123 ²½ ⅷ --", "bb", 0.0, ""), (903, "ta" * 9000, "aa", 0.0, "aa"), (None, "taro miro", "aa", 0.0, "aa"), (904, "日本", None, 0.0, "")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows + odd, DOCS).write.parquet(path)
    got = {r.doc_id: r for r in registry.op4_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[904].lang_pred in SYLLABLES and got[903].lang_pred == "aa"
    truth = {r[0]: r[4] for r in rows}
    kept_back = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(kept_back)) for i in truth)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].lang_pred == truth[i] for i in kept_back]) >= 0.97


def test_one_language_no_language_and_empty(spark):
    one = spark.createDataFrame(corpus(["aa"], 20), DOCS)
    model = language_id.train(one, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(one, model).collect()} == {"aa"}
    assert language_id.train(one, F.lit(False)) is None
    assert {tuple(r[1:3]) for r in language_id.identify(one, None).collect()} == {("und", 0.0)}
    assert language_id.identify(spark.createDataFrame([], DOCS), model).count() == 0


def test_sample_bound_and_repeatable(spark):
    df = spark.createDataFrame(corpus(["aa", "bb"], 300), DOCS)
    a, b = (language_id.train(d, F.lit(True), sample=20) for d in (df, df.orderBy(F.rand(3))))
    assert np.array_equal(a.weights, b.weights) and a.languages == ["aa", "bb"]


def test_codewords_are_distinct_and_far():
    for n in (2, 3, 5, 6, 7, 12, 40):
        m = language_id.codewords(n)
        apart = (m.shape[1] - (m @ m.T)) / 2 + np.eye(n) * 999
        assert m.shape[0] == n and apart.min() >= (1 if n < 3 else m.shape[1] / 5)


def test_repeated_ids_teach_once(spark):
    rng = random.Random(5)
    many = [(1007, " ".join(rng.choice(SYLLABLES["bb"]) for _ in range(20)), "bb", 0.5, "") for _ in range(5000)]
    rows = [r for r in corpus(["aa"], 300) if r[2]] + many + [(1008, "гдежзи " * 5, "bb", 0.5, "")]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    model = language_id.train(df, F.lit(True), sample=100)
    assert model.languages == ["aa", "bb"]
    assert language_id.train(spark.createDataFrame(many, DOCS), F.lit(True), sample=10).languages == ["bb"]
    x = language_id.features(many[0][1], language_id.DIMS)
    assert model.decode(x)[0] == "bb"
    with pytest.raises(ValueError):
        language_id.LANGUAGES, kept = 1, language_id.LANGUAGES
        try:
            language_id.train(df, F.lit(True))
        finally:
            language_id.LANGUAGES = kept


def test_languages_that_share_all_ids_are_learned(spark):
    """Two languages have the same ids and other texts; each teaches from its own rows."""
    rows = [(i, t, v, 0.5, "") for v in ("aa", "bb") for i, t, *_ in corpus([v], 200)] + [r for r in corpus(["cc"], 100, seed=2) if r[2]]
    model = language_id.train(spark.createDataFrame(rows, DOCS).repartition(4), F.lit(True))
    assert model.languages == ["aa", "bb", "cc"]
    right = [model.decode(language_id.features(t, language_id.DIMS))[0] == v for _, t, v, *_ in rows]
    assert sum(right) >= 0.98 * len(right)


def brute_features(text):
    """The n-grams of a text one by one, hashed with the published constants."""
    mask = 0xFFFFFFFF
    c, last = [0], 0
    for x in text.lower():
        v = ord(x) if x.isalpha() else 0
        if v or last:
            c.append(v)
        last = v
    if c[-1]:
        c.append(0)
    one, two, three = 2654435761, 2246822519, 3266489917
    counts = {}

    def add(h):
        counts[h >> 22] = counts.get(h >> 22, 0) + 1

    pair = lambda a, b: ((((a * one & mask) ^ ((a * one & mask) >> 15)) * two) + b) & mask
    for i, a in enumerate(c):
        if a:
            add(a * one & mask)
        if i + 1 < len(c):
            h = pair(a, c[i + 1])
            add(h * one & mask)
            if i + 2 < len(c):
                add((((h ^ (h >> 13)) * three) + c[i + 2]) & mask)
    n = sum(counts.values())
    return {k: v / n for k, v in counts.items()}


def test_matches_brute_force(spark, tmp_path):
    """Every prediction again, by loops over n-grams, codewords and losses, from the fitted weights."""
    names = sorted(SYLLABLES)[:5]
    rows = corpus(names, 300, seed=8)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op4_language_id(spark, str(tmp_path)).collect()}
    learn = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5]
    dense = lambda f: np.array([np.float32(f.get(d, 0.0)) for d in range(language_id.DIMS)], float)
    m = language_id.fit([r[2] for r in sorted(learn)], np.array([dense(brute_features(r[1])) for r in sorted(learn)]))
    for i, text, *_ in rows:
        x = brute_features(text)
        margins = [min(8, max(-8, sum(v * m.weights[d, b] for d, v in x.items()) + m.bias[b])) for b in range(m.codes.shape[1])]
        loss = {v: sum(t * np.exp(-w * g) for t, w, g in zip(m.trust, m.codes[k], margins, strict=True)) for k, v in enumerate(m.languages)}
        best = min(loss, key=lambda v: (loss[v], v))
        assert got[i].lang_pred == best
        assert abs(got[i].score - (1 / loss[best]) / sum(1 / y for y in loss.values())) < 5e-3
