from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import common, mixing, quality_rules, simhash_dedup
from tidemark.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def family(rng, n):
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "he", "st"]) for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.choice([8, 30, 120, 400]))] for _ in range(n)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(rng.choice([0, 0, 1, 6])):
            c = list(b)
            for _ in range(rng.choice([0, 1, 2, 4])):
                c[rng.randrange(len(c))] = word()
            out.append(c)
    return [" ".join(x) for x in out]


def test_near_duplicates_against_exact_similarity(spark):
    texts = [*family(random.Random(4), 60), "", None, "one", "One", "two"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[4], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    groups = {}
    for r in simhash_dedup.near_groups(df).collect():
        groups.setdefault(r._sh_doc, r.group)
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    missed = pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            s = alike(sets[i], sets[j])
            if s >= 0.7:
                root[find(i)] = find(j)
            if s >= 0.8:
                pairs += 1
                missed += groups[i] != groups[j]
    assert pairs > 50 and missed <= 0.02 * pairs
    for i in range(len(texts)):
        for j in range(i):
            assert groups[i] != groups[j] or find(i) == find(j)
    kept = simhash_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g: min(i for i in groups if i is not None and groups[i] == g) for g in groups.values()}.values())


def test_a_group_has_no_text_below_the_stated_similarity(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        base = [f"{rng.choice(['an', 're', 'ti'])}{rng.randrange(10**6)}" for _ in range(1000)]
        texts.append(" ".join(base))
        # Changed words far from each other cost five shingles each, so these are 0.74 to 0.8 alike.
        changed = rng.choice([26, 27, 28, 30])
        for i in range(changed):
            base[20 + i * 30] = f"new{i}"
        texts.append(" ".join(base))
    sets = [shingles(t) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert all(0.7 < s < 0.8 for s in alike)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert simhash_dedup.drop_near_duplicates(df).count() == len(texts)


def test_bands_led_by_a_third_text_lose_no_pair(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(8):
        # Pairs of 0.9 on one template, about 0.65 alike to those of other pairs, and chains within.
        template = [word() for _ in range(300)]
        for _ in range(12):
            variant = list(template)
            for at in rng.sample(range(0, 300, 5), 13):
                variant[at] = word()
            for _ in range(3):
                texts.append(" ".join(variant))
                variant[rng.randrange(300)] = word()
                variant[rng.randrange(300)] = word()
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                root[find(i)] = find(j)
    want = {frozenset(i for i in range(len(texts)) if find(i) == r) for r in map(find, range(len(texts)))}
    assert 60 < len(want) < 250
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    for rounds in (0, 3):
        groups = {}
        for r in simhash_dedup.near_groups(df, rounds=rounds).collect():
            groups.setdefault(r.group, set()).add(r._sh_doc)
        assert set(map(frozenset, groups.values())) == want


def test_the_near_duplicate_stage_deletes_its_texts_sketches(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=40)), "en", "s", 0) for i in range(60)] + [(100, "a b c", "en", "s", 0), (101, "a b c", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = common.written()
    out = simhash_dedup.near_groups(df)
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in common._handed_out[before:]]
    assert "groups" in left and not {"sketches", "nodes", "bands", "counted", "shared", "pairs", "shingles", "rooted", "apart"} & set(left)
    assert left.count("edges") <= 1 and out.count() == len(rows)


def test_mixing_stage_takes_what_the_operator_says(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 30), "en", rng.choice("abc"), 1) for i in range(200)] + [(5, "x y", "en", "a", 1)] * 3 + [(None, "x", None, None, 1)]
    df = spark.createDataFrame(rows, DOCS)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[(r.doc_id, r.text_key)] += r.copies
    got = Counter((r.doc_id, r.k) for r in corpus_pipeline.mix_sources(spark, df, "").select("doc_id", F.xxhash64("text").alias("k")).collect())
    assert got == +want


def test_run_on_the_small_tables(spark, tmp_path):
    texts = family(random.Random(9), 40)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"{x}{i}" for i in range(90)) + " " + passage for x in ("anre", "tion")]
    texts += ["bad### " * 3 + " ".join(f"w{i}$$$ x{i}%%%" for i in range(60)), "", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts) - 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.fieldNames() == docs.schema.fieldNames(), name
        docs = corpus_pipeline.stored(out, name)
        if name == "substring_dedup":
            assert sum(r.text.startswith(("anre0", "tion0")) for r in docs.collect()) == 2 and not any("p30 p31" in r.text for r in docs.collect()) and all(r.n_chars == len(r.text) for r in docs.collect())
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == {r.doc_id for r in docs.collect()} and final
    kept = quality_rules.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1,)], "doc_id long"))
    assert not {len(texts) - 3, len(texts) - 2, len(texts) - 1} & set(final) and kept.count() == len(rows)


def test_stages_let_clashing_columns_through(spark, tmp_path):
    names = ["ranges", "_sd_doc", "_sh_text", "_mx_at", "_qr_words", "quality_rules", "packed", "fp"]
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in ("an", "re", "ti")]
    rows = [(i, t, "en", "s", len(t), *names) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS + ", " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert all([r[n] for n in names] == names for r in out.collect()), name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
