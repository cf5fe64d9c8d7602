from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, registry

SCHEMA = "doc_id long, text string"
BLANKS = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def expected(rows, min_docs=10, keep_first=False):
    """Brute force: distinct (id, text) are the documents."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    where = defaultdict(set)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            if key(line):
                where[key(line)].add(d)
    out = {}
    for d in docs:
        all_lines = (d[1] or "").split("\n")
        out[d] = [line for line in all_lines if len(where[key(line)]) < min_docs]
    return sorted(((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(out[i, t]), hashlib.sha256("\n".join(out[i, t]).encode()).hexdigest()) for i, t in rows), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    common = ["Home | About", "  home | about\t", "All Rights Reserved", "ÄÖ x", "\x1c", "a"]
    rows = []
    for i in range(n):
        own = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.randint(0, 400)}" for _ in range(rng.randint(0, 30))]
        rows.append((i, "\n".join(own)))
    return [*rows, (None, "Home | About\nx"), (None, None), (7, ""), (8, "\n\n"), (9, "\r\nHome | About\r\n"), rows[3], rows[3], (None, "Home | About\nx"), (500, "\n".join(["a", "own"] * 4000))]


@pytest.mark.parametrize("seed", [1, 2])
def test_digest_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = line_dedup.digest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_cut_keys_give_the_same_rows(spark):
    """Pieces of a few rows, so that frequent keys are cut, and none at all."""
    docs = spark.createDataFrame(corpus(3), SCHEMA)
    for first in (False, True):
        cut, whole = (sorted(map(tuple, line_dedup.keep_bitmaps(docs, keep_first=first, piece=p).collect()), key=str) for p in (5, 10**6))
        assert cut == whole and any(r[3] for r in cut)


def test_first_occurrence_stays(spark):
    rows = [(i, f"own {i}\nshared\nshared") for i in range(5, 0, -1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=2, keep_first=True))
    assert {r.doc_id: r.kept_text for r in kept.collect()} == {1: "own 1\nshared", **{i: f"own {i}" for i in range(2, 6)}}


def test_bitmaps_round_trip_in_both_forms(spark):
    cases = [(1, []), (1, [0]), (9, [8]), (64, list(range(0, 64, 2))), (5000, [17]), (5000, list(range(5000))), (33, [0, 1, 5, 32])]
    df = spark.createDataFrame(cases, "n int, gone array<int>").withColumn("keep", line_dedup.compress(line_dedup._runs(F.col("n"), F.col("gone"))))
    forms = set()
    for r in df.withColumn("bits", line_dedup.decompress(F.col("keep"), F.col("n"))).collect():
        assert r.bits == "".join("0" if i in r.gone else "1" for i in range(r.n))
        assert len(r.keep) <= 1 + (r.n + 7) // 8
        forms.add(r.keep[0])
    assert forms == {0, 1}


def test_one_line_in_all_documents_is_dealt_over_pieces(spark):
    rows = [(i, f"Common line\nrow {i}") for i in range(4000)]
    docs = line_dedup._identified(spark.createDataFrame(rows, SCHEMA))
    heavy = line_dedup._heavy(line_dedup.occurrences(docs, 1), 100).collect()
    assert [r.pieces for r in heavy] == [40]
    assert line_dedup.dropped_lines(docs, 10, 1, False, 100).count() == 4000


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a\nb", "x", 5, "y")], "doc_id long, text string, keep string, n_lines int, _ld_doc string")
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert got.columns == ["doc_id", "text", "keep", "_ld_doc", "n_lines", "n_dropped", "kept_text"]
    assert got.first().asDict() == {"doc_id": 1, "text": "a\nb", "keep": "x", "_ld_doc": "y", "n_lines": 2, "n_dropped": 0, "kept_text": "a\nb"}


def test_no_python_and_one_range_exchange(spark, tmp_path):
    docs = spark.createDataFrame(corpus(4), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = registry.op11_line_dedup(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
