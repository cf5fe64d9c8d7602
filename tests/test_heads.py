"""Looking up the beginnings of words changes no rule's verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import acceptability, entry, heads, prizes
from tidemark.functions.scoring import normalize_text


def test_heads_of_patterns():
    assert heads.heads(r"\btag\s+\d+\b") == ["tag"]
    assert heads.heads(r"\blivres?\b|\b(?:video\s+)?game\s+key") == ["game", "livre", "video"]
    assert heads.heads(r"\b(?:a|[bc]|(?:dd|ee)f)\b") is None
    assert heads.heads(r"\b(?:(?:dd|eee?)f)\b|^us$") == ["dd", "ee", "us"]
    assert heads.heads(r"foo\b") is None and heads.heads(r"\b\d+") is None


def test_looked_up_rules_match_as_plain_ones(spark):
    texts = [
        "", "Retweet", "étag 5 and tag 5", "TAG 3", "posttag 5", "x-tag 12", "_tag 12", "Partagez cette vidéo", "user generated content", "use the hashtag", "us residents only", "us", "a PS5 and a psn card",
        "50 eur", "eur 50", "e-bike", "20% off", "10 euros off purchases over 100", "des 50 par mois €", "ships only to Spain", "excluding France", "livre", "oled tv", "Concours: commentez, suivez-nous", "city-break; week end", "tv\nlog in\nvisit",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string").withColumn("t", normalize_text(F.col("raw")))
    families = [(p, label) for rules in prizes.FAMILIES.values() for p, label in rules]
    for rules, needs in ((families, prizes.NEEDS), ([(p, r) for p, r, _ in entry.LADDER], {}), (acceptability.PUBLIC, {}), (acceptability.OTHER_WAYS, {})):
        patterns = tuple(p for p, _ in rules)
        begun = df.withColumn("b", heads.seen(F.concat_ws("\n", "t", "raw"), patterns))
        rows = begun.select("raw", entry.tags(F.col("t"), rules, F.col("b"), patterns, needs).alias("got"), entry.tags(F.col("t"), rules).alias("want"), F.array(*[heads.holds(F.col("raw"), p, F.col("b"), patterns, "(?i)") for p in patterns]).alias("g"), F.array(*[F.col("raw").rlike(f"(?i){p}") for p in patterns]).alias("w")).collect()
        assert [(r.raw, r.got, r.g) for r in rows] == [(r.raw, r.want, r.w) for r in rows]
        assert any(r.want for r in rows)
