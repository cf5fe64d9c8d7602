"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. One pass over the corpus
counts the buckets of all documents and of the trusted ones; the ratio of the two smoothed
multinomials gives every bucket a weight, and a document's mean weight per n-gram is compared with
a threshold. Everything is column expressions; the only thing that passes the driver is the table
of bucket weights, whose size is a parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shield, words

#: Bits of the multinomials' buckets; added to each bucket's count; least mean log ratio of a kept document.
BUCKET_BITS, SMOOTHING, THRESHOLD = 14, 1.0, -0.06
#: Trusted ids that are broadcast at most (16 bytes each); beyond that the join is shuffled.
BROADCAST_IDS = 2_000_000
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
_NO_SYMBOL = "[^#*$%&|<>]+"
OUT = "quality_rules"


def _pairs(hashes: Column, gap: int) -> Column:
    """Hashes of each element with the one ``gap`` places on; the last ``gap`` have no partner and mean nothing."""
    return F.zip_with(hashes, F.slice(hashes, gap + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _with_hashes(d: DataFrame, text: Column) -> DataFrame:
    """Adds the words of a text, their hashes, and the hashes of each two words in a row.

    Each is a column that the next ones use several times, so it is computed once a row.
    """
    d = d.withColumn("_qr_words", words(text))
    d = d.withColumn("_qr_one", F.transform("_qr_words", lambda w: F.xxhash64(w)))
    return d.withColumn("_qr_two", F.slice(_pairs(F.col("_qr_one"), 1), 1, F.greatest(F.size("_qr_one") - 1, F.lit(0))))


def _bucket(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def flag_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` with ``_qr_trusted``; ids are broadcast where their count allows."""
    ids = trusted.select(F.col("doc_id").alias("_qr_id")).where("_qr_id IS NOT NULL").distinct()
    ids = ids.withColumn("_qr_trusted", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["_qr_id"], "left").drop("_qr_id").withColumn("_qr_trusted", F.coalesce("_qr_trusted", F.lit(False)))


def bucket_weights(docs: DataFrame, trusted: DataFrame, bits: int = BUCKET_BITS, smoothing: float = SMOOTHING) -> list[float]:
    """The log ratio of target to corpus for every bucket, from the n-grams of all documents; all zero without trusted ones."""
    hashed = _with_hashes(flag_trusted(docs.select("doc_id", "text"), trusted), F.col("text"))
    grams = hashed.select("_qr_trusted", F.explode(F.concat("_qr_one", "_qr_two")).alias("h"))
    counts = grams.groupBy(_bucket(F.col("h"), bits).alias("b"), "_qr_trusted").count()
    counts = counts.groupBy("b").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("_qr_trusted"), F.col("count"))).alias("t")).collect()
    raw, target = [0] * (1 << bits), [0] * (1 << bits)
    for r in counts:
        raw[r.b], target[r.b] = r.n, r.t or 0
    if not any(target):
        return [0.0] * (1 << bits)
    all_raw, all_target = sum(raw) + smoothing * len(raw), sum(target) + smoothing * len(raw)
    return [math.log((t + smoothing) / all_target) - math.log((n + smoothing) / all_raw) for t, n in zip(target, raw, strict=True)]


def _repeats(d: DataFrame) -> DataFrame:
    """Adds ``_qr_repeat``: words in windows of eight that are found twice or more.

    64-bit hashes, built from those of two and four words, find the windows that may be repeated;
    those are told apart by their words. Only where two hashes of a text agree are its windows
    sorted to find the places; the covered words are the sum of the gaps between those, eight at
    most each.
    """
    n = F.size("_qr_one")
    d = d.withColumn("_qr_four", _pairs(F.col("_qr_two"), 2)).withColumn("_qr_eight", F.slice(_pairs(F.col("_qr_four"), 4), 1, F.greatest(n - WINDOW + 1, F.lit(0))))
    g = F.col("_qr_eight")
    d = d.withColumn("_qr_sorted", F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    s = F.col("_qr_sorted")
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    d = d.withColumn("_qr_like", F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))))
    d = d.withColumn("_qr_told", F.array_sort(F.transform("_qr_like", lambda x: F.struct(F.slice("_qr_words", x["i"] + 1, WINDOW).alias("g"), x["i"].alias("i")))))
    t = F.col("_qr_told")
    d = d.withColumn("_qr_at", F.array_sort(F.transform(F.filter(t, lambda x, i: same(x, F.get(t, i - 1)) | same(x, F.get(t, i + 1))), lambda x: x["i"])))
    at = F.col("_qr_at")
    gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return d.withColumn("_qr_repeat", F.when(s.isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda total, x: total + x)).cast("long"))


def score(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """``docs`` with a struct ``quality_rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``trusted`` lists the doc_ids of the target. A text that is null or has no words has score null
    and fails the base rules. Null and repeated doc_ids keep their rows; an empty table gives none.
    A column of ``docs`` that is called quality_rules is replaced; all others come through.
    """
    docs, back = shield(docs.drop(OUT), "_qr_")
    weights = bucket_weights(docs, trusted, bits)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a constant
    text = F.coalesce(F.col("text"), F.lit(""))
    d = _repeats(_with_hashes(docs, F.col("text")))
    d = d.withColumn("_qr_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    add = lambda total, h: total + F.get(table, _bucket(h, bits))
    n = F.size("_qr_words")
    total = F.aggregate("_qr_one", F.lit(0.0), add) + F.aggregate("_qr_two", F.lit(0.0), add)
    d = d.withColumn("_qr_score", F.when(n > 0, total / (2 * n - 1)))
    failed = (n < MIN_WORDS) | (100 * F.col("_qr_repeat") > MAX_REPEAT_PERCENT * n)
    fields = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_qr_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, _NO_SYMBOL, "")).cast("long"),
        "n_dup_lines": (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long"),
        "n_repeat_words": F.col("_qr_repeat"),
        "base_failed": failed,
        "score": F.col("_qr_score"),
        "kept": ~failed & F.coalesce(F.col("_qr_score") >= threshold, F.lit(False)),
    }
    verdict = F.struct(*[c.alias(k) for k, c in fields.items()])
    # A generator's column: a filter on it stays above, and does not compute the chain once more per mention.
    return d.select(*docs.columns, F.explode(F.array(verdict)).alias(OUT)).withColumnsRenamed(back)
