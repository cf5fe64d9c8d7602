"""Licences of files: sparse TF-IDF cosines of headers and licence files to templates, and inheritance down directories.

A template is a notice, a header, a whole short licence or the head of a long one. It is laid over a
file wherever the file has the template's anchor word: the stretch of as many terms as the template
has, across line breaks, is compared with it, so that what stands before and behind costs nothing.
One-line notices are also compared with the line that holds their anchor, as it stands. Terms weigh
by their document frequency over all files, as a proportion, so a verdict doesn't depend on the
size of the table.

A file with a passage whose best cosine reaches the threshold has that licence. Any other takes the
licence of the licence file in its nearest ancestor directory, found by an equality join of
directories with their ancestors. Everything is column expressions and joins: passages are made of
distinct texts that hold an anchor, and their terms meet the document frequencies by a join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shield, stored
from tidemark.llm.license_texts import TEMPLATES

#: Least cosine of a match; the proportion of files that is added to a term's own; terms of a template that is also held against lines.
THRESHOLD, SMOOTHING, NOTICE = 0.6, 0.001, 25
#: Cosine from which a longer template is there nearly whole; the notice that is no licence.
WHOLE, RESERVED = 0.8, "all-rights-reserved"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
#: Levels of directories whose many children are dealt over salts when they look for a licence above.
SHALLOW, SALTS = 3, 32

Templates = tuple[tuple[str, str, str], ...]


def template_terms(templates: Templates = TEMPLATES) -> list[tuple[str, str, list[str]]]:
    return [(name, anchor, re.findall(TERM, text.lower())) for name, anchor, text in templates]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def anchor_pattern(templates: Templates = TEMPLATES) -> str:
    """A text or line that may hold an anchor."""
    return "(^|[^a-z0-9])(" + "|".join(sorted({re.escape(anchor) for _, anchor, _ in templates})) + ")([^a-z0-9]|$)"


def document_frequencies(files: DataFrame) -> DataFrame:
    """``(t, df)`` for every term of any file; the empty term counts the files."""
    has = F.array_distinct(terms(F.coalesce("text", F.lit(""))))
    return files.select(F.explode(F.concat(F.array(F.lit("")), has)).alias("t")).groupBy("t").agg(F.count("*").alias("df"))


def passages(texts: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """``(key, tid, terms)``: the stretches and lines of ``texts(key, text)`` that each template is compared with."""
    pattern, low = anchor_pattern(templates), F.lower("text")
    held = texts.where(low.rlike(pattern)).withColumn("all", terms(F.col("text"))).withColumn("lines", F.transform(F.filter(F.split(low, "\n"), lambda x: x.rlike(pattern)), terms))
    found = []
    for tid, (_, anchor, own) in enumerate(template_terms(templates)):
        before = own.index(anchor)
        at = F.filter(F.transform("all", lambda t, i: F.when(t == anchor, i)), lambda i: i.isNotNull())  # noqa: B023
        row = lambda x: F.struct(F.lit(tid).alias("tid"), x.alias("terms"))  # noqa: B023, E731
        found.append(F.transform(at, lambda p: row(F.slice("all", F.greatest(p - before, F.lit(0)) + 1, len(own) - F.greatest(before - p, F.lit(0))))))  # noqa: B023
        if len(own) <= NOTICE:
            found.append(F.transform(F.filter("lines", lambda x: F.array_contains(x, anchor)), row))  # noqa: B023
    return held.select("key", F.explode(F.array_distinct(F.concat(*found))).alias("p")).select("key", "p.tid", "p.terms")


def best_matches(files: DataFrame, templates: Templates, threshold: float) -> DataFrame:
    """``(key, name, score)`` of the texts, by their MD5, that match a template: the best one's, ties to the lesser name.

    A header or licence that is there nearly whole goes before one-line notices, which may be its
    parts, and any licence before a bare reservation of rights.
    """
    spark, wanted = files.sparkSession, template_terms(templates)
    texts = files.select(F.md5("text").alias("key"), "text").where("text IS NOT NULL")
    held = stored(passages(texts, templates).dropDuplicates(["key", "tid", "terms"]).withColumn("pid", F.monotonically_increasing_id()), "passages")
    # A passage's number stands for its text's key, which would be shuffled with each of its terms.
    counted = held.select("tid", "pid", F.explode("terms").alias("t")).groupBy("tid", "pid", "t").agg(F.count("*").alias("n"))
    rows = [(tid, t, own.count(t)) for tid, (_, _, own) in enumerate(wanted) for t in sorted(set(own))]
    own = spark.createDataFrame(rows, "tid int, t string, k long")
    # Weights are needed for the terms of passages and templates alone; all files are counted for them.
    needed = held.select(F.explode("terms").alias("t")).unionByName(own.select("t")).unionByName(spark.createDataFrame([("",)], "t string")).distinct()
    df = stored(document_frequencies(files).join(needed, "t", "left_semi"), "df")
    n = (df.where("t = ''").first() or {"df": 0})["df"]
    share = F.coalesce("df", F.lit(0)) / F.lit(float(max(n, 1)))
    weigh = lambda d: d.join(df, "t", "left").withColumn("w", 1 + F.log((1 + SMOOTHING) / (share + SMOOTHING))).drop("df")
    given = weigh(own)
    norms = given.groupBy("tid").agg(F.sqrt(F.sum(F.pow(F.col("k") * F.col("w"), 2))).alias("norm"))
    # A row for each term of a template: a bounded table.
    given = F.broadcast(given.join(norms, "tid").select("tid", "t", (F.col("k") * F.col("w") / F.col("norm")).alias("v")))
    cosine = F.round(F.sum(F.col("n") * F.col("w") * F.coalesce("v", F.lit(0.0))) / F.sqrt(F.sum(F.pow(F.col("n") * F.col("w"), 2))), 6)
    scored = weigh(counted).join(given, ["tid", "t"], "left").groupBy("tid", "pid").agg(cosine.alias("score")).where(F.col("score") >= threshold).join(held.select("pid", "key"), "pid")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("tid") + 1)
    name = of([x[0] for x in wanted])
    rank = F.when(name == RESERVED, 2).when(of([len(x[2]) > NOTICE for x in wanted]) & (F.col("score") >= WHOLE), 0).otherwise(1)
    return scored.groupBy("key").agg(F.min(F.struct(rank.alias("r"), (-F.col("score")).alias("s"), name.alias("name"))).alias("b")).select("key", "b.name", (-F.col("b.s")).alias("score"))


def match(files: DataFrame, templates: Templates = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with ``own_license`` and ``own_score``: the best template over all passages of the text, null where none reaches the threshold.

    Scores are rounded to six places; equal ones go to the lesser name.
    """
    best = best_matches(files, templates, threshold).select(F.col("key").alias("_ls_key"), F.col("name").alias("own_license"), F.col("score").alias("own_score"))
    return files.withColumn("_ls_key", F.md5("text")).join(best, "_ls_key", "left").drop("_ls_key")


def inherit(matched: DataFrame) -> DataFrame:
    """``matched(.., path, own_license, own_score)`` with ``license`` and ``origin`` (header, inherited or none)."""
    d = matched.withColumn("_ls_dir", F.regexp_replace("path", "[^/]*$", ""))
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE)
    # One licence for each directory: the best-scored licence file's, then the lesser path's.
    given = d.where(named & F.col("own_license").isNotNull()).groupBy(F.col("_ls_dir").alias("above")).agg(F.min_by("own_license", F.struct(-F.col("own_score"), F.col("path"))).alias("given"))
    parts = F.split("_ls_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    dirs = d.where("own_license IS NULL").select("_ls_dir").where("_ls_dir <> ''").distinct().withColumn("above", F.explode(above))
    # The root and the tops of the tree are above nearly all directories: those rows are dealt over salts.
    shallow = F.size(F.split("above", "/")) <= SHALLOW + 1
    dirs = dirs.withColumn("salt", F.when(shallow, F.pmod(F.hash("_ls_dir"), F.lit(SALTS))).otherwise(0))
    given = given.withColumn("salt", F.explode(F.when(shallow, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    nearest = dirs.join(given, ["above", "salt"]).groupBy("_ls_dir").agg(F.max_by("given", F.length("above")).alias("_ls_given"))
    out = d.join(nearest, "_ls_dir", "left")
    origin = F.when(F.col("own_license").isNotNull(), "header").when(F.col("_ls_given").isNotNull(), "inherited").otherwise("none")
    return out.withColumns({"license": F.coalesce("own_license", "_ls_given"), "origin": origin}).drop("_ls_dir", "_ls_given")


def scan(files: DataFrame, templates: Templates = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licences of ``files(path, text, ..)``: all columns but the text, with own_license, own_score, license and origin.

    Null and empty texts match nothing; a null path, or one without a slash, inherits nothing; rows
    that repeat stay; an empty table gives no rows. Columns of the four names are replaced.
    """
    files, back = shield(files.drop("own_license", "own_score", "license", "origin"), "_ls_")
    return inherit(match(files, templates, threshold).drop("text")).withColumnsRenamed(back)
