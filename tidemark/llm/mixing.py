"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the mixture by weight, but never more than ``max_epochs`` times its own
size: sources above that are clamped and their excess goes to the rest by weight, until none is
above. A source's target is then met by whole repetitions of all its documents and one fractional
repetition: documents in a seeded random order are added while they bring the total nearer.

Documents are ordered within buckets of a hash of their id and text, so the running total over a
source is a small table of bucket sums and one bucket that is sorted; no task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored

#: Hex digits of the hash that make a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float, max_rounds: int = 200) -> DataFrame:
    """``sources(source, weight, source_size)`` with ``target``.

    Each round clamps the sources whose share of what is left exceeds their cap, in one pass over
    the sources; the driver sees two sums a round. If all are clamped the mixture is smaller than
    the budget.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    for _ in range(max_rounds):
        clamped = F.col("weight") * F.lit(level) > cap
        left = sources.agg(F.sum(F.when(clamped, cap)).alias("full"), F.sum(F.when(~clamped, F.col("weight"))).alias("open")).first()
        rest = float(budget) - (left.full or 0.0)
        if not left.open or rest / left.open == level:
            break
        level = rest / left.open
    else:
        raise RuntimeError(f"water level did not settle in {max_rounds} rounds")
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def weigh(docs: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """``(source, source_size, weight)``; weights repeat the cycle over the sources in code-point order, null last."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    ranked = docs.sparkSession.createDataFrame(ranked, "source string, source_size long, at long")
    return ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("at") % len(cycle) + 1).cast("int")).cast("double").alias("weight"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix-1") -> DataFrame:
    """``(doc_id, source, text_key, size, source_size, target, copies, taken)`` for every row of ``docs``.

    ``copies`` is how often the mixture holds the document and ``taken = copies * size``. The order
    of the fractional repetition is by an MD5 of seed, doc_id and the text's MD5, so reruns agree;
    rows that repeat both are interchangeable. Null texts have size 0; a null source is a source of its own;
    an empty table gives no rows. Columns other than doc_id, source and text are ignored.
    """
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            "source",
            F.xxhash64("text").alias("text_key"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))).alias("h"),
        ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)),
        "sized",
    )
    total = sized.agg(F.sum("size")).first()[0] or 0
    filled = water_fill(stored(weigh(sized, cycle), "sources"), share * total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    filled = stored(filled, "filled")

    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    starts = starts.alias("s").join(filled.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")))
    plan = starts.select("s.source", "bucket", "before", "bucket_size", "source_size", "target", "whole", "part")
    # In the bucket where the running total passes the fraction, documents are taken one by one.
    plan = plan.withColumn("all", F.col("before") + F.col("bucket_size") <= F.col("part")).withColumn("edge", ~F.col("all") & (F.col("before") < F.col("part")))
    plan = stored(plan, "plan")

    d, p = sized.alias("d"), plan.alias("p")
    dealt = d.join(p, (F.col("d.bucket") == F.col("p.bucket")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    dealt = dealt.select("d.doc_id", "d.source", "text_key", "size", "h", "d.bucket", "before", "source_size", "target", "whole", "part", "all", "edge")
    run = Window.partitionBy("source", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = dealt.where("edge").withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    at_edge = at_edge.withColumn("extra", (2 * (F.col("part") - F.col("so_far")) >= F.col("size")) & (F.col("so_far") < F.col("part"))).drop("so_far")
    out = dealt.where("not edge").withColumn("extra", F.col("all")).unionByName(at_edge)
    out = out.withColumn("copies", F.col("whole") + F.col("extra").cast("long"))
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
