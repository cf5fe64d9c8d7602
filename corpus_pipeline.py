"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; ``run``
writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, mixing, quality_rules, registry, simhash_dedup, substring_dedup
from tidemark.llm.common import fresh, release, shield, stored, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep.

    Null, empty and wordless texts fail the base rules; rows that repeat are judged alike; null ids
    are no trusted ones; an empty table keeps nothing. All columns come through.
    """
    given = docs.columns
    marked, back = shield(docs, quality_rules.OUT)
    found = quality_rules.score(marked, registry.trusted_ids(spark, sf_dir))
    return found.where(f"{quality_rules.OUT}.kept").select(*marked.columns).withColumnsRenamed(back).select(*given)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in eight of ten of its five-word shingles or more.

    The one of the least id stays (null last), of equal ids the one of the least hash of its text.
    Texts without words, null ones too, are one group; of rows that repeat one stays; an empty table
    gives none. All columns come through.
    """
    return simhash_dedup.drop_near_duplicates(docs, shingle_words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that start more than once; n_chars follows the text.

    Every occurrence goes, within one text too. Null and short texts stay as they are, n_chars of a
    null text is null; a text that is all passages stays with what is left of its blanks; rows that
    repeat an id and text lose what they share. All columns come through.
    """
    names, (out,) = docs.columns, fresh(docs, "ranges")
    at = names.index("text")
    found = substring_dedup.remove_repeats(docs, width=35, out=out).select(*names, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = b.column(b.num_columns - 1).to_pylist()
            text = [t.as_py() if not r else substring_dedup.cut(t.as_py(), [(x["lo"], x["hi"]) for x in r]) for t, r in zip(b.column(at), ranges, strict=True)]
            columns = [pa.array(text, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(run, docs.schema).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it.

    Rows that repeat an id and a text share their copies; null texts have size zero and are taken
    as their source's whole repetitions say; a null source is a source of its own; an empty table
    gives no rows. All columns come through.
    """
    docs, back = shield(docs, "_mx_")
    keys = ["_mx_doc", "_mx_none", "_mx_text"]
    id_, text = F.col("doc_id").cast("long"), F.xxhash64("text")
    marks = {"_mx_doc": F.coalesce(id_, F.lit(0).cast("long")), "_mx_none": id_.isNull(), "_mx_text": text}
    taken = mixing.mix(docs).withColumns({**marks, "_mx_text": F.col("text_key")})
    taken = stored(taken.groupBy(*keys).agg(F.sum("copies").alias("_mx_all"), F.count("*").alias("_mx_rows")).where("_mx_all > 0"), "taken")
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("_mx_all"))
    own = F.expr("_mx_all DIV _mx_rows") + (F.col("_mx_at") <= F.col("_mx_all") % F.col("_mx_rows")).cast("long")
    dealt = docs.withColumns(marks).join(taken, keys).withColumn("_mx_at", at).withColumn("_mx_own", own).where("_mx_own > 0")
    copied = dealt.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_mx_own")))
    return copied.select(*docs.columns).withColumnsRenamed(back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and decoded texts, of every row.

    Null and empty texts have no tokens; rows that repeat, and null ids, stay; an empty table gives
    no rows. Other columns are not read.
    """
    return bpe_codec.digest(docs, registry.tokenizer_path(registry.BYTE_BPE))


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("mixing", mix_sources), ("bpe", encode)]

#: Hashed n-grams, sketches and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written on its way is deleted once its rows are stored."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, docs, since=before)
    return STAGES[-1][1](spark, docs, sf_dir)
