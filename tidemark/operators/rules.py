"""What rows of the tables must hold, and one pass that parts those that do from those that do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, StringType, StructType

from tidemark.operators.merge import validate

# What each column may hold, as SQL that any engine reads. A rule that is null holds.
_SETS = {
    "status": ("candidate", "active", "expired", "rejected", "uncertain"),
    "manual_status": ("none", "interested", "entered", "ignored", "won", "lost"),
    "entry_friction": ("easy", "medium", "hard", "unknown"),
    "prize_category": (
        "physical_good", "cash", "general_gift_card", "restricted_gift_card", "digital_game", "digital_good", "experience", "travel", "event_ticket", "service", "books_media", "discount", "subscription", "other", "unknown",
    ),
    "france_eligibility": ("eligible", "ineligible", "unknown"),
    "entry_url_status": ("live", "gone", "temporary_error", "blocked", "unknown"),
}


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


GIVEAWAYS = {
    "canonical_url_given": "canonical_url IS NOT NULL",
    "content_hash_given": "content_hash IS NOT NULL",
    "status_given": "status IS NOT NULL",
    "manual_status_given": "manual_status IS NOT NULL",
    **{f"{c}_known": _one_of(c, values) for c, values in _SETS.items()},
    "confidence_range": "confidence >= 0 AND confidence <= 1",
    "prize_priority_range": "prize_priority >= 0 AND prize_priority <= 100",
}
SOURCES = {
    "name_given": "name IS NOT NULL",
    "base_url_given": "base_url IS NOT NULL",
    "source_type_known": _one_of("source_type", ("giveaway_aggregator", "brand", "blog", "forum", "other")),
    "interval_least": "crawl_interval_minutes >= 5",
    "failures_not_negative": "consecutive_failures >= 0",
}
RUNS = {"status_known": _one_of("status", ("running", "success", "partial", "failed"))}
#: Changes of reminders: whole hours of up to thirty days, or none.
REMINDERS = {"hours_range": "floor(hours) >= 1 AND floor(hours) <= 720"}


def rules_for(rows: DataFrame, rules: dict[str, str]) -> dict[str, Column]:
    """The rules as columns; those over columns that the rows lack are left out."""
    have = {c.lower() for c in rows.columns}
    names = {n: set(e.replace("floor(", "").replace(")", "").replace("(", "").split()[:1]) for n, e in rules.items()}
    return {n: F.expr(e) for n, e in rules.items() if {c.lower() for c in names[n]} <= have}


def checked(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows with ``failed_rules``."""
    return validate(rows, rules_for(rows, rules))


def split(rows: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold every rule, and the others with ``failed_rules``; together they are all rows."""
    marked = checked(rows, rules)
    return marked.where(F.size("failed_rules") == 0).drop("failed_rules"), marked.where(F.size("failed_rules") > 0)


def write_split(rows: DataFrame, rules: dict[str, str], path: str) -> None:
    """Both outputs in one pass over the rows: ``part=valid`` and ``part=quarantined`` under ``path``."""
    part = F.when(F.size("failed_rules") == 0, "valid").otherwise("quarantined")
    checked(rows, rules).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(path)


def read_split(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_split` or :func:`stream_split` wrote: the valid rows, and the quarantined ones with ``failed_rules``."""
    whole = StructType([*schema.fields]).add("failed_rules", ArrayType(StringType())).add("part", "string")
    rows = spark.read.schema(whole).option("basePath", path.split("/batch=")[0]).option("recursiveFileLookup", "false").parquet(path)
    return rows.where("part = 'valid'").drop("failed_rules", "part", "batch"), rows.where("part = 'quarantined'").drop("part", "batch")


def stream_split(rows: DataFrame, rules: dict[str, str], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream's rows as :func:`write_split` parts them; a batch that is run again replaces its own files."""

    def step(batch: DataFrame, number: int) -> None:
        write_split(batch, rules, f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
