"""What the operators share: tables, the shared scratch folder, words, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch folders that this driver has handed out and not released yet.
_handed_out: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    In local mode a fresh temporary folder stands in where none is named; on a cluster that is an
    error, since executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def written() -> int:
    """How many scratch tables have been handed out so far and not released."""
    return len(_handed_out)


def release(spark: SparkSession, *keep: DataFrame, since: int = 0) -> int:
    """Delete the scratch tables written after the first ``since``, but those that the tables of ``keep`` read; how many were deleted.

    For the caller who has written or used up what the operators returned: their results read the
    scratch tables until then.
    """
    files = [f for df in keep for f in df.inputFiles()]
    newer = _handed_out[since:]
    held = [p for p in newer if any(p.rsplit("/", 1)[1] in f for f in files)]
    gone = [p for p in newer if p not in held]
    _delete(spark, gone)
    return len(gone)


def discard(*done: DataFrame) -> int:
    """Delete the scratch tables that the tables of ``done`` read, for the operator that wrote them and reads them no more; how many were deleted."""
    files = [f for df in done for f in df.inputFiles()]
    gone = [p for p in _handed_out if any(p.rsplit("/", 1)[1] in f for f in files)]
    if gone:
        _delete(done[0].sparkSession, gone)
    return len(gone)


def _delete(spark: SparkSession, gone: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        _handed_out.remove(p)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shield(df: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns that begin with an operator's own prefix out of its way, and what names them back (for ``withColumnsRenamed``)."""
    clash = [c for c in df.columns if c.lower().startswith(prefix)]
    away = dict(zip(clash, fresh(df, *(f"kept{c}" for c in clash)), strict=True))
    return df.withColumnsRenamed(away), {v: k for k, v in away.items()}


#: With it, Spark deletes the shuffle files of a query once the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and outlives executors. What was shuffled for it is deleted."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of longs, as ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps; each is two grouped minima and joins, and each
    round is written to the shared folder. A hub's minimum is pre-aggregated, and the joins that
    give it back are plain sort-merge joins, which adaptive execution splits at a hub. The driver
    holds a count and a checksum a round.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, stored(small, "edges")
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled edges are stars: every node points at its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
