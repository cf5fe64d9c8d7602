"""A stream over all there is equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.sources.fixtures import view
from tidemark.streaming import health

DIR = "/root/testdata/sf0.001"


def streamed(spark, df, path, parts):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_source_health_equals_the_batch_fold(spark, tmp_path):
    runs = view(spark, DIR, "crawl_runs").where("source_id < 6").select("id", "source_id", "started_at", "failed")
    # One file: late rows of another micro-batch are left out by design.
    stream = streamed(spark, runs, f"{tmp_path}/runs", 1)
    got = health.drained(health.stream_source_health(stream), "health", "update", f"{tmp_path}/c1")
    want = merge.fold_after_reset(runs, "source_id", ["started_at", "id"], ~F.col("failed"), F.col("failed"), "started_at")
    assert {(r.source_id, r.consecutive_failures) for r in got.collect()} == {(r.source_id, r.streak) for r in want.collect()}


def test_last_seen_equals_the_batch_merge(spark, tmp_path):
    batch = view(spark, DIR, "crawl_batch").selectExpr("ordinal % 50 AS giveaway_id", "source_id", "seen_at", "entry_url AS url")
    stream = streamed(spark, batch, f"{tmp_path}/seen", 3)
    got = health.drained(health.stream_last_seen(stream), "last_seen", "complete", f"{tmp_path}/c2")
    empty = spark.createDataFrame([], "giveaway_id long, source_id long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, url string")
    want = merge.merge_provenance(empty, batch).drop("url")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_daily_counters_and_dedup(spark, tmp_path):
    runs = view(spark, DIR, "crawl_runs").withColumn("started_at", F.col("started_at").cast("timestamp"))
    stream = streamed(spark, runs, f"{tmp_path}/days", 1)
    got = health.drained(health.stream_counters(stream), "days", "append", f"{tmp_path}/c3").collect()
    want = {r.day: r.n for r in runs.groupBy(F.date_trunc("day", "started_at").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[r.day] == r.runs for r in got)

    seen = view(spark, DIR, "crawl_batch").selectExpr("canonical_url", "CAST(seen_at AS TIMESTAMP) AS seen_at")
    twice = seen.unionByName(seen)
    stream = streamed(spark, twice, f"{tmp_path}/seen", 1)
    assert health.drained(health.stream_dedup(stream, late="4000 days"), "once", "append", f"{tmp_path}/c4").count() == seen.select("canonical_url").distinct().count()


def test_link_health_equals_the_batch_fold(spark, tmp_path):
    checks = view(spark, DIR, "link_checks").where("giveaway_id < 40")
    stream = streamed(spark, checks, f"{tmp_path}/checks", 1)
    got = health.drained(health.stream_link_health(stream), "links", "update", f"{tmp_path}/c5")
    want = merge.fold_link_checks(checks)
    columns = ["giveaway_id", "entry_check_fail_count", "entry_url_status", "rejected"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
