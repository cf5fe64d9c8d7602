"""Rows that break a rule go apart, and none is lost."""

from __future__ import annotations

from test_rules import AT, _in_batches, state_rows

from tidemark.operators import merge, rules


def test_split_keeps_every_row(spark, tmp_path):
    good = dict(canonical_url="u", content_hash="h", status="active", manual_status="none")
    state = state_rows(
        spark,
        dict(id=1, **good),
        dict(id=2, **{**good, "status": "odd", "content_hash": None}),
        dict(id=3, **good, prize_priority=101),
        dict(id=4, **{**good, "manual_status": None}, prize_category="odd"),
        dict(id=5, **good, prize_category=None, france_eligibility="eligible", entry_url_status="gone"),
    )
    want = {2: ["content_hash_given", "status_known"], 3: ["prize_priority_range"], 4: ["manual_status_given", "prize_category_known"]}
    valid, bad = rules.split(state, rules.GIVEAWAYS)
    assert {r.id: r.failed_rules for r in bad.collect()} == want and {r.id for r in valid.collect()} == {1, 5}
    rules.write_split(state, rules.GIVEAWAYS, f"{tmp_path}/out")
    valid, bad = rules.read_split(spark, f"{tmp_path}/out", state.schema)
    assert {r.id for r in valid.collect()} == {1, 5} and {r.id: r.failed_rules for r in bad.collect()} == want and valid.columns == state.columns


def test_bad_hours_of_a_stream_are_quarantined(spark, tmp_path):
    schema = "giveaway_id long, change_id long, changed_at timestamp, hours double"
    stream = _in_batches(spark, f"{tmp_path}/in", schema, [(1, 1, AT(0), 2.5), (2, 2, AT(0), 0.5)], [(3, 3, AT(1), 721.0), (4, 4, AT(1), None), (5, 5, AT(1), 720.9)])
    rules.stream_split(stream, rules.REMINDERS, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    valid, bad = rules.read_split(spark, f"{tmp_path}/out", stream.schema)
    assert {r.giveaway_id for r in valid.collect()} == {1, 4, 5} and {r.giveaway_id: r.failed_rules for r in bad.collect()} == {2: ["hours_range"], 3: ["hours_range"]}


def test_rules_over_other_columns_are_left_out(spark):
    df = spark.createDataFrame([(4, -1), (5, 0)], "crawl_interval_minutes int, consecutive_failures int")
    assert [r.failed_rules for r in rules.checked(df, rules.SOURCES).collect()] == [["interval_least", "failures_not_negative"], []]


def test_settings_deletions_and_keys(spark):
    sources = spark.createDataFrame([(1, 60, True), (2, 60, False), (3, 60, True)], "id long, crawl_interval_minutes int, enabled boolean")
    changes = spark.createDataFrame([(1, 1, AT(1), 30.5, None), (1, 2, AT(2), 3.0, False), (2, 3, AT(1), None, True), (2, 4, AT(0), 9.0, False)], "id long, change_id long, changed_at timestamp_ntz, interval_minutes double, enabled boolean")
    assert {r.id: (r.crawl_interval_minutes, r.enabled) for r in merge.source_settings(sources, changes).collect()} == {1: (30, False), 2: (9, True), 3: (60, True)}
    state = state_rows(spark, dict(id=1, canonical_url="https://a.example/?a=1", platform="gleam", platform_campaign_id="AbCd1"), dict(id=2, canonical_url="https://b.example/"))
    gone = spark.createDataFrame([("HTTPS://A.example?a=1&utm_source=x",), ("https://none.example/",)], "url string")
    left = merge.delete_urls(state, gone)
    assert [r.id for r in left.collect()] == [2] and left.columns == state.columns
    empty, runs = merge.purge(state, sources)
    assert empty.count() == runs.count() == 0 and empty.schema == state.schema
    done = spark.createDataFrame([(None, "https://gleam.io/AbCd1/win"), ("abcd1", None), (" ", "https://sweepwidget.com/c/12"), ("zzzz9", None)], "key string, url string")
    assert {r.key: (r.id, r.manual_status) for r in merge.mark_completed(state, done, "gleam").collect()} == {"abcd1": (1, "entered"), "zzzz9": (None, None)}
