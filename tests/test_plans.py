"""What the plans must not do, and rules on small hand-made rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import urls
from tidemark.operators import actions, merge

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_pairs_nothing_out_and_ranks_nothing_in_one_task(spark):
    text = plan(registry.queries()["list_inbox"](spark, DIR))
    assert "CartesianProduct" not in text and "Window" not in text
    assert "PushedFilters: [" in text


def test_queues_are_top_k(spark):
    for name in ("analysis_queue", "link_check_queue", "verdict_backfill_queue", "platform_queue"):
        assert "TakeOrderedAndProject" in plan(registry.queries()[name](spark, DIR))


def test_counters_read_the_state_once(spark):
    assert plan(registry.queries()["overview_stats"](spark, DIR)).count("FileScan") == 1


def test_backoff_doubles_to_six_hours(spark):
    got = spark.range(0, 8).select(merge.backoff_minutes(F.col("id")).alias("m")).collect()
    assert [r.m for r in got] == [0, 15, 30, 60, 120, 240, 360, 360]


def test_link_fold_ignores_blocked_and_resets_on_live(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(1, 7, at(1), 500), (2, 7, at(2), 403), (3, 7, at(3), None), (4, 8, at(1), 404), (5, 8, at(2), 200), (6, 9, at(1), 200), (7, 9, at(1), 429)]
    checks = spark.createDataFrame(rows, "check_id long, giveaway_id long, checked_at timestamp_ntz, http_status int")
    got = {r.giveaway_id: (r.entry_check_fail_count, r.entry_url_status, r.rejected) for r in merge.fold_link_checks(checks).collect()}
    assert got == {7: (2, "temporary_error", False), 8: (0, "live", True), 9: (1, "temporary_error", False)}


def test_canonical_url_cases(spark):
    cases = {
        " HTTP://User@Example.COM:80/a?b=2&utm_source=x&A=1#f ": "http://User@example.com/a?A=1&b=2",
        "https://example.com:443": "https://example.com/",
        "https://example.com:8443/?q=a+b&q=&x=%7e*": "https://example.com:8443/?q=&q=a+b&x=~%2A",
        "https://e.org/?PK_x=1&fbclid=2&k": "https://e.org/?k=",
        "ftp://example.com/": None,
        "/relative": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", urls.canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_pick_some_of_many_actions(spark):
    rows = [(1, t, False, 3) for t in ("email_subscribe", "visit_website", "newsletter", "twitter_follow", "twitter_retweet")]
    rows += [(2, t, False, 5) for t in ("email_subscribe", "visit_website", "quiz", "twitter_retweet")]
    rows += [(3, "referral", False, None), (3, "email_subscribe", True, None), (4, "twitter_retweet", True, None), (4, "visit", False, None), (5, "mystery", True, None)]
    df = spark.createDataFrame(rows, "campaign_id long, entry_type string, mandatory boolean, actions_required int")
    assert {r.campaign_id: r.verdict for r in actions.platform_verdict(df).collect()} == {1: "accept", 2: "reject", 3: "accept", 4: "reject", 5: "accept"}


def test_merge_keeps_decisions_and_is_idempotent(spark):
    state = registry.state(spark, DIR)
    seen = registry.resolved(spark, DIR).cache()
    once = merge.merge_crawl(state, seen).cache()
    twice = merge.merge_crawl(once, seen)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    kept = ["id", "manual_status", "analyzed_at", "analysis_json"]
    assert once.join(state.select("id"), "id", "left_semi").select(*kept).exceptAll(state.select(*kept)).count() == 0
    assert once.count() == once.select("id").distinct().count()


def test_a_failing_batch_leaves_its_rows_pending(spark):
    from tidemark.plans import ingest

    def fn(rows):
        if any(r["id"] == 7 for r in rows):
            raise RuntimeError("no")
        return [{"twice": 2 * r["id"]} for r in rows]

    got = {r.id: (r.twice, r.error) for r in ingest.enrich_batches(spark.range(12).coalesce(1), fn, "twice long", batch_size=4).collect()}
    assert got[0] == (0, None) and got[11] == (22, None) and got[7] == (None, "no") and got[4] == (None, "no")


def test_ingest_adds_new_pages_and_keeps_the_rest(spark):
    state = registry.state(spark, DIR)
    pages = spark.createDataFrame([(1, "https://new.example/?utm_source=a", "<title>Official rules: giveaway contest prize</title>"), (2, "https://NEW.example/", "<title>x</title>"), (3, "nonsense", "")], "page_id long, url string, html string")
    out = registry.ingest.ingest_pages(pages, state, registry.NOW)
    assert out.count() == state.count() + 1
    row = out.where("canonical_url = 'https://new.example/'").first()
    assert row.status == "candidate" and row.manual_status == "none" and row.title.startswith("Official rules")


def test_the_platforms_own_pages_are_no_campaigns(spark):
    own = "auth dashboard shopify-install cms_pages signed-in guides customers success security privacy terms faq atom webpack images by".split()
    rows = spark.createDataFrame([(f"https://gleam.io/{page}{tail}",) for page in own for tail in ("", "/Some-Slug")] + [("https://gleam.io/aB3dE/Some-Slug",)], "url string")
    got = {r.url: r.p for r in rows.select("url", urls.platform_identity(F.col("url")).alias("p")).collect()}
    assert got.pop("https://gleam.io/aB3dE/Some-Slug").campaign_id == "aB3dE"
    assert set(got.values()) == {None}
