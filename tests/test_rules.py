"""Rules by input and output, written here and not taken from the library's tables; and whole jobs."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import acceptability, listings, prizes, scoring
from tidemark.operators import actions, backfill, merge
from tidemark.plans import candidates, ingest
from tidemark.sources import snapshots
from tidemark.sources.fixtures import view
from tidemark.streaming import health
from tidemark.streaming.ingest import ingest_tick, stream_ingest

AT = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)


def test_whole_words_are_searched_from_their_first_letter(spark):
    texts = ["win", "a win.", "win-win", "winter win", "winter", "twin", "win\n", "\nwin", "9win", "éwin", "win win-", "winwin", "wins", "", None, "swin win"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", scoring.has_phrase(F.col("t"), "win").alias("got"), F.col("t").rlike(scoring.edge_pattern("win")).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert [r.got for r in rows] == [True, True, False, True, False, False, True, True, False, True, True, False, False, False, None, True]
    # No alternation at every letter of the text: that took nine times as long.
    plan = df.select(scoring.has_phrase(F.col("t"), "win"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(^|" not in plan


def test_text_verdicts(spark):
    cases = [
        ("", None),
        ("Fill in the form", True),
        ("Follow us. Bonus: comment below", True),
        ("You must comment below to enter", False),
        ("Retweet to enter", False),
        ("Bonus entries: share this post", True),
        ("Retweet", None),
        ("To enter you must tag 2 friends\nOptional: visit our site", False),
        ("Pour participer, commentez et partagez cette vidéo", False),
        ("Visit our page\nBonus: retweet", True),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", acceptability.text_verdict(F.col("t")).alias("v")).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i].acceptable is want, text
        assert (got[i].reason is not None) == (want is False)
    assert got[3].signals == ["comment"] and got[3].has_path is False and got[2].non_public == 1


def test_verdicts_merge_as_a_ladder(spark):
    v = acceptability.verdict
    cases = [
        (v(True, False, "local"), None, True, None, (False, "local")),
        (v(False, True, has_path=True), True, False, "x", (True, None)),
        (v(False, True), True, None, "said", (False, "said")),
        (v(), None, False, None, (False, "requires public social-media action")),
        (v(), None, True, None, (True, None)),
        (v(), None, None, None, (None, None)),
    ]
    one = spark.range(1)
    for local, requires, ok, reason, want in cases:
        m = one.select(acceptability.merge_verdict(local, F.lit(requires).cast("boolean"), F.lit(ok).cast("boolean"), F.lit(reason).cast("string")).alias("m")).first().m
        assert (m.acceptable, m.reason) == want


@pytest.mark.parametrize(("geo", "category", "kept"), [("Worldwide", "Gaming", True), ("Worldwide", "Travel", False), ("US", "Gaming", False), ("UK/Worldwide", None, True), (None, "Cash", False), ("International", "Trip and hotel", False)])
def test_listing_preference(spark, geo, category, kept):
    lit = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(listings.listing_preference(lit(geo), lit(category), lit(None)).alias("x")).first().x is kept


@pytest.mark.parametrize(("text", "category"), [("win 500 euros", "cash"), ("win eur 500", "cash"), ("€500", None), ("500 € a gagner", None), ("50% off", "discount"), ("50 % off", None), ("win a coupon", "discount")])
def test_amounts_and_discounts(spark, text, category):
    row = prizes.prize_preference(spark.createDataFrame([(text,)], "t string"), F.col("t"), prefix="p_").first()
    assert row.p_category == (category or "unknown")


def test_friction_of_campaigns(spark):
    rows = [(1, "email_subscribe", True, None), (2, "refer_friend", True, None), (3, "refer_friend", False, None), (4, "visit", False, 7), (5, "twitter_follow", True, None), (5, "instagram_follow", True, None), (6, "visit", True, None), (7, "essay", True, None)]
    acts = spark.createDataFrame(rows, "campaign_id long, entry_type string, mandatory boolean, actions_required int")
    known = spark.createDataFrame([(i, i == 6, False) for i in range(1, 9)] + [(9, False, True)], "campaign_id long, login_required boolean, has_paid boolean")
    got = {r.campaign_id: r.friction for r in actions.platform_friction(acts, known).collect()}
    assert got == {1: "easy", 2: "hard", 3: "easy", 4: "hard", 5: "medium", 6: "medium", 7: "hard", 8: "easy", 9: "hard"}


def test_a_campaigns_own_actions(spark):
    rows = [
        (1, [("twitter_retweet", True), ("instagram_comment", True), ("visit", False)], None, False, ["twitter_retweet", "instagram_comment"], "medium"),
        (2, [("email_subscribe", True), ("twitter_tweet", False)], 1, True, ["twitter_tweet"], "easy"),
        (3, [("twitter_tweet", False), ("visit_page", False)], 2, False, ["twitter_tweet"], "easy"),
        (4, [("odd_widget", False)], None, True, [], "easy"),
        (5, [("odd_widget", None), (None, None), ("twitter_tweet", None)], None, None, None, "easy"),
        (6, [], None, None, None, "easy"),
        (7, None, 3, None, None, None),
        (8, [("visit_page", True), ("question", True), ("email_submit", True)], 2, True, [], "easy"),
        (9, [("visit_page", True), ("question", True), ("twitter_follow", True)], 2, True, [], "medium"),
    ]
    schema = "i int, actions array<struct<entry_type: string, mandatory: boolean>>, quota int, acceptable boolean, signals array<string>, friction string"
    df = spark.createDataFrame(rows, schema)
    c = F.col
    got = df.select("i", actions.array_verdict(c("actions"), c("quota")).alias("v"), actions.array_friction(c("actions"), c("quota"), F.lit(False), F.lit(False)).alias("f")).collect()
    for r, (i, _, _, acceptable, signals, friction) in zip(sorted(got), rows, strict=True):
        assert (r.v and r.v.acceptable) is acceptable and (r.v and r.v.signals) == signals and r.f == friction, i


def test_the_array_says_what_the_rows_say(spark):
    """One campaign's array against the grouped form, on all campaigns of the fixture."""
    acts = view(spark, "/root/testdata/sf0.01", "campaign_actions")
    whole = acts.groupBy("campaign_id").agg(F.collect_list(F.struct("entry_type", "mandatory")).alias("a"), F.max("actions_required").alias("quota"))
    one = whole.select("campaign_id", actions.array_verdict(F.col("a"), F.col("quota")).alias("v"), actions.array_friction(F.col("a"), F.col("quota"), F.lit(False), F.lit(False)).alias("f"))
    grouped = actions.platform_verdict(acts).join(actions.platform_friction(acts, acts.select("campaign_id", F.lit(False).alias("login_required"), F.lit(False).alias("has_paid")).distinct()), "campaign_id")
    both = one.join(grouped, "campaign_id")
    same = [F.col(f"v.{x}").eqNullSafe(F.col(f"says.{x}")) for x in ("acceptable", "requires_public", "reason", "has_path", "public_available", "non_public")]
    assert both.where(~(same[0] & same[1] & same[2] & same[3] & same[4] & same[5] & F.col("f").eqNullSafe(F.col("friction")))).count() == 0 < both.count()


def _candidates(spark, *pages):
    rows = [(i, u, h, a, 200, 1, "") for i, (a, u, h) in enumerate(pages)]
    return {r.canonical_url: r for r in ingest.page_candidates(spark.createDataFrame(rows, snapshots.PAGES), threshold=0.1).collect()}


def _campaign(*methods, **incentive):
    payload = {"campaign": {"key": "AbCd1", "name": "Win a PlayStation giveaway", "site_name": "Shop", "terms_and_conditions": "Open worldwide"}, "incentive": incentive, "entry_methods": [{"entry_type": t, "mandatory": m} for t, m in methods]}
    return f"<div ng-init='initCampaign({json.dumps(payload)})'></div>"


def test_the_payloads_actions_decide_in_the_ingest(spark):
    url = "https://gleam.io/{}/win"
    got = _candidates(
        spark,
        ("gleam", url.format("AbCd1"), _campaign(("twitter_retweet", True), ("instagram_comment", True))),
        ("gleam", url.format("AbCd2"), _campaign(("email_subscribe", True), ("twitter_retweet", False))),
        ("gleam", url.format("AbCd3"), _campaign(("refer_friend", True))),
        ("gleam", url.format("AbCd4"), _campaign(("twitter_tweet", False), ("instagram_comment", False), actions_required=1)),
    )
    verdicts = {u[-8:-4]: (r.status, r.entry_verdict.acceptable, r.friction) for u, r in got.items()}
    assert verdicts == {"bCd1": ("rejected", False, "medium"), "bCd2": ("candidate", True, "easy"), "bCd3": ("rejected", False, "hard"), "bCd4": ("rejected", False, "easy")}
    one = got[url.format("AbCd1")]
    assert "requires public social-media action" in one.skip_reasons and one.entry_verdict.signals == ["twitter_retweet", "instagram_comment"]
    assert (one.platform, one.platform_campaign_id) == ("gleam", "AbCd1")


CARDS = """<body><a href="/sweepstakes/countHits.pl?chi=11&amp;chu=http%3A%2F%2Fgl!!3!!5m.!!2o%2FAbCd1%2Fc!!5sh">Acme -- Win Cash Giveaway</a>
<p>Enter for a chance to win $500 cash</p><p>End Date: 2026-05-03</p><p>Restrictions: Open Worldwide</p>
<a href="/sweepstakes/countHits.pl?chi=12&chu=http%3A%2F%2Fb.example%2Fmug">Bolt -- Win a Mug Contest</a><p>Enter for a chance to win a mug</p><p>Restrictions: UK residents only</p>
<a href="/sweepstakes/countHits.pl?chi=11&chu=x">again</a><a href="/other">no card</a><a href="contests.pl?p=2">2</a></body>"""


def test_a_listings_cards_are_candidates(spark):
    got = _candidates(spark, ("contestgirl", "https://www.contestgirl.com/contests/contests.pl?f=s", CARDS), ("contestgirl", "https://www.contestgirl.com/contests/comment.pl?i=3", CARDS))
    first, second = (got[f"https://www.contestgirl.com/contests/comment.pl?i={i}"] for i in (11, 12))
    assert len(got) == 2
    assert (first.title, first.prize, first.entry_url, first.end_at) == ("Acme -- Win Cash Giveaway", "Enter for a chance to win $500 cash", "http://gleam.io/AbCd1/cash", dt.datetime(2026, 5, 3))
    assert first.excerpt.split("\n") == ["Acme -- Win Cash Giveaway", "Enter for a chance to win $500 cash", "End Date: 2026-05-03", "Restrictions: Open Worldwide"]
    assert (first.platform, first.platform_campaign_id, first.status, first.original_url) == ("gleam", "AbCd1", "candidate", "https://www.contestgirl.com/contests/contests.pl?f=s")
    assert (second.restriction, second.status, second.entry_url) == ("UK residents only", "rejected", "http://b.example/mug")


def test_candidate_status_and_selection(spark):
    base = dict(title=None, prize=None, excerpt=None, restriction=None, method_text=None, purchase_text=None, free_hint=None, category=None, filter_text=None, expired=None, friction_override=None)
    cases = [
        (dict(title="Win a PlayStation 5", excerpt="Enter your details, no purchase necessary", restriction="Open worldwide"), "candidate", "easy", 1),
        (dict(title="Bitcoin giveaway"), "rejected", None, None),
        (dict(title="Win a mug", restriction="UK residents only"), "rejected", None, None),
        (dict(title="Win a mug", expired=True), "expired", None, None),
        (dict(title="Win a mug", excerpt="You must retweet to enter"), "rejected", None, None),
        (dict(title="Win a mug", excerpt="Purchase required", purchase_text="No"), "candidate", None, None),
        (dict(title="Win a mug", excerpt="Subscribe to the newsletter"), "candidate", "medium", None),
        (dict(title="Win a mug", friction_override="hard"), "candidate", "hard", 80),
    ]
    names = list(base)
    types = {"free_hint": "boolean", "expired": "boolean"}
    rows = [(i, *[{**base, **c[0]}[n] for n in names]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} {types.get(n, 'string')}" for n in names)).withColumn("platform_says", F.lit(None).cast(acceptability.VERDICT))
    got = {r.i: r for r in candidates.candidate_status(df).collect()}
    for i, (given, status, friction, priority) in enumerate(cases):
        assert got[i].status == status, (given, got[i].skip_reasons)
        assert friction in (None, got[i].friction) and priority in (None, got[i].priority), given
        assert got[i].skip_analyze == (status != "candidate")
    scored = spark.createDataFrame([("u", 0.5, False, 2), ("u", 0.9, False, 1), ("v", 0.4, False, 3), ("w", 0.9, True, 4), (None, 0.9, False, 5)], "canonical_url string, score double, skip boolean, ordinal long")
    assert [tuple(r) for r in candidates.select_candidates(scored).collect()] == [("u", 0.9, False, 1)]


STATE = (
    "id long, canonical_url string, original_url string, domain string, source_id long, title string, prize string, prize_priority int, prize_category string, wanted_prize boolean, free_entry boolean, eligible_france boolean, france_eligibility string, "
    "entry_method string, entry_acceptable boolean, requires_public_social_action boolean, entry_rejection_reason string, entry_url string, entry_url_status string, platform string, platform_campaign_id string, status string, manual_status string, confidence double, content_hash string, "
    "raw_excerpt string, link_hints array<string>, discovered_at timestamp_ntz, last_seen_at timestamp_ntz, end_at timestamp_ntz, analyzed_at timestamp_ntz, analysis_json string"
)


def state_rows(spark, *rows):
    names = [x.split()[0] for x in STATE.split(", ")]
    full = [tuple({"manual_status": "none", "status": "candidate", **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, STATE)


def test_a_batch_keeps_ids_unique_and_meets_itself(spark):
    state = state_rows(spark, dict(id=1, canonical_url="u1", content_hash="h", title="Old", last_seen_at=AT(0)), dict(id=2, canonical_url="u2", platform="gleam", platform_campaign_id="k", last_seen_at=AT(0), analyzed_at=AT(0), wanted_prize=True, status="active"), dict(id=3, canonical_url="u3", entry_url="https://gleam.io/e/x", analyzed_at=AT(1)), dict(id=4, canonical_url="u4", entry_url="https://shop.example/x"))
    b = "ordinal long, canonical_url string, source_id long, title string, content_hash string, platform string, platform_campaign_id string, entry_url string, wanted_prize boolean, status string, seen_at timestamp_ntz"
    batch = spark.createDataFrame(
        [
            (1, "u1", 5, None, "h2", None, None, None, None, "candidate", AT(2)),
            (2, "u1", 6, "New", "h2", None, None, None, None, "candidate", AT(1)),
            (3, "x1", 5, "T", "h", "gleam", "k", None, False, "rejected", AT(2)),
            (4, "x2", 5, None, "h", None, None, "https://gleam.io/e/x?utm_source=a", None, "candidate", AT(2)),
            (5, "x3", 5, "A", "h", "gleam", "new", None, None, "candidate", AT(2)),
            (6, "x4", 5, "B", "h", "gleam", "new", None, None, "expired", AT(3)),
            (7, "x5", 5, None, "h", None, None, "https://shop.example/x", None, "candidate", AT(2)),
            (8, "x5", 5, None, "h", None, None, None, None, "candidate", AT(4)),
        ],
        b,
    )
    resolved = merge.resolve_identity(batch, state)
    how = {r.ordinal: (r.matched_by, r.giveaway_id) for r in resolved.collect()}
    assert [how[i][0] for i in range(1, 9)] == ["url", "url", "platform", "entry", "new", "batch", "new", "new"]
    assert how[3][1] == 2 and how[4][1] == 3 and how[5][1] == how[6][1] and how[7][1] == how[8][1] != 4
    rows = {r.id: r for r in merge.merge_crawl(state, resolved).collect()}
    assert len(rows) == merge.merge_crawl(state, resolved).count() == 6
    assert (rows[1].title, rows[1].last_seen_at, rows[1].source_id) == ("New", AT(2), 6)
    assert (rows[2].status, rows[2].wanted_prize, rows[2].title) == ("active", True, "T")
    new = rows[how[5][1]]
    assert (new.canonical_url, new.title, new.status, new.manual_status, new.discovered_at) == ("x3", "A", "expired", "none", AT(2))


def test_verdicts_made_again(spark):
    state = state_rows(
        spark,
        dict(id=1, title="Win", entry_method="actions_required=2; mandatory:email_subscribe,twitter_retweet; optional:referral", status="active"),
        dict(id=2, title="Win", analysis_json=json.dumps({"_meta": {"mandatory_entry_types": ["visit_website"]}}), entry_acceptable=False, requires_public_social_action=True, entry_rejection_reason="requires public social-media action", status="rejected", analyzed_at=AT(1)),
        dict(id=3, title="Win", analysis_json=json.dumps({"mandatory_actions": [{"entry_type": "twitter_tweet"}, "visit"], "optional_actions": ["essay"]}), status="expired"),
        dict(id=4, title="Win", raw_excerpt="Required: instagram_story", status="candidate"),
        dict(id=5, title="Win a mug", status="candidate"),
    )
    acts = {r.id: ([(a.entry_type, a.mandatory) for a in r.actions], r.quota) for r in backfill.recover_actions(state).collect()}
    assert acts[1] == ([("email_subscribe", True), ("twitter_retweet", True), ("referral", False)], 2)
    assert acts[3][0] == [("twitter_tweet", True), ("visit", True), ("essay", False)] and acts[4][0] == [("instagram_story", True)]
    changes = {r.id: r for r in backfill.backfill_verdicts(state).collect()}
    assert {i: (r.entry_acceptable, r.status) for i, r in changes.items()} == {1: (False, "rejected"), 3: (False, "expired"), 4: (False, "rejected"), 5: (True, "candidate")}
    again = backfill.reevaluate_rejections(state).collect()
    assert [(r.id, r.entry_acceptable, r.status, r.entry_rejection_reason) for r in again] == [(2, True, "active", None)]
    after = {r.id: r for r in backfill.apply_changes(state, backfill.reevaluate_rejections(state)).collect()}
    assert after[2].status == "active" and after[1].status == "active"


def _in_batches(spark, path, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_late_rows_count_in_their_place(spark, tmp_path):
    schema = "source_id long, id long, started_at timestamp, failed boolean"
    first, second, third = [(1, 1, AT(5), True)], [(1, 2, AT(3), True), (1, 3, AT(6), True)], [(1, 4, AT(4), False), (1, 4, AT(4), False)]
    got = health.drained(health.stream_source_health(_in_batches(spark, f"{tmp_path}/r", schema, first, second, third)), "late_runs", "update", f"{tmp_path}/c1").collect()
    assert sorted(r.consecutive_failures for r in got) == [1, 2, 3]
    checks = "giveaway_id long, check_id long, checked_at timestamp, http_status int"
    stream = _in_batches(spark, f"{tmp_path}/k", checks, [(1, 1, AT(5), 503)], [(1, 2, AT(3), 404), (1, 3, AT(6), 503)], [(1, 4, AT(4), 200)])
    got = health.drained(health.stream_link_health(stream), "late_checks", "update", f"{tmp_path}/c2").collect()
    assert sorted(r.entry_check_fail_count for r in got) == [1, 2, 3] and all(r.entry_url_status == "temporary_error" for r in got) and sorted(r.rejected for r in got) == [False, True, True]


def test_reminders_fall_due_once(spark, tmp_path):
    schema = "giveaway_id long, change_id long, changed_at timestamp, hours double, manual_status string"
    stream = _in_batches(spark, f"{tmp_path}/m", schema, [(1, 1, AT(0), 2.5, "none"), (2, 2, AT(0), 3.0, "none"), (3, 3, AT(0), 900.0, "none"), (4, 4, AT(0), 2.0, "ignored")], [(2, 5, AT(1), None, "none")], [(9, 6, AT(60), None, "none")], [(9, 7, AT(61), None, "none")], [(9, 8, AT(62), None, "none")])
    got = health.drained(health.stream_reminders(stream), "due", "append", f"{tmp_path}/c3").collect()
    assert [(r.giveaway_id, r.remind_at) for r in got] == [(1, AT(2))]


def test_last_day_slides_by_the_hour(spark, tmp_path):
    schema = "started_at timestamp, pages_fetched long, errors_count long"
    stream = _in_batches(spark, f"{tmp_path}/d", schema, [(AT(0), 1, 0), (AT(23), 2, 1)], [(AT(200), 5, 5)], [(AT(201), 5, 5)])
    got = {r.up_to: r.pages for r in health.drained(health.stream_last_day(stream), "last_day", "append", f"{tmp_path}/c4").collect()}
    assert got[AT(24)] == 3 and got[AT(25)] == 2 and got[AT(1)] == 1


def test_a_stream_of_pages_makes_versions(spark, tmp_path):
    html = "<title>Jeu concours</title><main>Participez : tirage au sort, règlement du jeu. Inscription avant le 3 mai. Win a PlayStation 5</main>"
    rows = [[(i, f"https://a.example/jeu-concours/{i}", html + str(i), None, 200, 1, "")] for i in (1, 2)]
    pages = _in_batches(spark, f"{tmp_path}/p", snapshots.PAGES, *rows)
    state = snapshots.BucketedState(f"{tmp_path}/state", buckets=8)
    stream_ingest(pages, state_rows(spark), state, f"{tmp_path}/c5", "2026-01-01 00:00:00").awaitTermination()
    schema = state_rows(spark).schema
    assert state.versions(spark) == [0, 1]
    assert sorted(r.canonical_url for r in state.read(spark, schema).collect()) == ["https://a.example/jeu-concours/1", "https://a.example/jeu-concours/2"]
    assert state.read(spark, schema, before=1).count() == 1 and state.read(spark, schema, before=0).count() == 0
    # The last batch again: the same version, the same rows.
    again = spark.createDataFrame(rows[1], snapshots.PAGES)
    before = sorted(state.read(spark, schema).drop("id").collect(), key=str)
    ingest_tick(again, state, state_rows(spark), 1, "2026-01-01 00:00:00")
    assert state.versions(spark) == [0, 1] and sorted(state.read(spark, schema).drop("id").collect(), key=str) == before


def test_a_tick_writes_what_it_touches(spark, tmp_path):
    state = snapshots.BucketedState(f"{tmp_path}/s", buckets=16)
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v int")
    schema = "id long, v int"
    assert state.read(spark, schema).count() == 0
    state.write(rows(range(200), 0), 0)
    touched = state.touched(rows([3, 5], 0), "id")
    part = state.read(spark, schema, only=touched)
    changed = part.withColumn("v", F.when(F.col("id").isin(3, 5), 1).otherwise(F.col("v")))
    assert state.write(changed, 1, touched) == touched and len(touched) <= 2
    assert {r.id for r in state.read(spark, schema).where("v = 1").collect()} == {3, 5} and state.read(spark, schema).count() == 200
    # A version again gives what it gave; a bucket without rows goes.
    state.write(changed, 1, touched)
    assert state.read(spark, schema).count() == 200 and state.read(spark, schema, before=1).where("v = 1").count() == 0
    left = 200 - part.count()
    state.write(changed.where("false"), 2, touched)
    assert state.read(spark, schema).count() == left
    gone = state.drop_old(spark, keep=1)
    assert state.versions(spark) == [2] and {f"v=1/bucket={b}" for b in touched} <= set(gone) and state.read(spark, schema).count() == left


def test_old_snapshots_are_dropped(spark, tmp_path):
    for v in range(4):
        snapshots.write_snapshot(spark.range(v), f"{tmp_path}/s", v)
    assert snapshots.drop_snapshots(spark, f"{tmp_path}/s", 2) == [0, 1] and snapshots.versions(spark, f"{tmp_path}/s") == [2, 3]
    assert snapshots.read_snapshot(spark, f"{tmp_path}/s").count() == 3 and snapshots.read_snapshot(spark, f"{tmp_path}/none") is None


def test_silent_keys_are_forgotten(spark, tmp_path):
    schema = "source_id long, id long, started_at timestamp, failed boolean"
    batches = [[(1, 1, AT(0), True)], [(2, 2, AT(5), True)], [(2, 3, AT(7), True)], [(1, 4, AT(8), True)]]
    run = lambda name, **more: sorted((r.source_id, r.consecutive_failures) for r in health.drained(health.stream_source_health(_in_batches(spark, f"{tmp_path}/{name}", schema, *batches), **more), name, "update", f"{tmp_path}/c_{name}").collect())
    assert run("kept") == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert run("forgotten", keep="3 hours") == [(1, 1), (1, 1), (2, 1), (2, 2)]


def test_the_frontier_follows_what_pages_link(spark):
    page = lambda i, url, *links, adapter=None: (i, url, "".join(f"<a href='{x}'>go</a>" for x in links), adapter, 200, 1, "")
    pages = [
        page(1, "https://a.example/", "/b?utm_source=x", "/c", "mailto:x@y.z", "#top"),
        page(2, "https://a.example/b", "/c", "/d", "/"),
        page(3, "https://a.example/d", "/e"),
        page(4, "https://www.sweepstakesbible.com/", "/giveaways/cash", "/about", adapter="sweepstakes_bible"),
    ]
    seeds = spark.createDataFrame([(1, "HTTPS://A.example"), (2, "https://www.sweepstakesbible.com/"), (3, "https://a.example/d")], "source long, url string")
    snaps = spark.createDataFrame(pages, snapshots.PAGES)
    got = {(r.source, r.node.split("/", 3)[3], r.depth) for r in ingest.crawl_frontier(snaps, seeds, 2, 10).collect()}
    assert got == {(1, "", 0), (1, "b", 1), (1, "c", 1), (1, "d", 2), (2, "", 0), (2, "giveaways/cash", 1), (3, "d", 0), (3, "e", 1)}


def test_what_a_run_leaves(spark):
    page = "<title>Jeu concours</title><main>Participez : tirage au sort, règlement du jeu. Inscription avant le 3 mai. Win a PlayStation 5</main>"
    rows = [(1, "https://a.example/jeu-concours/1", page, None, 200, 1, ""), (2, "https://a.example/jeu-concours/2", page + "x", None, 200, 1, ""), (3, "https://a.example/x", None, None, 503, 1, ""), (4, "https://b.example/x", None, None, 403, 2, ""), (5, "https://c.example/jeu-concours/1", page, None, 200, 3, "")]
    state = state_rows(spark, dict(id=7, canonical_url="https://c.example/jeu-concours/1", content_hash="old", last_seen_at=AT(0)))
    sources = spark.createDataFrame([(i, 60, n, AT(0)) for i, n in ((1, 3), (2, 1), (3, 0), (4, 2))], "id long, crawl_interval_minutes int, consecutive_failures int, next_crawl_at timestamp_ntz")
    provenance = spark.createDataFrame([(7, 3, AT(0), AT(0), "u")], "giveaway_id long, source_id long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, url string")
    run = ingest.crawl_run(spark.createDataFrame(rows, snapshots.PAGES), state, sources, provenance, "2026-01-01 10:00:00")
    assert run.state.count() == 3
    got = {r.source_id: (r.pages_fetched, r.errors_count, r.candidates_found, r.created, r.updated, r.previously_known, r.needs_analysis, r.status, r.error_summary) for r in run.runs.collect()}
    assert got == {1: (2, 1, 2, 2, 0, 0, 2, "partial", None), 2: (0, 1, 0, 0, 0, 0, 0, "failed", ingest.NO_PAGES), 3: (1, 0, 1, 0, 1, 0, 1, "success", None)}
    assert {r.id: (r.consecutive_failures, r.next_crawl_at) for r in run.sources.collect()} == {1: (0, AT(11)), 2: (2, AT(10.5)), 3: (0, AT(11)), 4: (2, AT(0))}
    kept = {(r.giveaway_id, r.source_id): (r.first_seen_at, r.last_seen_at, r.url) for r in run.provenance.collect()}
    assert kept[7, 3] == (AT(0), AT(10), "https://c.example/jeu-concours/1") and len(kept) == 3
    assert run.totals.get == {"candidates": 3, "rejected": 0, "skipped": 0}


def test_a_failed_call_leaves_its_rows_pending(spark):
    state = state_rows(spark, *[dict(id=i, canonical_url=f"u{i}", title="Win a mug", confidence=0.9, discovered_at=AT(i)) for i in range(30)])

    def fn(rows):
        if any(r["giveaway_id"] == 7 for r in rows):
            raise ValueError("no answer")
        return [{"is_giveaway": True, "france_eligibility": "eligible", "wanted_prize": True, "entry_acceptable": True, "end_date": None, "confidence": 0.9} for _ in rows]

    after = ingest.drain_queue(state.coalesce(1), fn, "2026-01-01 00:00:00")
    left = [r.id for r in after.where("analyzed_at IS NULL").collect()]
    assert 7 in left and 1 <= len(left) <= 10 and after.where("status = 'active'").count() == 30 - len(left)


def test_the_fixture_reaches_every_match(spark):
    d = "/root/testdata/sf0.01"
    from tidemark import registry

    found = {r.matched_by for r in registry.resolved(spark, d).select("matched_by").distinct().collect()}
    assert found == {"url", "platform", "entry", "batch", "new"}
    known = registry.state(spark, d)
    out = merge.merge_crawl(known, registry.resolved(spark, d))
    assert out.count() == out.select("id").distinct().count() > known.count() > view(spark, d, "crawl_batch").count()
