"""The registered queries over the reference's own operators, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import pages as page
from tidemark.functions import acceptability, campaigns, entry, prizes, scoring, urls
from tidemark.operators import actions, listing, merge, rules
from tidemark.operators.listing import Filters
from tidemark.plans import gates, ingest
from tidemark.sources.fixtures import view, view_sql, with_views

Query = Callable[[SparkSession, str], DataFrame]

NOW, EVENT_NOW = "1996-02-17 12:00:00", "2024-01-16 00:00:00"

#: Columns that the state table has and the view lacks.
_EXTRA = {
    "entry_url": "CASE platform WHEN 'gleam' THEN concat('https://gleam.io/', platform_campaign_id, '/x') WHEN 'sweepwidget' THEN concat('https://sweepwidget.example/', platform_campaign_id, '/x') END",
    "entry_checked_at": "CASE WHEN entry_url_status IS NULL THEN NULL ELSE analyzed_at END",
    "updated_at": "last_seen_at",
}


def state(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "giveaways").selectExpr("*", *[f"{e} AS {c}" for c, e in _EXTRA.items()])


def sources(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sources")


_STATE_SQL = "WITH g AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _EXTRA.items()) + f" FROM ({view_sql('giveaways')})), sources AS ({view_sql('sources')}), runs AS ({view_sql('crawl_runs')})\n"
_NOW = f"TIMESTAMP '{NOW}'"
_EVENT_NOW = f"TIMESTAMP '{EVENT_NOW}'"
_REGION = "(eligible_france IS TRUE OR coalesce(france_eligibility = 'eligible', false))"
_OPEN = "manual_status IN ('none', 'interested')"
_INBOX = f"({_OPEN} AND status = 'active' AND wanted_prize IS TRUE AND {_REGION} AND entry_acceptable IS TRUE AND (entry_url_status IS NULL OR entry_url_status <> 'gone'))"
_WANTED = "CASE WHEN wanted_prize IS TRUE THEN 0 WHEN wanted_prize IS NULL THEN 1 ELSE 2 END"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _top(columns: str, where: str, order: str, limit: int) -> str:
    return _STATE_SQL + f"SELECT {columns} FROM g WHERE {where} ORDER BY {order} LIMIT {limit}"


@_add("load_state", _STATE_SQL + "SELECT id, status, prize_value_eur, json_extract_string(analysis_json, '$._meta.model') AS model, analysis_json IS NOT NULL AS analyzed FROM g")
def load_state(spark, d):
    meta = F.from_json("analysis_json", "struct<_meta: struct<model: string>>")
    return state(spark, d).select("id", "status", "prize_value_eur", meta["_meta"]["model"].alias("model"), F.col("analysis_json").isNotNull().alias("analyzed"))


@_add("due_sources", _STATE_SQL + f"SELECT * FROM sources WHERE enabled AND (next_crawl_at IS NULL OR next_crawl_at <= {_NOW})")
def due_sources(spark, d):
    return listing.due_sources(sources(spark, d), NOW)


@_add("list_sources", _STATE_SQL + "SELECT id, name, base_url, enabled FROM sources")
def list_sources(spark, d):
    return listing.list_sources(sources(spark, d)).select("id", "name", "base_url", "enabled")


@_add("analysis_queue", _top("id, wanted_prize, prize_priority, discovered_at", "analyzed_at IS NULL AND status = 'candidate' AND manual_status NOT IN ('entered', 'ignored', 'won', 'lost') AND id % 7 <> 3", f"{_WANTED}, coalesce(prize_priority, 40) DESC, discovered_at, id", 100))
def analysis_queue(spark, d):
    s = state(spark, d)
    return listing.analysis_queue(s, exclude=s.where("id % 7 = 3")).select("id", "wanted_prize", "prize_priority", "discovered_at")


@_add("pending_count", _STATE_SQL + "SELECT count(*) FILTER (manual_status NOT IN ('entered', 'ignored', 'won', 'lost')) AS pending, count(*) AS pending_any_status FROM g WHERE analyzed_at IS NULL AND status = 'candidate'")
def pending_count(spark, d):
    return listing.pending_count(state(spark, d))


@_add("link_check_queue", _top("id, entry_url_status, entry_checked_at", "status IN ('candidate', 'active', 'uncertain') AND (entry_url_status IS NULL OR entry_url_status IN ('unknown', 'temporary_error', 'blocked') OR entry_checked_at IS NULL)", "entry_checked_at NULLS FIRST, discovered_at, id", 50))
def link_check_queue(spark, d):
    return listing.link_check_queue(state(spark, d)).select("id", "entry_url_status", "entry_checked_at")


@_add("verdict_backfill_queue", _top("id, discovered_at", "entry_acceptable IS NULL", "discovered_at DESC, id", 500))
def verdict_backfill_queue(spark, d):
    return listing.verdict_backfill_queue(state(spark, d)).select("id", "discovered_at")


@_add("rejection_review_queue", _top("id, entry_rejection_reason", "entry_acceptable IS FALSE AND (requires_public_social_action IS TRUE OR entry_rejection_reason ILIKE '%public social%' OR entry_rejection_reason ILIKE '%social-media%')", "updated_at DESC NULLS LAST, discovered_at DESC, id", 500))
def rejection_review_queue(spark, d):
    return listing.rejection_review_queue(state(spark, d)).select("id", "entry_rejection_reason")


@_add("platform_queue", _top("id, platform_campaign_id, manual_status", f"platform = 'gleam' AND {_OPEN} AND (entry_url IS NOT NULL OR platform_campaign_id IS NOT NULL) AND (entry_url_status IS NULL OR entry_url_status <> 'gone') AND status NOT IN ('expired', 'rejected') AND entry_acceptable IS DISTINCT FROM false AND {_REGION}", "CASE manual_status WHEN 'interested' THEN 0 ELSE 1 END, coalesce(prize_priority, 0) DESC, last_seen_at DESC NULLS LAST, discovered_at DESC NULLS LAST, id", 20))
def platform_queue(spark, d):
    return listing.platform_queue(state(spark, d), "gleam", region_gate=True).select("id", "platform_campaign_id", "manual_status")


@_add("latest_by_campaign", _STATE_SQL + "SELECT platform, platform_campaign_id, id FROM (SELECT *, row_number() OVER (PARTITION BY platform, platform_campaign_id ORDER BY last_seen_at DESC NULLS LAST, id DESC) AS n FROM g WHERE platform IS NOT NULL AND platform_campaign_id IS NOT NULL) WHERE n = 1")
def latest_by_campaign(spark, d):
    return listing.latest_by(state(spark, d), "platform", "platform_campaign_id").select("platform", "platform_campaign_id", "id")


@_add("overview_stats", _STATE_SQL + f"""
SELECT count(*) FILTER ({_INBOX}) AS inbox, count(*) FILTER ({_INBOX} AND manual_status = 'interested') AS interested, count(*) FILTER ({_INBOX}) AS active,
  count(*) FILTER ({_REGION} AND {_OPEN}) AS region_eligible, count(*) FILTER (free_entry IS TRUE AND {_OPEN}) AS free_entry,
  count(*) FILTER (status = 'active' AND {_OPEN} AND end_at >= {_NOW} AND end_at <= {_NOW} + INTERVAL '24' HOUR) AS ending_24h,
  count(*) FILTER (status = 'active' AND {_OPEN} AND end_at >= {_NOW} AND end_at <= {_NOW} + INTERVAL '7' DAY) AS ending_7d,
  count(*) FILTER (discovered_at >= date_trunc('day', {_NOW}) AND {_OPEN}) AS discovered_today,
  count(*) FILTER (remind_at <= {_NOW} AND manual_status <> 'ignored') AS reminders_due,
  count(*) FILTER (manual_status = 'entered') AS entered, count(*) FILTER (manual_status = 'won') AS won, count(*) FILTER (manual_status = 'ignored') AS ignored
FROM g""")
def overview_stats(spark, d):
    return listing.overview_stats(state(spark, d), NOW)


@_add("collector_stats", _STATE_SQL + f"""
SELECT (SELECT count(*) FROM sources WHERE enabled) AS enabled_sources, (SELECT count(*) FROM g) AS total_giveaways, (SELECT count(*) FROM g WHERE status = 'active') AS active_giveaways,
  (SELECT count(*) FROM g WHERE free_entry IS TRUE) AS free_giveaways, (SELECT count(*) FROM g WHERE eligible_france IS TRUE) AS region_eligible_giveaways,
  (SELECT count(*) FROM g WHERE discovered_at >= date_trunc('day', {_EVENT_NOW})) AS giveaways_discovered_today,
  (SELECT count(*) FROM g WHERE analyzed_at >= date_trunc('day', {_EVENT_NOW}) AND coalesce(json_extract_string(analysis_json, '$._meta.model'), '') <> '') AS analyses_today,
  (SELECT CAST(coalesce(sum(pages_fetched), 0) AS BIGINT) FROM runs WHERE started_at >= date_trunc('day', {_EVENT_NOW})) AS pages_crawled_today,
  (SELECT CAST(coalesce(sum(errors_count), 0) AS BIGINT) FROM runs WHERE started_at >= {_EVENT_NOW} - INTERVAL '24' HOUR) AS errors_last_24h""")
def collector_stats(spark, d):
    return listing.collector_stats(state(spark, d), sources(spark, d), view(spark, d, "crawl_runs"), EVENT_NOW)


_PAGE = "g.id, g.title, s.name AS source_name, (remind_at IS NOT NULL AND remind_at <= {now}) AS reminder_due".format(now=_NOW)
_PAGE_COLUMNS = ("id", "title", "source_name", "reminder_due")


@_add("recent", _STATE_SQL + f"SELECT {_PAGE} FROM g LEFT JOIN sources s ON s.id = g.source_id WHERE {_INBOX} ORDER BY discovered_at DESC, g.id LIMIT 8")
def recent(spark, d):
    return listing.recent(state(spark, d), sources(spark, d), NOW).select(*_PAGE_COLUMNS)


@_add("ending_soon", _STATE_SQL + f"SELECT {_PAGE} FROM g LEFT JOIN sources s ON s.id = g.source_id WHERE end_at >= {_NOW} AND status IN ('active', 'candidate', 'uncertain') AND {_OPEN} ORDER BY end_at, g.id LIMIT 8")
def ending_soon(spark, d):
    return listing.ending_soon(state(spark, d), sources(spark, d), NOW).select(*_PAGE_COLUMNS)


_ORDERS = {
    "priority": f"{_WANTED}, prize_priority DESC NULLS LAST, discovered_at DESC, id",
    "ending_soon": "end_at NULLS LAST, id",
    "remind_at": "remind_at NULLS LAST, id",
    "highest_value": "prize_value_eur DESC NULLS LAST, discovered_at DESC, id",
    "highest_confidence": "confidence DESC NULLS LAST, discovered_at DESC, id",
    "newest": "discovered_at DESC, id",
}
_KEPT = "entry_acceptable IS DISTINCT FROM false AND (entry_url_status IS NULL OR entry_url_status <> 'gone')"
_PAGES: dict[str, tuple[Filters, str]] = {
    "list_inbox": (Filters(region=True, wanted_only=True), f"{_OPEN} AND {_REGION} AND wanted_prize IS TRUE AND {_KEPT}"),
    "list_interested": (Filters(view="interested", sort="ending_soon", ending_soon=True, entry_method="web_form"), f"manual_status = 'interested' AND entry_method = 'web_form' AND {_KEPT} AND end_at >= {_NOW} AND end_at <= {_NOW} + INTERVAL '7' DAY"),
    "list_entered": (Filters(view="entered", sort="highest_value", min_value=1000.0, offset=10), f"manual_status = 'entered' AND {_KEPT} AND prize_value_eur >= 1000"),
    "list_ignored": (Filters(view="ignored", sort="newest", show_unwanted=True, acceptable_only=False), "manual_status = 'ignored' AND wanted_prize IS FALSE AND (entry_url_status IS NULL OR entry_url_status <> 'gone')"),
    "list_history": (Filters(view="history", sort="highest_confidence", hide_gone=False, acceptable_only=False, limit=500), "(manual_status IN ('entered', 'ignored', 'won', 'lost') OR status = 'expired')"),
    "list_search": (Filters(view="all", status="active", search=" PLAY ", free=True, show_unknown_region=True, sort="remind_at"), f"status = 'active' AND {_KEPT} AND free_entry IS TRUE AND (france_eligibility = 'unknown' OR (france_eligibility IS NULL AND eligible_france IS NULL)) AND (title ILIKE '%PLAY%' OR prize ILIKE '%PLAY%' OR domain ILIKE '%PLAY%' OR canonical_url ILIKE '%PLAY%')"),
    "list_rejections": (Filters(view="all", acceptable_only=False, public_social_required=True, rejection_reason="REQUIRES public%", prize_category="cash", show_ineligible=True, has_reminder=True, reminders_due=True), f"requires_public_social_action IS TRUE AND entry_rejection_reason ILIKE 'REQUIRES public%' AND prize_category = 'cash' AND (france_eligibility = 'ineligible' OR eligible_france IS FALSE) AND remind_at <= {_NOW} AND (entry_url_status IS NULL OR entry_url_status <> 'gone')"),
}


def _page(filters: Filters) -> Query:
    return lambda spark, d: listing.list_giveaways(state(spark, d), sources(spark, d), NOW, filters).select(*_PAGE_COLUMNS, "total")


for _name, (_filters, _where) in _PAGES.items():
    _QUERIES[_name] = _page(_filters)
    _SQL[_name] = _STATE_SQL + (
        f", hit AS (SELECT * FROM g WHERE {_where}), p AS (SELECT * FROM hit ORDER BY {_ORDERS[_filters.sort]} LIMIT {min(_filters.limit, 200)} OFFSET {_filters.offset})\n"
        f"SELECT p.id, p.title, s.name AS source_name, (remind_at IS NOT NULL AND remind_at <= {_NOW}) AS reminder_due, (SELECT count(*) FROM hit) AS total FROM p LEFT JOIN sources s ON s.id = p.source_id"
    )


@_add("list_runs", _STATE_SQL + ", r AS (SELECT * FROM runs ORDER BY started_at DESC, id LIMIT 50) SELECT r.id, s.name AS source_name, r.started_at, CAST(date_diff('second', started_at, finished_at) AS BIGINT) AS duration_seconds FROM r LEFT JOIN sources s ON s.id = r.source_id")
def list_runs(spark, d):
    return listing.list_runs(view(spark, d, "crawl_runs"), sources(spark, d)).select("id", "source_name", "started_at", "duration_seconds")


@_add("entry_methods", _STATE_SQL + "SELECT DISTINCT entry_method FROM g WHERE entry_method <> ''")
def entry_methods(spark, d):
    return listing.entry_methods(state(spark, d))


@_add("status_counts", _STATE_SQL + f"SELECT count(*) FILTER (remind_at <= {_NOW} AND manual_status <> 'ignored') AS reminders_due, count(*) FILTER (manual_status = 'ignored') AS ignored FROM g")
def status_counts(spark, d):
    return listing.status_counts(state(spark, d), NOW)


@_add("source_summary", _STATE_SQL + f"""
SELECT source_id, count(*) AS candidates, count(*) FILTER ({_REGION}) AS eligible,
  count(*) FILTER (NOT {_REGION} AND (coalesce(france_eligibility = 'ineligible', false) OR eligible_france IS FALSE)) AS ineligible,
  count(*) FILTER (wanted_prize IS TRUE) AS wanted, count(*) FILTER (wanted_prize IS FALSE) AS unwanted, count(*) FILTER (requires_public_social_action IS TRUE) AS public_required,
  count(*) FILTER (entry_url_status = 'gone') AS dead,
  count(*) - count(DISTINCT CASE WHEN platform IS NOT NULL AND platform_campaign_id IS NOT NULL THEN 'p:' || platform || ':' || platform_campaign_id ELSE 'u:' || canonical_url END) AS duplicates,
  count(*) FILTER (confidence >= 0.45 AND status NOT IN ('rejected', 'expired') AND wanted_prize IS DISTINCT FROM false AND france_eligibility IS DISTINCT FROM 'ineligible') AS would_keep
FROM g GROUP BY source_id""")
def source_summary(spark, d):
    return listing.source_summary(state(spark, d))


@_add("pipeline_summary", _STATE_SQL + "SELECT status AS outcome, count(*) AS n FROM g GROUP BY status")
def pipeline_summary(spark, d):
    return listing.pipeline_summary(state(spark, d))


@_add("display_flags", _STATE_SQL + f"""
SELECT id, CASE WHEN requires_public_social_action THEN 'public_required' WHEN requires_public_social_action IS FALSE THEN 'private' ELSE 'unknown' END AS entry_badge,
  coalesce(end_at >= {_NOW} AND end_at <= {_NOW} + INTERVAL '7' DAY, false) AS ends_within_week, coalesce(remind_at <= {_NOW} AND manual_status <> 'ignored', false) AS reminder_due,
  CAST(floor(date_diff('second', {_NOW}, end_at) / 3600.0) AS BIGINT) AS hours_left FROM g""")
def display_flags(spark, d):
    return listing.display_flags(state(spark, d), NOW)


_CHECKS = with_views("link_checks") + """, c AS (SELECT *, CASE WHEN http_status IS NULL OR http_status = 429 OR http_status BETWEEN 500 AND 599 THEN 'temporary_error' WHEN http_status BETWEEN 200 AND 399 THEN 'live'
    WHEN http_status IN (404, 410) THEN 'gone' WHEN http_status IN (401, 403) THEN 'blocked' ELSE 'unknown' END AS o FROM link_checks),
  s AS (SELECT *, count(*) FILTER (o = 'live') OVER (PARTITION BY giveaway_id ORDER BY checked_at DESC, check_id DESC ROWS UNBOUNDED PRECEDING) AS later_live,
    row_number() OVER (PARTITION BY giveaway_id ORDER BY checked_at DESC, check_id DESC) AS n FROM c)
"""


@_add("link_check_fold", _CHECKS + "SELECT giveaway_id, count(*) FILTER (later_live = 0 AND o IN ('temporary_error', 'gone')) AS entry_check_fail_count, max(CASE WHEN n = 1 THEN o END) AS entry_url_status, max(CASE WHEN n = 1 THEN checked_at END) AS entry_checked_at, bool_or(o = 'gone') AS rejected FROM s GROUP BY giveaway_id")
def link_check_fold(spark, d):
    return merge.fold_link_checks(view(spark, d, "link_checks"))


@_add("validate_links", _CHECKS + "SELECT max_o AS outcome, count(*) AS n FROM (SELECT giveaway_id, max(CASE WHEN n = 1 THEN o END) AS max_o FROM s GROUP BY giveaway_id) GROUP BY max_o")
def validate_links(spark, d):
    return listing.pipeline_summary(merge.fold_link_checks(view(spark, d, "link_checks")), "entry_url_status")


@_add("backoff_schedule", with_views("sources", "crawl_runs") + """
, r AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS later_ok FROM crawl_runs),
f AS (SELECT source_id, count(*) FILTER (failed AND later_ok = 0) AS n, max(started_at) AS at FROM r GROUP BY source_id)
SELECT s.id, s.enabled, coalesce(f.n, 0) AS consecutive_failures,
  CASE WHEN f.at IS NULL THEN s.next_crawl_at WHEN f.n > 0 THEN f.at + to_minutes(CAST(least(15 * power(2, f.n - 1), 360) AS BIGINT)) ELSE f.at + to_minutes(CAST(s.crawl_interval_minutes AS BIGINT)) END AS next_crawl_at
FROM sources s LEFT JOIN f ON f.source_id = s.id""")
def backoff_schedule(spark, d):
    return merge.fold_crawl_runs(sources(spark, d), view(spark, d, "crawl_runs")).select("id", "enabled", "consecutive_failures", "next_crawl_at")


@_add("run_status", with_views("crawl_runs") + "SELECT id, CASE WHEN errors_count > 0 AND pages_fetched = 0 AND candidates_found = 0 THEN 'failed' WHEN errors_count > 0 AND candidates_found > 0 THEN 'partial' ELSE 'success' END AS status FROM crawl_runs")
def run_status(spark, d):
    return merge.run_status(view(spark, d, "crawl_runs")).select("id", "status")


@_add("reset_schedule", with_views("sources") + f"SELECT id, CASE WHEN enabled THEN {_NOW} ELSE next_crawl_at END AS next_crawl_at FROM sources")
def reset_schedule(spark, d):
    return merge.reset_schedule(sources(spark, d), NOW).select("id", "next_crawl_at")


_LAST = ", l AS (SELECT giveaway_id, {value} AS v, changed_at, row_number() OVER (PARTITION BY giveaway_id ORDER BY changed_at DESC, change_id DESC) AS n FROM changes WHERE {valid})\n"


@_add("manual_status", with_views("giveaways", "changes") + _LAST.format(value="manual_status", valid="manual_status IN ('none', 'interested', 'entered', 'ignored', 'won', 'lost')") + "SELECT g.id, coalesce(l.v, g.manual_status) AS manual_status, l.changed_at AS manual_status_at FROM giveaways g LEFT JOIN l ON l.giveaway_id = g.id AND l.n = 1")
def manual_status(spark, d):
    return merge.set_manual_status(state(spark, d), view(spark, d, "changes")).select("id", "manual_status", "manual_status_at")


@_add("apply_reminders", with_views("giveaways", "changes") + _LAST.format(value="CAST(floor(hours) AS INT)", valid="hours IS NULL OR (floor(hours) BETWEEN 1 AND 720)") + "SELECT g.id, CASE WHEN l.giveaway_id IS NULL THEN g.remind_at WHEN l.v IS NULL THEN NULL ELSE l.changed_at + to_hours(CAST(l.v AS BIGINT)) END AS remind_at FROM giveaways g LEFT JOIN l ON l.giveaway_id = g.id AND l.n = 1")
def apply_reminders(spark, d):
    return merge.apply_reminders(state(spark, d), view(spark, d, "changes")).select("id", "remind_at")


@_add("source_settings", with_views("sources", "changes") + ", l AS (SELECT giveaway_id % 20 AS id, CAST(floor(interval_minutes) AS INT) AS m, row_number() OVER (PARTITION BY giveaway_id % 20 ORDER BY changed_at DESC, change_id DESC) AS n FROM changes WHERE interval_minutes >= 5) SELECT s.id, coalesce(l.m, s.crawl_interval_minutes) AS crawl_interval_minutes FROM sources s LEFT JOIN l ON l.id = s.id AND l.n = 1")
def source_settings(spark, d):
    changes = view(spark, d, "changes").withColumn("id", F.col("giveaway_id") % 20)
    return merge.source_settings(sources(spark, d), changes).select("id", "crawl_interval_minutes")


@_add("merge_provenance", with_views("giveaways", "crawl_batch") + """
, a AS (SELECT id AS giveaway_id, source_id, discovered_at AS first_seen_at, last_seen_at, canonical_url AS url FROM giveaways WHERE source_id IS NOT NULL
  UNION ALL SELECT ordinal, source_id, seen_at, seen_at, entry_url FROM crawl_batch)
SELECT giveaway_id, source_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, (array_agg(url ORDER BY last_seen_at DESC, url DESC) FILTER (url IS NOT NULL))[1] AS url FROM a GROUP BY giveaway_id, source_id""")
def merge_provenance(spark, d):
    old = state(spark, d).where("source_id IS NOT NULL").selectExpr("id AS giveaway_id", "source_id", "discovered_at AS first_seen_at", "last_seen_at", "canonical_url AS url")
    return merge.merge_provenance(old, view(spark, d, "crawl_batch").selectExpr("ordinal AS giveaway_id", "source_id", "seen_at", "entry_url AS url"))


@_add("provenance_of", _STATE_SQL + "SELECT g.id AS giveaway_id, g.source_id, s.name AS source_name, g.discovered_at AS first_seen_at FROM g LEFT JOIN sources s ON s.id = g.source_id WHERE g.source_id IS NOT NULL")
def provenance_of(spark, d):
    p = state(spark, d).where("source_id IS NOT NULL").selectExpr("id AS giveaway_id", "source_id", "discovered_at AS first_seen_at")
    return listing.provenance_of(p, sources(spark, d)).select("giveaway_id", "source_id", "source_name", "first_seen_at")


@_add("reconcile_batch", with_views("giveaways", "analysis_responses") + """
, r AS (SELECT giveaway_id, count(*) AS n FROM analysis_responses GROUP BY giveaway_id)
SELECT coalesce(g.id, r.giveaway_id) AS giveaway_id, CASE WHEN g.id IS NULL THEN 'unknown' WHEN r.n IS NULL THEN 'missing' WHEN r.n > 1 THEN 'duplicate' ELSE 'clean' END AS outcome, coalesce(r.n, 0) AS responses
FROM giveaways g FULL JOIN r ON r.giveaway_id = g.id""")
def reconcile_batch(spark, d):
    return merge.reconcile_batch(state(spark, d), view(spark, d, "analysis_responses"))


_RESOLVED = _STATE_SQL + f", crawl_batch AS ({view_sql('crawl_batch')})" + """
, pk AS (SELECT platform, platform_campaign_id, id FROM (SELECT *, row_number() OVER (PARTITION BY platform, platform_campaign_id ORDER BY last_seen_at DESC NULLS LAST, id DESC) AS n FROM g WHERE platform IS NOT NULL AND platform_campaign_id IS NOT NULL) WHERE n = 1)
, ek AS (SELECT entry_url, id FROM (SELECT *, row_number() OVER (PARTITION BY entry_url ORDER BY analyzed_at DESC NULLS LAST, last_seen_at DESC NULLS LAST, id DESC) AS n FROM g WHERE entry_url LIKE 'https://gleam.io/%') WHERE n = 1)
, r0 AS (SELECT b.*, coalesce(u.id, pk.id, ek.id) AS known, CASE WHEN u.id IS NOT NULL THEN 'url' WHEN pk.id IS NOT NULL THEN 'platform' WHEN ek.id IS NOT NULL THEN 'entry' END AS how,
    'n:' || b.canonical_url AS own, CASE WHEN b.platform IS NOT NULL AND b.platform_campaign_id IS NOT NULL THEN b.platform || ':' || b.platform_campaign_id END AS pkey, CASE WHEN b.entry_url LIKE 'https://gleam.io/%' THEN b.entry_url END AS ekey
  FROM crawl_batch b LEFT JOIN g u ON u.canonical_url = b.canonical_url LEFT JOIN pk ON pk.platform = b.platform AND pk.platform_campaign_id = b.platform_campaign_id LEFT JOIN ek ON ek.entry_url = b.entry_url)
, r1 AS (SELECT *, CASE WHEN known IS NOT NULL THEN CAST(known AS VARCHAR) WHEN pkey IS NULL THEN own ELSE first_value(coalesce(CAST(known AS VARCHAR), own)) OVER (PARTITION BY pkey ORDER BY seen_at, ordinal) END AS id1 FROM r0)
, r2 AS (SELECT *, CASE WHEN known IS NOT NULL OR id1 <> own OR ekey IS NULL THEN id1 ELSE first_value(id1) OVER (PARTITION BY ekey ORDER BY seen_at, ordinal) END AS id2 FROM r1)
, r3 AS (SELECT *, id2 AS id3 FROM r2)
, resolved AS (SELECT *, CASE WHEN how IS NOT NULL THEN how WHEN id3 = own THEN 'new' ELSE 'batch' END AS matched_by,
    CASE WHEN id3 LIKE 'n:%' THEN NULL ELSE CAST(id3 AS BIGINT) END AS giveaway_id FROM r3)
"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return merge.resolve_identity(view(spark, d, "crawl_batch"), state(spark, d))


@_add("resolve_identity", _RESOLVED + "SELECT ordinal, coalesce(CAST(giveaway_id AS VARCHAR), 'first ' || CAST(min(ordinal) OVER (PARTITION BY id3) AS VARCHAR)) AS identity, matched_by FROM resolved")
def resolve_identity(spark, d):
    # A new offer's id is a hash: it is shown by the first of its rows.
    rows = resolved(spark, d)
    new = rows.where("matched_by = 'new'").select("giveaway_id").distinct()
    first = rows.join(new, "giveaway_id", "left_semi").groupBy("giveaway_id").agg(F.min("ordinal").alias("first"))
    identity = F.coalesce(F.concat(F.lit("first "), F.col("first").cast("string")), F.col("giveaway_id").cast("string"))
    return rows.join(first, "giveaway_id", "left").select("ordinal", identity.alias("identity"), "matched_by")


@_add("upsert_outcome", _RESOLVED + "SELECT r.source_id, count(DISTINCT CASE WHEN matched_by = 'new' THEN id3 END) AS created, count(*) FILTER (matched_by <> 'new') AS updated, count(*) FILTER (matched_by <> 'new' AND g.content_hash IS DISTINCT FROM r.content_hash) AS hash_changed, count(*) FILTER (matched_by = 'new' OR g.analyzed_at IS NULL) AS needs_analysis FROM resolved r LEFT JOIN g ON g.id = r.giveaway_id GROUP BY r.source_id")
def upsert_outcome(spark, d):
    return merge.upsert_outcome(resolved(spark, d), state(spark, d))


# The twin merges one sighting after the other, each over what the one before it left.
_KEPT_VALUE = lambda c: f"CASE WHEN v.analyzed_at IS NOT NULL THEN coalesce(v.{c}, s.{c}) ELSE coalesce(s.{c}, v.{c}) END AS {c}"
_FROZEN_VALUE = lambda c: f"CASE WHEN v.analyzed_at IS NOT NULL THEN v.{c} ELSE coalesce(s.{c}, v.{c}) END AS {c}"
_KEPT_COLUMNS, _FROZEN_COLUMNS = ("prize", "prize_category", "prize_priority", "free_entry", "entry_method"), ("wanted_prize", "eligible_france", "entry_acceptable")


@_add("merge_crawl", _RESOLVED.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, s AS (SELECT *, row_number() OVER (PARTITION BY id3 ORDER BY seen_at, ordinal) AS nth FROM resolved)
, v AS (
  SELECT s.id3, CAST(0 AS BIGINT) AS nth, false AS fresh, g.canonical_url, g.last_seen_at, g.discovered_at, g.content_hash, g.title, g.entry_url, g.end_at, g.source_id, g.platform, g.platform_campaign_id, {', '.join('g.' + c for c in _KEPT_COLUMNS + _FROZEN_COLUMNS)}, g.status, g.manual_status, g.analyzed_at
  FROM s JOIN g ON g.id = s.giveaway_id WHERE s.nth = 1
  UNION ALL
  SELECT s.id3, s.nth, true, s.canonical_url, s.seen_at, s.seen_at, s.content_hash, s.title, s.entry_url, s.end_at, s.source_id, s.platform, s.platform_campaign_id, {', '.join('s.' + c for c in _KEPT_COLUMNS + _FROZEN_COLUMNS)}, s.status, 'none', NULL
  FROM s WHERE s.nth = 1 AND s.giveaway_id IS NULL
  UNION ALL
  SELECT s.id3, s.nth, v.fresh, v.canonical_url, s.seen_at, v.discovered_at, s.content_hash, CASE WHEN v.title IS NULL OR v.content_hash IS DISTINCT FROM s.content_hash THEN coalesce(s.title, v.title) ELSE v.title END, coalesce(s.entry_url, v.entry_url), coalesce(s.end_at, v.end_at),
    coalesce(v.source_id, s.source_id), coalesce(v.platform, s.platform), coalesce(v.platform_campaign_id, s.platform_campaign_id), {', '.join(map(_KEPT_VALUE, _KEPT_COLUMNS))}, {', '.join(map(_FROZEN_VALUE, _FROZEN_COLUMNS))},
    CASE WHEN v.analyzed_at IS NULL AND s.status IN ('rejected', 'expired') THEN s.status ELSE v.status END, v.manual_status, v.analyzed_at
  FROM v JOIN s ON s.id3 = v.id3 AND s.nth = v.nth + 1)
, done AS (SELECT * EXCLUDE (id3, nth, last) FROM (SELECT *, max(nth) OVER (PARTITION BY id3) AS last FROM v) WHERE nth = last)
SELECT * FROM done
UNION ALL BY NAME
SELECT false AS fresh, canonical_url, last_seen_at, discovered_at, content_hash, title, entry_url, end_at, source_id, platform, platform_campaign_id, {', '.join(_KEPT_COLUMNS + _FROZEN_COLUMNS)}, status, coalesce(manual_status, 'none') AS manual_status, analyzed_at
FROM g WHERE id NOT IN (SELECT giveaway_id FROM resolved WHERE giveaway_id IS NOT NULL)""")
def merge_crawl(spark, d):
    known = state(spark, d)
    out = merge.merge_crawl(known, resolved(spark, d)).join(known.select("id", F.lit(False).alias("fresh")), "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(True)))
    return out.select("fresh", "canonical_url", "last_seen_at", "discovered_at", "content_hash", "title", "entry_url", "end_at", "source_id", "platform", "platform_campaign_id", "prize", "prize_category", "prize_priority", "free_entry", "entry_method", "wanted_prize", "eligible_france", "entry_acceptable", "status", "manual_status", "analyzed_at")


_DECIDED = f"CASE WHEN is_giveaway IS NOT TRUE THEN 'rejected' WHEN coalesce(france_eligibility = 'ineligible', false) OR wanted_prize IS FALSE OR entry_acceptable IS FALSE THEN 'rejected' WHEN end_date < {_NOW} THEN 'expired' WHEN coalesce(confidence, 0) < 0.5 OR france_eligibility IS DISTINCT FROM 'eligible' OR entry_acceptable IS NULL THEN 'uncertain' ELSE 'active' END"


@_add("decide_status", with_views("analysis_responses") + f"SELECT ordinal, giveaway_id, {_DECIDED} AS status FROM analysis_responses")
def decide_status(spark, d):
    return merge.decide_status(view(spark, d, "analysis_responses"), NOW).select("ordinal", "giveaway_id", "status")


@_add("apply_analysis", _STATE_SQL + f", analysis_responses AS ({view_sql('analysis_responses')})" + f"""
, a AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY giveaway_id) AS n FROM analysis_responses) WHERE n = 1)
, j AS (SELECT g.*, a.giveaway_id IS NOT NULL AS hit, a.is_giveaway, a.france_eligibility AS fe, coalesce(a.wanted_prize, g.wanted_prize) AS w, coalesce(a.end_date, g.end_at) AS e, coalesce(a.confidence, g.confidence) AS cf, a.entry_acceptable AS ok FROM g LEFT JOIN a ON a.giveaway_id = g.id)
, m AS (SELECT *, coalesce(fe, france_eligibility) AS f, CASE WHEN entry_acceptable IS FALSE THEN false WHEN ok IS NOT NULL THEN ok ELSE entry_acceptable END AS acc, CASE WHEN entry_acceptable IS FALSE OR ok IS NULL THEN requires_public_social_action ELSE NOT ok END AS pub FROM j)
SELECT id, CASE WHEN hit THEN f ELSE france_eligibility END AS france_eligibility, CASE WHEN hit AND fe IS NOT NULL THEN CASE fe WHEN 'eligible' THEN true WHEN 'ineligible' THEN false END ELSE eligible_france END AS eligible_france,
  CASE WHEN hit THEN w ELSE wanted_prize END AS wanted_prize, CASE WHEN hit THEN acc ELSE entry_acceptable END AS entry_acceptable, CASE WHEN hit THEN pub ELSE requires_public_social_action END AS requires_public_social_action,
  CASE WHEN hit THEN e ELSE end_at END AS end_at, CASE WHEN hit THEN cf ELSE confidence END AS confidence, CASE WHEN hit THEN {_NOW} ELSE analyzed_at END AS analyzed_at,
  CASE WHEN NOT hit THEN status WHEN is_giveaway IS NOT TRUE OR coalesce(entry_url_status = 'gone', false) OR coalesce(f = 'ineligible', false) OR w IS FALSE OR acc IS FALSE OR pub IS TRUE THEN 'rejected' WHEN e < {_NOW} THEN 'expired'
    WHEN coalesce(cf, 0) < 0.5 OR f IS DISTINCT FROM 'eligible' OR acc IS NULL THEN 'uncertain' ELSE 'active' END AS status FROM m""")
def apply_analysis(spark, d):
    out = merge.apply_analysis(state(spark, d), view(spark, d, "analysis_responses"), NOW)
    return out.select("id", "france_eligibility", "eligible_france", "wanted_prize", "entry_acceptable", "requires_public_social_action", "end_at", "confidence", "analyzed_at", "status")


@_add("mark_completed", _STATE_SQL + """
, k AS (SELECT DISTINCT 'k' || CAST(o_orderkey % 6000 AS VARCHAR) AS key FROM orders WHERE o_custkey % 5 = 0)
, l AS (SELECT lower(platform_campaign_id) AS key, id FROM (SELECT *, row_number() OVER (PARTITION BY lower(platform_campaign_id) ORDER BY last_seen_at DESC NULLS LAST, id DESC) AS n FROM g WHERE platform = 'gleam' AND platform_campaign_id IS NOT NULL) WHERE n = 1)
SELECT k.key, l.id, CASE WHEN l.id IS NOT NULL THEN 'entered' END AS manual_status FROM k LEFT JOIN l ON l.key = k.key""")
def mark_completed(spark, d):
    keys = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey % 5 = 0").selectExpr("concat('K', CAST(o_orderkey % 6000 AS STRING)) AS key")
    return merge.mark_completed(state(spark, d), keys, "gleam")


@_add("purge_plan", _STATE_SQL + "SELECT (SELECT count(*) FROM g) AS giveaways, (SELECT count(*) FROM runs) AS crawl_runs")
def purge_plan(spark, d):
    return merge.purge_plan(state(spark, d), view(spark, d, "crawl_runs"))


@_add("backfill_defaults", _STATE_SQL + "SELECT id, coalesce(france_eligibility, CASE WHEN eligible_france THEN 'eligible' WHEN eligible_france IS FALSE THEN 'ineligible' ELSE 'unknown' END) AS france_eligibility, CASE WHEN manual_status <> 'none' THEN updated_at END AS manual_status_at FROM g")
def backfill_defaults(spark, d):
    return merge.backfill_defaults(state(spark, d)).select("id", "france_eligibility", "manual_status_at")


_RULES = {
    "priority_range": "prize_priority BETWEEN 0 AND 90",
    "confidence_range": "confidence BETWEEN 0.05 AND 1",
    "known_status": "status IN ('candidate', 'active', 'expired', 'rejected')",
    "value_not_negative": "prize_value_eur >= 0",
}


@_add("validate_constraints", _STATE_SQL + "SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({e}) IS FALSE THEN '{n}' END" for n, e in _RULES.items()) + "], lambda x: x IS NOT NULL), ',') AS failed_rules FROM g")
def validate_constraints(spark, d):
    named: dict[str, Column] = {n: F.expr(e) for n, e in _RULES.items()}
    return merge.validate(state(spark, d), named).select("id", F.array_join("failed_rules", ",").alias("failed_rules"))


# Rows of the state with what breaks each rule written over some of them.
_BROKEN = {
    "canonical_url": "CASE WHEN id % 101 = 0 THEN NULL ELSE canonical_url END", "content_hash": "CASE WHEN id % 103 = 0 THEN NULL ELSE content_hash END", "status": "CASE WHEN id % 97 = 0 THEN 'odd' WHEN id % 107 = 0 THEN NULL ELSE status END",
    "manual_status": "CASE WHEN id % 89 = 0 THEN 'odd' WHEN id % 109 = 0 THEN NULL ELSE manual_status END", "confidence": "CASE WHEN id % 83 = 0 THEN 1.5 ELSE confidence END", "prize_priority": "CASE WHEN id % 79 = 0 THEN 101 ELSE prize_priority END",
    "entry_url_status": "CASE WHEN id % 73 = 0 THEN 'odd' ELSE entry_url_status END", "france_eligibility": "CASE WHEN id % 71 = 0 THEN 'odd' ELSE france_eligibility END", "prize_category": "CASE WHEN id % 67 = 0 THEN 'odd' WHEN id % 61 = 0 THEN NULL ELSE 'cash' END",
    "entry_friction": "CASE WHEN id % 59 = 0 THEN 'odd' WHEN id % 2 = 0 THEN 'easy' END",
}
_WROTE = ", ".join(f"{e} AS {c}" for c, e in _BROKEN.items())


@_add("quarantined_giveaways", _STATE_SQL + f", b AS (SELECT id, {_WROTE} FROM g), f AS (SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({e}) IS FALSE THEN '{n}' END" for n, e in rules.GIVEAWAYS.items()) + "], lambda x: x IS NOT NULL), ',') AS failed_rules FROM b) SELECT * FROM f WHERE failed_rules <> ''")
def quarantined_giveaways(spark, d):
    bad = rules.split(state(spark, d).selectExpr("id", *[f"{e} AS {c}" for c, e in _BROKEN.items()]), rules.GIVEAWAYS)[1]
    return bad.select("id", F.array_join("failed_rules", ",").alias("failed_rules"))


@_add("seed_sources", with_views("sources") + f"""
, c AS (SELECT 'https://s' || CAST(s_suppkey AS VARCHAR) || '.example.net/' AS base_url, 'seed ' || s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN false END AS enabled, CASE WHEN s_suppkey % 3 = 0 THEN 15 END AS every FROM supplier WHERE s_suppkey BETWEEN 10 AND 40)
SELECT s.id, coalesce(c.name, s.name) AS name, coalesce(s.base_url, c.base_url) AS base_url, coalesce(c.enabled, s.enabled, true) AS enabled, CAST(coalesce(c.every, s.crawl_interval_minutes, 60) AS INT) AS crawl_interval_minutes,
  CASE WHEN s.base_url IS NULL THEN {_NOW} ELSE s.next_crawl_at END AS next_crawl_at FROM sources s FULL JOIN c ON c.base_url = s.base_url""")
def seed_sources(spark, d):
    catalogue = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey BETWEEN 10 AND 40")
    catalogue = catalogue.selectExpr("concat('https://s', CAST(s_suppkey AS STRING), '.example.net/') AS base_url", "concat('seed ', s_name) AS name", "CASE WHEN s_suppkey % 2 = 0 THEN false END AS enabled", "CAST(CASE WHEN s_suppkey % 3 = 0 THEN 15 END AS INT) AS crawl_interval_minutes")
    return merge.seed_sources(sources(spark, d), catalogue, NOW)


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(values: list[str]) -> str:
    return "(" + ", ".join(map(_quoted, values)) + ")"


_WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_HOST = r"nullif(lower(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]*)', 1)), '')"
_PORT = f"regexp_extract(regexp_extract(trim(url), '{_WHOLE}', 2), ':(\\d+)$', 1)"


@_add("canonical_url", f"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(trim(url), '{_WHOLE}', 1)) AS scheme, regexp_extract(regexp_extract(trim(url), '{_WHOLE}', 2), '^(.*@)', 1) AS auth, {_HOST.format(u='url')} AS host, {_PORT} AS port, regexp_extract(trim(url), '{_WHOLE}', 3) AS path,
    list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '') AS items FROM pages),
kv AS (SELECT *, list_transform(items, lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', '%20')), 'v': url_decode(replace(CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END, '+', '%20'))}}) AS pairs FROM u),
kept AS (SELECT *, list_filter(pairs, lambda p: lower(p.k) NOT IN {_words(urls.TRACKING)} AND NOT regexp_matches(lower(p.k), '^(utm_|mtm_|pk_)')) AS left_over FROM kv),
q AS (SELECT *, list_sort(list_transform(left_over, lambda p, i: {{'l': lower(p.k), 'v': p.v, 'i': i, 'k': p.k}})) AS ordered FROM kept),
e AS (SELECT *, array_to_string(list_transform(ordered, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') AS query FROM q)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || auth || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical FROM e""")
def canonical_url(spark, d):
    return pages(spark, d).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@_add("url_domain", f"SELECT page_id, {_HOST.format(u='url')} AS domain FROM pages")
def url_domain(spark, d):
    return pages(spark, d).select("page_id", urls.url_domain(F.col("url")).alias("domain"))


def _plain_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', {_quoted(mark)})"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n]+', ' ', 'g'))"


_LINKS_SQL = f"""
WITH raw AS (SELECT page_id, url, regexp_extract_all(html, {_quoted(page.ANCHOR)}, 1) AS h, regexp_extract_all(html, {_quoted(page.ANCHOR)}, 2) AS t FROM pages),
x AS (SELECT page_id, url, unnest(h) AS h, unnest(t) AS t, generate_subscripts(h, 1) - 1 AS pos FROM raw),
links AS (SELECT page_id, CAST(pos AS INT) AS pos, {_plain_sql('t')} AS anchor_text, h,
  CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z]+:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h
    ELSE rtrim(regexp_extract(url, '^([A-Za-z]+://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || h END AS href FROM x)
"""


@_add("page_links", _LINKS_SQL + "SELECT page_id, pos, href, anchor_text FROM links")
def page_links(spark, d):
    return page.page_links(pages(spark, d))


@_add("link_hints", _LINKS_SQL + "SELECT page_id, count(*) AS hints, string_agg(left(CASE WHEN anchor_text = '' THEN h ELSE anchor_text END, 120), '|' ORDER BY pos) AS joined FROM links WHERE pos < 40 GROUP BY page_id")
def link_hints(spark, d):
    hints = page.link_hints(F.col("html"))
    return pages(spark, d).select("page_id", hints.alias("h")).where(F.size("h") > 0).select("page_id", F.size("h").cast("long").alias("hints"), F.array_join("h", "|").alias("joined"))


_FOLLOW_SQL = f"""coalesce(regexp_matches(trim(href), '(?i)^https?://') AND NOT regexp_matches(lower(regexp_extract(trim(href), '{_WHOLE}', 3)), '\\.({'|'.join(urls.ASSETS)})$')
  AND NOT regexp_matches(host, '(^|\\.)({'|'.join(h.replace('.', '[.]') for h in urls.CLOSED_HOSTS)})$') AND (host = home OR ends_with(host, '.' || home)), false)"""


@_add("followable_links", _LINKS_SQL + f", b AS (SELECT l.*, {_HOST.format(u='l.href')} AS host, {_HOST.format(u='p.url')} AS home FROM links l JOIN pages p USING (page_id)) SELECT page_id, pos, {_FOLLOW_SQL} AS follow FROM b")
def followable_links(spark, d):
    home = pages(spark, d).select("page_id", F.array(urls.url_domain(F.col("url"))).alias("home"))
    return page.page_links(pages(spark, d)).join(home, "page_id").select("page_id", "pos", urls.followable(F.col("href"), F.col("home")).alias("follow"))


@_add("content_hash", "SELECT page_id, sha256(coalesce(url, '') || chr(10) || coalesce(html, '')) AS hash FROM pages")
def content_hash(spark, d):
    return pages(spark, d).select("page_id", page.content_hash(F.col("url"), F.col("html")).alias("hash"))


def _extract_sql(pattern: str) -> str:
    return _plain_sql(f"regexp_extract(html, {_quoted(pattern)}, 1)")


@_add("page_title", f"SELECT page_id, coalesce(nullif({_extract_sql(page.TITLE)}, ''), nullif({_extract_sql(page.OG_TITLE)}, '')) AS title FROM pages")
def page_title(spark, d):
    return pages(spark, d).select("page_id", page.page_title(F.col("html")).alias("title"))


@_add("decode_redirect", with_views("shaped_pages") + "SELECT page_id, CASE WHEN starts_with(t, 'http') THEN t END AS target FROM (SELECT page_id, replace(replace(replace(replace(url_decode(regexp_extract(html, '[?&]to=([^&#\"]*)', 1)), '!!2', 'i'), '!!3', 'e'), '!!4', 'r'), '!!5', 'a') AS t FROM shaped_pages)")
def decode_redirect(spark, d):
    link = F.regexp_extract("html", '([?&]to=[^"]*)"', 1)
    return view(spark, d, "shaped_pages").select("page_id", urls.decode_redirect(link).alias("target"))


@_add("platform_identity", with_views("shaped_pages") + f"""
, p AS (SELECT page_id, regexp_replace({_HOST.format(u='url')}, '^www\\.', '') AS host, regexp_extract(trim(url), '{_WHOLE}', 3) AS path FROM shaped_pages)
, k AS (SELECT page_id, path, host = 'gleam.io' OR ends_with(host, '.gleam.io') AS first, regexp_extract(path, '^/giveaways/([A-Za-z0-9]{{4,12}})/?$', 1) AS dir, regexp_extract(path, '^/([A-Za-z0-9]{{4,12}})(?:/[A-Za-z0-9._-]+)?/?$', 1) AS key, nullif(regexp_extract(path, '^/[A-Za-z0-9]{{4,12}}/([A-Za-z0-9._-]+)/?$', 1), '') AS slug,
    regexp_extract(path, '(?i)^/(?:giveaways|c)/(\\d+)(?:-[A-Za-z0-9]+)?/?$', 1) AS num, nullif(regexp_extract(path, '(?i)^/(?:giveaways|c)/\\d+-([A-Za-z0-9]+)/?$', 1), '') AS tail FROM p)
, w AS (SELECT *, CASE WHEN first AND dir <> '' AND lower(dir) NOT IN {_words(urls.RESERVED)} THEN 'dir' WHEN first AND (dir <> '' OR regexp_matches(path, '^/giveaways/?$')) THEN NULL WHEN first AND key <> '' AND lower(key) NOT IN {_words(urls.RESERVED)} THEN 'key' WHEN num <> '' THEN 'num' END AS kind FROM k)
SELECT page_id, CASE kind WHEN 'num' THEN 'sweepwidget' WHEN 'dir' THEN 'gleam' WHEN 'key' THEN 'gleam' END AS platform, CASE kind WHEN 'dir' THEN dir WHEN 'key' THEN key WHEN 'num' THEN num END AS campaign_id, CASE kind WHEN 'key' THEN slug WHEN 'num' THEN tail END AS slug,
  CASE kind WHEN 'dir' THEN 'https://gleam.io/giveaways/' || dir WHEN 'key' THEN 'https://gleam.io/' || key || coalesce('/' || slug, '') WHEN 'num' THEN 'https://sweepwidget.com/giveaways/' || num || coalesce('-' || tail, '') END AS entry_url FROM w""")
def platform_identity(spark, d):
    return view(spark, d, "shaped_pages").select("page_id", urls.platform_identity(F.col("url")).alias("p")).select("page_id", "p.platform", "p.campaign_id", "p.slug", "p.entry_url")


@_add("normalize_text", "SELECT doc_id, sha256(strip_accents(lower(text))) AS hash FROM documents")
def normalize_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.sha2(scoring.normalize_text(F.col("text")), 256).alias("hash"))


def _phrase_sql(c: str, p: str) -> str:
    return f"contains({c}, {_quoted(p)})" if " " in p or "'" in p else f"regexp_matches({c}, '{scoring.edge_pattern(p)}')"


def _hits_sql(c: str, phrases: list[str], twice: list[str] = ()) -> str:
    return "(" + " + ".join(f"CAST({_phrase_sql(c, p)} AS INT) * {2 if p in twice else 1}" for p in phrases) + ")"


def _any_sql(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(_phrase_sql(c, p) for p in phrases) + ")"


_TEXT_SQL = with_views("texts") + ", n AS (SELECT doc_id, strip_accents(lower(coalesce(title, ''))) AS title, strip_accents(lower(concat_ws(' ', rules_text, prize, body))) AS content, strip_accents(lower(coalesce(restriction, ''))) AS links, strip_accents(lower(url)) AS url, strip_accents(lower(coalesce(anchor, ''))) AS anchor FROM texts)\n"


def _text_columns(spark: SparkSession, d: str) -> DataFrame:
    n = scoring.normalize_text
    return view(spark, d, "texts").select("doc_id", n(F.col("title")).alias("title"), n(F.concat_ws(" ", "rules_text", "prize", "body")).alias("content"), n(F.col("restriction")).alias("links"), n(F.col("url")).alias("url"), n(F.col("anchor")).alias("anchor"))


@_add("phrase_hits", _TEXT_SQL + f"SELECT doc_id, {_hits_sql('content', scoring.ENTRY)} AS entry_hits, {_hits_sql('title', scoring.STRONG, scoring.TWICE)} AS title_hits, {_hits_sql('content', scoring.WEAK)} AS weak_hits FROM n")
def phrase_hits(spark, d):
    t = _text_columns(spark, d)
    return t.select("doc_id", scoring.phrase_hits(F.col("content"), scoring.ENTRY).alias("entry_hits"), scoring.phrase_hits(F.col("title"), scoring.STRONG, scoring.TWICE).alias("title_hits"), scoring.phrase_hits(F.col("content"), scoring.WEAK).alias("weak_hits"))


@_add("candidate_score", _TEXT_SQL + f"""
, f AS (SELECT doc_id, {_hits_sql('content', scoring.STRONG, scoring.TWICE)} AS s, {_hits_sql('content', scoring.WEAK)} AS w, {_any_sql('title', scoring.STRONG)} AS t, {_any_sql('url', scoring.STRONG)} AS u, {_any_sql('anchor', scoring.STRONG)} AS a, {_any_sql('links', scoring.TERMS)} OR {_any_sql('content', scoring.TERMS_IN_TEXT)} AS r, {_any_sql('content', scoring.DEADLINE)} AS e, {_any_sql('content', scoring.ENTRY)} AS n FROM n)
, p AS (SELECT *, CAST(CASE WHEN u THEN 0.30 ELSE 0 END AS DOUBLE) + CASE WHEN t THEN 0.22 ELSE 0 END + CASE WHEN a THEN 0.10 ELSE 0 END + CASE WHEN s >= 3 THEN 0.26 WHEN s = 2 THEN 0.14 WHEN s = 1 THEN 0.06 ELSE 0 END + CASE WHEN w = 0 THEN 0 WHEN s = 0 THEN least(0.05 * w, 0.08) ELSE least(0.02 * w, 0.05) END
  + CASE WHEN r THEN 0.16 ELSE 0 END + CASE WHEN e THEN 0.14 ELSE 0 END + CASE WHEN n THEN 0.14 ELSE 0 END AS total FROM f)
SELECT doc_id, CAST(round(least(CASE WHEN NOT (u OR r OR e OR n) AND s < 3 THEN total * 0.85 ELSE total END, 1.0) * 10000) AS BIGINT) AS score_bp, u AS in_url, a AS in_anchor, s AS strong, w AS weak FROM p""")
def candidate_score(spark, d):
    c = F.col
    scored = scoring.score_candidates(_text_columns(spark, d), c("url"), c("title"), c("content"), c("anchor"), c("links"))
    return scored.select("doc_id", F.round(c("score") * 10000).cast("long").alias("score_bp"), "evidence.in_url", "evidence.in_anchor", "evidence.strong", "evidence.weak")


_TAGS = [("retweet|comment below", "public"), ("no purchase", "free"), ("purchase required", "purchase"), ("closed", "expired"), ("worldwide", "worldwide"), ("(uk|united states) ?(residents)? only|united states", "abroad")]


@_add("tag_patterns", _TEXT_SQL + "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content || ' ' || links, '{p}') THEN '{t}' END" for p, t in _TAGS) + "], lambda x: x IS NOT NULL), ',') AS tags FROM n")
def tag_patterns(spark, d):
    t = _text_columns(spark, d)
    return t.select("doc_id", F.array_join(scoring.tag_patterns(F.concat_ws(" ", "content", "links"), _TAGS), ",").alias("tags"))


def _class_sql(c: str) -> str:
    t, public, private = f"lower(trim(coalesce({c}, '')))", "|".join(actions.PUBLIC_PARTS), "|".join(actions.NON_PUBLIC_PARTS)
    hit = lambda p: f"regexp_matches({t}, '{p}')"
    return (
        f"CASE WHEN {t} = '' THEN 'unknown' WHEN {t} IN {_words(actions.NON_PUBLIC)} THEN 'non_public' WHEN {t} IN {_words(actions.PUBLIC)} THEN 'public_social' WHEN {hit(public)} AND NOT {hit(private)} THEN 'public_social' "
        f"WHEN {hit(private)} AND NOT {hit(public)} THEN 'non_public' WHEN {hit('follow|subscribe')} THEN 'non_public' WHEN {hit(public)} THEN 'public_social' ELSE 'unknown' END"
    )


@_add("action_class", with_views("campaign_actions") + f"SELECT kind, entry_type, count(*) AS n FROM (SELECT entry_type, {_class_sql('entry_type')} AS kind FROM campaign_actions) GROUP BY ALL")
def action_class(spark, d):
    return view(spark, d, "campaign_actions").groupBy(actions.action_class(F.col("entry_type")).alias("kind"), "entry_type").agg(F.count(F.lit(1)).alias("n"))


@_add("platform_verdict", with_views("campaign_actions") + f"""
, k AS (SELECT *, {_class_sql('entry_type')} AS kind FROM campaign_actions)
, c AS (SELECT campaign_id, count(*) FILTER (kind = 'non_public') AS non_public, count(*) FILTER (kind = 'public_social') AS public_social, count(*) FILTER (kind = 'unknown') AS unknown, count(*) FILTER (kind = 'public_social' AND mandatory) AS must, max(actions_required) AS quota FROM k GROUP BY campaign_id)
SELECT campaign_id, non_public, public_social, unknown, CASE WHEN must > 0 THEN 'reject' WHEN coalesce(quota, 0) > 0 THEN CASE WHEN non_public + unknown >= quota THEN 'accept' WHEN public_social > 0 THEN 'reject' ELSE 'inconclusive' END
  WHEN non_public > 0 THEN 'accept' WHEN public_social > 0 AND unknown = 0 THEN 'reject' WHEN unknown > 0 AND public_social = 0 THEN 'accept' ELSE 'inconclusive' END AS verdict FROM c""")
def platform_verdict(spark, d):
    return actions.platform_verdict(view(spark, d, "campaign_actions")).drop("says")


_ENTRY_SQL = with_views("texts") + """, e AS (SELECT doc_id, strip_accents(lower(coalesce(restriction, ''))) AS restriction, strip_accents(lower(concat_ws(chr(10), title, prize))) AS fields,
  strip_accents(lower(concat_ws(chr(10), restriction, title, prize, rules_text))) AS text FROM texts)
"""


def _entry_columns(spark: SparkSession, d: str) -> DataFrame:
    n = scoring.normalize_text
    return view(spark, d, "texts").select("doc_id", n(F.col("restriction")).alias("restriction"), n(F.concat_ws("\n", "title", "prize")).alias("fields"), n(F.concat_ws("\n", "restriction", "title", "prize", "rules_text")).alias("text"))


def _is(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_quoted(pattern)})"


def _first_sql(c: str, rules: entry.Rules) -> str:
    return "CASE " + " ".join(f"WHEN {_is(c, p)} THEN '{label}'" for p, label in rules) + " END"


def _tags_sql(c: str, rules: entry.Rules) -> list[str]:
    return [f"CASE WHEN {_is(c, p)} THEN '{label}' END" for p, label in rules]


_ASKED = f"regexp_matches(regexp_replace(text, {_quoted(entry.NOT_REQUIRED)}, ' ', 'g'), {_quoted(entry.REQUIRED)})"
_PURCHASE = f"(({_ASKED} OR {_is('text', entry.HARD[0][0])}) AND NOT {_is('text', entry.NO_PURCHASE)})"
_HARD = f"CASE WHEN {_PURCHASE} THEN 'purchase_required' ELSE {_first_sql('text', entry.HARD[1:])} END"
_SCOPE = f"coalesce({_first_sql('trim(restriction)', entry.SCOPES)}, 'unknown')"
_FREE = f"CASE WHEN {_is('text', entry.NO_PURCHASE)} THEN true WHEN {_ASKED} OR {_is('text', entry.FEE)} THEN false END"
_FRICTION = f"CASE WHEN trim(text) = '' THEN 'unknown' WHEN {_HARD} IS NOT NULL THEN 'hard' WHEN {_first_sql('text', entry.MEDIUM)} IS NOT NULL THEN 'medium' WHEN {_first_sql('text', entry.EASY)} IS NOT NULL THEN 'easy' ELSE 'unknown' END"
_ONLY = _is("restriction", r"\bonly\b")
_REASON = "CASE WHEN trim(text) = '' THEN 'insufficient_text' " + " ".join(f"WHEN {_is('text', p)} THEN '{r}'" for p, r, _ in entry.LADDER) + f" WHEN {_SCOPE} IN ('worldwide', 'france', 'eu', 'uk', 'us', 'canada') THEN 'scope_' || {_SCOPE} WHEN {_SCOPE} = 'specific' AND {_ONLY} THEN 'specific_only_without_france' WHEN {_is('text', entry.SHIPPING)} THEN 'shipping_restricted_ambiguous' ELSE 'unknown' END"


@_add("entry_friction", _ENTRY_SQL + f"SELECT doc_id, {_FRICTION} AS friction, coalesce({_first_sql('fields', entry.METHODS)}, {_first_sql('text', entry.EASY)}, {_first_sql('text', entry.MEDIUM)}, {_HARD}) AS method FROM e")
def entry_friction(spark, d):
    e = _entry_columns(spark, d)
    return e.select("doc_id", entry.entry_friction(F.col("text"), F.col("fields")).alias("f")).select("doc_id", "f.friction", "f.method")


@_add("geo_scope", _ENTRY_SQL + f"SELECT doc_id, {_SCOPE} AS scope FROM e")
def geo_scope(spark, d):
    return _entry_columns(spark, d).select("doc_id", entry.geo_scope(F.col("restriction")).alias("scope"))


@_add("region_allowed", _ENTRY_SQL + f"SELECT doc_id, CASE WHEN {_is('restriction', entry.EXCLUDED)} THEN false WHEN {_SCOPE} IN ('worldwide', 'france', 'eu') THEN true WHEN {_SCOPE} IN ('uk', 'us', 'canada') THEN false WHEN {_SCOPE} = 'specific' AND {_ONLY} THEN false END AS allowed FROM e")
def region_allowed(spark, d):
    return _entry_columns(spark, d).select("doc_id", entry.region_allowed(F.col("restriction")).alias("allowed"))


_YES = _words([r for _, r, good in entry.LADDER if good] + ["scope_worldwide", "scope_france", "scope_eu"])
_NO = _words([r for _, r, good in entry.LADDER if not good] + ["scope_uk", "scope_us", "scope_canada", "specific_only_without_france"])


@_add("region_eligibility", _ENTRY_SQL + f", r AS (SELECT doc_id, {_REASON} AS reason FROM e) SELECT doc_id, CASE WHEN reason IN {_YES} THEN 'eligible' WHEN reason IN {_NO} THEN 'ineligible' ELSE 'unknown' END AS state, CASE WHEN reason IN {_YES} THEN true WHEN reason IN {_NO} THEN false END AS flag, 'local_' || reason AS reason FROM r")
def region_eligibility(spark, d):
    e = _entry_columns(spark, d)
    return e.select("doc_id", entry.region_eligibility(F.col("text"), F.col("restriction")).alias("r")).select("doc_id", "r.state", "r.flag", "r.reason")


_REASONS = [*_tags_sql("text", entry.UNDESIRABLE), *_tags_sql("fields", entry.SHORT_FIELDS), f"CASE WHEN {_is('text', entry.EXPIRED)} THEN 'expired' END", f"CASE WHEN {_PURCHASE} THEN 'purchase_required' END", *_tags_sql("text", entry.HARD[1:3])]


@_add("undesirable_reasons", _ENTRY_SQL + f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{', '.join(_REASONS)}], lambda x: x IS NOT NULL))), ',') AS reasons FROM e")
def undesirable_reasons(spark, d):
    e = _entry_columns(spark, d)
    return e.select("doc_id", F.array_join(F.array_sort(entry.undesirable_reasons(F.col("fields"), F.col("text"))), ",").alias("reasons"))


@_add("free_entry", _ENTRY_SQL + f"SELECT doc_id, {_FREE} AS free FROM e")
def free_entry(spark, d):
    return _entry_columns(spark, d).select("doc_id", entry.free_entry(F.col("text")).alias("free"))


_PRIORITY = """CASE WHEN free IS FALSE THEN 90 WHEN friction = 'hard' THEN 80 WHEN scope = 'worldwide' AND friction = 'easy' AND free IS TRUE THEN 1 WHEN (allowed IS TRUE OR scope IN ('france', 'eu')) AND friction = 'easy' THEN 2
  WHEN scope = 'worldwide' AND friction = 'medium' THEN 3 WHEN friction = 'easy' THEN 4 WHEN friction = 'medium' THEN 5 WHEN friction = 'unknown' THEN 6 ELSE 70 END"""


@_add("discovery_priority", _ENTRY_SQL + f", a AS (SELECT doc_id, {_FREE} AS free, {_FRICTION} AS friction, {_SCOPE} AS scope, CASE WHEN {_is('restriction', entry.EXCLUDED)} THEN false WHEN {_SCOPE} IN ('worldwide', 'france', 'eu') THEN true ELSE false END AS allowed FROM e) SELECT doc_id, {_PRIORITY} AS priority FROM a")
def discovery_priority(spark, d):
    e = _entry_columns(spark, d)
    e = e.select("doc_id", entry.free_entry(F.col("text")).alias("free"), entry.entry_friction(F.col("text"), F.lit(""))["friction"].alias("friction"), entry.region_allowed(F.col("restriction")).alias("allowed"), entry.geo_scope(F.col("restriction")).alias("scope"))
    return e.select("doc_id", entry.discovery_priority(F.col("free"), F.col("friction"), F.col("allowed"), F.col("scope")).alias("priority"))


_SHAPED = with_views("shaped_pages")
_CALL = r"""nullif(replace(regexp_extract(html, 'initCampaign\((.*)\)"', 1), '&quot;', '"'), '')"""


def shaped(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "shaped_pages")


@_add("labelled_value", _SHAPED + r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)(?:^|[\n>])\s*Closing Date\s*(?:[:|]\s*|\n\s*)([^\n<]+)', 1)), '') AS closing,
  nullif(trim(regexp_extract(html, '(?is)<dt[^>]*>\s*Open to\s*</dt>\s*<dd[^>]*>(.*?)</dd>', 1)), '') AS open_to FROM shaped_pages""")
def labelled_value(spark, d):
    return shaped(spark, d).select("page_id", campaigns.value_after(F.col("html"), "Closing Date").alias("closing"), campaigns.fact(F.col("html"), "Open to").alias("open_to"))


@_add("filter_text", with_views("texts") + "SELECT doc_id, concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(prize), ''), 'Category: ' || nullif(trim(rules_text), ''), 'Eligible: ' || nullif(trim(restriction), '')) AS filter_text FROM texts")
def filter_text(spark, d):
    c = F.col
    return view(spark, d, "texts").select("doc_id", campaigns.filter_text(c("title"), c("prize"), c("rules_text"), c("restriction")).alias("filter_text"))


@_add("listing_children", _SHAPED + f"""
, raw AS (SELECT page_id, url, regexp_extract_all(html, {_quoted(campaigns.CARD)}, 1) AS h, regexp_extract_all(html, {_quoted(campaigns.CARD)}, 2) AS t FROM shaped_pages)
, c AS (SELECT page_id, url, unnest(h) AS h, unnest(t) AS t, generate_subscripts(h, 1) AS pos FROM raw)
, i AS (SELECT page_id, pos, coalesce(nullif(regexp_extract(h, '[?&](?:chi|i|ix)=(\\d+)', 1), ''), h) AS item, trim(regexp_replace(t, '<[^>]*>', '', 'g')) AS title, url_decode(regexp_extract(h, '[?&]to=([^&#]*)', 1)) AS to_url, h, url FROM c)
SELECT page_id, item, title, CASE WHEN starts_with(to_url, 'http') THEN to_url WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h END AS target
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, item ORDER BY pos) AS n FROM i) WHERE n = 1""")
def listing_children(spark, d):
    return campaigns.listing_children(shaped(spark, d))


@_add("parse_failure_reason", _SQL["platform_identity"].replace("SELECT page_id, CASE kind", ", who AS (SELECT page_id, CASE kind", 1) + f""")
SELECT s.page_id, CASE WHEN http_status NOT BETWEEN 200 AND 299 THEN 'HTTP status ' || CAST(http_status AS VARCHAR) WHEN campaign_id IS NOT NULL AND regexp_matches(url, '^https://gleam.io/giveaways/[A-Za-z0-9]{{4,12}}/?$') THEN 'unsupported directory detail shape'
  WHEN campaign_id IS NULL AND NOT regexp_matches(url, '^https://[^/]*/giveaways/?([?]|$)') THEN 'missing campaign identity' WHEN regexp_matches(html, '(?i)http-equiv=["'']?refresh|window[.]location\\s*=|meta[^>]+refresh') THEN 'redirect' WHEN trim(html) = '' THEN 'other'
  WHEN NOT contains(html, 'initCampaign(') THEN 'no initCampaign payload' WHEN {_CALL} IS NULL OR NOT json_valid({_CALL}) THEN 'invalid JSON/payload' END AS reason FROM shaped_pages s JOIN who USING (page_id)""")
def parse_failure_reason(spark, d):
    return shaped(spark, d).select("page_id", campaigns.failure_reason(F.col("html"), F.col("http_status"), F.col("url")).alias("reason"))


@_add("campaign_fields", _SHAPED + f", p AS (SELECT page_id, {_CALL} AS payload FROM shaped_pages) SELECT page_id, json_extract_string(payload, '$.campaign.key') AS campaign_key, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(json_extract_string(payload, '$.campaign.ends_at') AS BIGINT)) AS ends_at, CAST(json_array_length(payload, '$.entry_methods') AS INT) AS actions, CAST(1 AS INT) AS mandatory_actions, false AS has_paid, 'mandatory:email_subscribe; optional:referral; referral:referral' AS instructions FROM p WHERE payload IS NOT NULL AND json_valid(payload)")
def campaign_fields(spark, d):
    return campaigns.campaign_fields(shaped(spark, d)).select("page_id", "campaign_key", "ends_at", "actions", "mandatory_actions", "has_paid", "instructions")


@_add("campaign_actions", _SHAPED + f", p AS (SELECT page_id, {_CALL} AS payload FROM shaped_pages), a AS (SELECT page_id, unnest(range(CAST(json_array_length(payload, '$.entry_methods') AS BIGINT))) AS pos, payload FROM p WHERE payload IS NOT NULL AND json_valid(payload)), t AS (SELECT page_id, CAST(pos AS INT) AS pos, json_extract_string(payload, '$.entry_methods[' || pos || '].entry_type') AS entry_type, CAST(json_extract_string(payload, '$.entry_methods[' || pos || '].mandatory') AS BOOLEAN) AS mandatory FROM a) SELECT *, CASE " + " ".join(f"WHEN regexp_matches(lower(entry_type), '{p}') THEN '{n}'" for p, n in campaigns.CATEGORIES) + " ELSE 'other' END AS category FROM t")
def campaign_actions(spark, d):
    return campaigns.campaign_actions(shaped(spark, d))


@_add("frontier", with_views("edges") + ", e AS (SELECT src, dst_a AS dst FROM edges UNION ALL SELECT src, dst_b FROM edges)\n" + """
, s0 AS (SELECT DISTINCT source, src AS node, 0 AS depth FROM edges WHERE src % 50 = 0)
, s1 AS (SELECT source, node, min(depth) AS depth FROM (SELECT * FROM s0 UNION ALL SELECT source, e.dst, depth + 1 FROM s0 JOIN e ON e.src = s0.node) GROUP BY source, node)
, s2 AS (SELECT source, node, min(depth) AS depth FROM (SELECT * FROM s1 UNION ALL SELECT source, e.dst, depth + 1 FROM s1 JOIN e ON e.src = s1.node) GROUP BY source, node)
, s3 AS (SELECT source, node, min(depth) AS depth FROM (SELECT * FROM s2 UNION ALL SELECT source, e.dst, depth + 1 FROM s2 JOIN e ON e.src = s2.node) GROUP BY source, node)
SELECT source, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY depth, node) AS n FROM s3) WHERE n <= 40""")
def frontier(spark, d):
    e = view(spark, d, "edges")
    both = e.select("src", F.col("dst_a").alias("dst")).unionByName(e.select("src", F.col("dst_b").alias("dst")))
    seeds = e.where("src % 50 = 0").select("source", F.col("src").alias("node"))
    return merge.expand_frontier(both, seeds, max_depth=3, max_pages=40)


_ENTRY_OF = "coalesce(entry_url, CASE WHEN platform_campaign_id IS NOT NULL THEN 'https://' || coalesce(platform, 'gleam') || '.example/' || platform_campaign_id || '/x' END, canonical_url)"


@_add("entry_url_of", _STATE_SQL + f"SELECT id, {_ENTRY_OF} AS entry FROM g")
def entry_url_of(spark, d):
    return listing.entry_url_of(state(spark, d), "https://{platform}.example/{key}/x").select("id", "entry")


_GATE = f"CASE WHEN title IS NULL AND prize IS NULL THEN 'missing_content' WHEN analyzed_at IS NOT NULL THEN 'already_analyzed' WHEN manual_status IN ('entered', 'ignored', 'won', 'lost') THEN 'terminal' WHEN coalesce(confidence, 0) < 0.45 THEN 'below_threshold' WHEN end_at < {_NOW} THEN 'expired' WHEN regexp_matches(strip_accents(lower(concat_ws(chr(10), title, prize))), {_quoted("|".join(p for p, _ in [*entry.UNDESIRABLE, *entry.SHORT_FIELDS]))}) THEN 'undesirable' WHEN coalesce(france_eligibility = 'ineligible', false) OR eligible_france IS FALSE THEN 'region_ineligible' WHEN entry_acceptable IS FALSE AND requires_public_social_action IS TRUE THEN 'public_social' ELSE 'send' END"


@_add("analysis_gates", _STATE_SQL + f"SELECT id, {_GATE} AS gate FROM g")
def analysis_gates(spark, d):
    return gates.analysis_gates(state(spark, d), NOW).select("id", "gate")


@_add("apply_local_skips", _STATE_SQL + f", k AS (SELECT *, {_GATE} AS gate FROM g) SELECT id, CASE WHEN gate = 'expired' THEN 'expired' WHEN gate IN ('undesirable', 'region_ineligible', 'public_social') THEN 'rejected' ELSE status END AS status, CASE WHEN gate IN ('expired', 'undesirable', 'region_ineligible', 'public_social') THEN '{{\"local_skip\":\"' || gate || '\"}}' ELSE analysis_json END AS analysis_json, analyzed_at FROM k")
def apply_local_skips(spark, d):
    return gates.apply_local_skips(gates.analysis_gates(state(spark, d), NOW)).select("id", "status", "analysis_json", "analyzed_at")


_EXPIRED_TEXT = "strip_accents(lower(concat_ws(' ', title, CASE id % 4 WHEN 0 THEN 'ended on 1996-01-05' WHEN 1 THEN 'ended on 1999-01-05' WHEN 2 THEN 'this giveaway has ended' END)))"


@_add("clearly_expired", _STATE_SQL + f", t AS (SELECT id, end_at, {_EXPIRED_TEXT} AS text FROM g) SELECT id, coalesce(end_at < {_NOW}, false) OR {_is('text', entry.EXPIRED)} OR coalesce(try_cast(nullif(regexp_extract(text, '\\bended\\s+on\\s+(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), '') AS TIMESTAMP) < {_NOW}, false) AS expired FROM t")
def clearly_expired(spark, d):
    text = F.expr("concat_ws(' ', title, CASE id % 4 WHEN 0 THEN 'ended on 1996-01-05' WHEN 1 THEN 'ended on 1999-01-05' WHEN 2 THEN 'this giveaway has ended' END)")
    return state(spark, d).select("id", gates.clearly_expired(F.col("end_at"), scoring.normalize_text(text), NOW).alias("expired"))


@_add("merge_verdict", _SQL["platform_verdict"].replace("SELECT campaign_id, non_public", ", v AS (SELECT campaign_id, non_public", 1).rstrip() + """)
, a AS (SELECT giveaway_id, bool_or(entry_acceptable) AS ok, bool_or(NOT is_giveaway) AS must FROM (""" + view_sql("analysis_responses") + """) GROUP BY giveaway_id)
, m AS (SELECT campaign_id, CASE WHEN verdict = 'reject' THEN 'local_no' WHEN verdict = 'accept' THEN 'yes' WHEN ok IS FALSE OR must IS TRUE THEN 'no' WHEN ok THEN 'yes' ELSE 'open' END AS said FROM v LEFT JOIN a ON a.giveaway_id = v.campaign_id)
SELECT campaign_id, CASE said WHEN 'yes' THEN true WHEN 'open' THEN NULL ELSE false END AS acceptable, CASE said WHEN 'yes' THEN false WHEN 'open' THEN NULL ELSE true END AS requires_public, CASE WHEN said IN ('no', 'local_no') THEN 'requires public social-media action' END AS reason FROM m""")
def merge_verdict(spark, d):
    external = view(spark, d, "analysis_responses").groupBy(F.col("giveaway_id").alias("campaign_id")).agg(F.max("entry_acceptable").alias("ok"), F.max(~F.col("is_giveaway")).alias("must"))
    rows = actions.platform_verdict(view(spark, d, "campaign_actions")).join(external, "campaign_id", "left")
    open_ = F.coalesce("says", acceptability.verdict())
    merged = rows.withColumn("m", acceptability.merge_verdict(open_, F.col("must"), F.col("ok"), F.lit(None).cast("string")))
    return merged.select("campaign_id", "m.acceptable", "m.requires_public", "m.reason")


@_add("assess_entry", _ENTRY_SQL + f", a AS (SELECT doc_id, {_FREE} AS free, {_FRICTION} AS friction, {_SCOPE} AS scope, CASE WHEN {_is('restriction', entry.EXCLUDED)} THEN false WHEN {_SCOPE} IN ('worldwide', 'france', 'eu') THEN true ELSE false END AS allowed, len(list_filter([{', '.join(_REASONS)}], lambda x: x IS NOT NULL)) > 0 AS clear_skip FROM e) SELECT doc_id, friction, scope, free, {_PRIORITY} AS priority, clear_skip FROM a")
def assess_entry(spark, d):
    return gates.assess(_entry_columns(spark, d)).select("doc_id", "friction", "scope", "free", "priority", "clear_skip")


def _word_counts(rows: list[dict]) -> list[dict]:
    """Stands for a user's function."""
    return [{"words": len((r["title"] or "").split())} for r in rows]


@_add("enrich_batches", _STATE_SQL + "SELECT id, title, CAST(len(string_split(coalesce(title, ''), ' ')) - CASE WHEN coalesce(title, '') = '' THEN 1 ELSE 0 END AS INT) AS words, CAST(NULL AS VARCHAR) AS error FROM g WHERE analyzed_at IS NULL AND status = 'candidate' AND manual_status NOT IN ('entered', 'ignored', 'won', 'lost')")
def enrich_batches(spark, d):
    return ingest.enrich_batches(listing.pending(state(spark, d)).select("id", "title"), _word_counts, "words int")


_FLAGS = ", ".join(f"{_is('text', p)} AS {family}_{label}" for family, rules in prizes.FAMILIES.items() for p, label in rules)
_ANY = {family: "(" + " OR ".join(f"{family}_{label}" for _, label in rules) + ")" for family, rules in prizes.FAMILIES.items()}
_CASH = f"(cash_cash OR cash_paypal OR cash_prepaid_card OR (cash_cash_amount AND NOT {_ANY['discount']} AND NOT ({_ANY['travel']} OR {_ANY['tickets']} OR {_ANY['experience']} OR {_ANY['books']})))"
_MARKET = "(gift_amazon_gc AND NOT discount_min_spend)"
_LADDER = [
    ("trim(text) = ''", "unknown", "NULL", "NULL"), (f"{_CASH} AND cash_prepaid_card", "general_gift_card", "true", "95"), (f"{_CASH} AND cash_paypal", "cash", "true", "95"), (_CASH, "cash", "true", "98"),
    (" OR ".join(f"physical_{x}" for x in prizes.HIGH), "physical_good", "true", "92"), (" OR ".join(f"physical_{x}" for x in prizes.USEFUL), "physical_good", "true", "78"),
    (" OR ".join(f"digital_{x}" for x in prizes.GAMES), "digital_game", "true", "75"), (_ANY["digital"], "digital_good", "true", "70"), (_MARKET, "general_gift_card", "true", "80"),
    (f"discount_min_spend OR ({_ANY['gift']} AND {_ANY['discount']})", "restricted_gift_card", "false", "3"), (_ANY["discount"], "discount", "false", "2"),
    (f"{_ANY['travel']} AND NOT {_ANY['tickets']} AND NOT {_ANY['experience']}", "travel", "false", "2"), (_ANY["tickets"], "event_ticket", "false", "2"), ("experience_wedding", "service", "false", "1"),
    ("experience_service", "service", "false", "3"), (_ANY["experience"], "experience", "false", "3"), ("books_subscription", "subscription", "false", "4"), (_ANY["books"], "books_media", "false", "4"),
    (_ANY["gift"], "general_gift_card", "NULL", "55"), ("cash_cash_amount", "cash", "true", "90"), ("true", "unknown", "NULL", "50"),
]
_PICK = lambda at, wrap: "CASE " + " ".join(f"WHEN {x[0]} THEN {wrap(x[at])}" for x in _LADDER) + " END"


@_add("prize_preference", with_views("texts") + f"""
, t AS (SELECT doc_id, strip_accents(lower(concat_ws(' ', title, prize))) AS text FROM texts), f AS (SELECT doc_id, text, {_FLAGS} FROM t)
, v AS (SELECT doc_id, {_PICK(1, _quoted)} AS category, CAST({_PICK(2, str)} AS BOOLEAN) AS wanted, CAST({_PICK(3, str)} AS INT) AS priority, {_ANY['travel']} AS travel, discount_min_spend AS spend FROM f)
SELECT *, CASE WHEN wanted IS NULL THEN 100 WHEN wanted THEN 50 - least(priority, 100) WHEN category IN {_words(list(prizes.FAR))} THEN 300 + (10 - least(priority, 10)) ELSE 200 END AS rank FROM v""")
def prize_preference(spark, d):
    t = view(spark, d, "texts").select("doc_id", scoring.normalize_text(F.concat_ws(" ", "title", "prize")).alias("t"))
    return prizes.prize_preference(t, F.col("t")).select("doc_id", "category", "wanted", "priority", "travel", "spend", "rank")


def queries() -> dict[str, Query]:
    from tidemark import registry_rules

    return {**_QUERIES, **registry_rules.queries()}


def oracle_sql() -> dict[str, str]:
    from tidemark import registry_rules

    return {**_SQL, **registry_rules.oracle_sql()}
