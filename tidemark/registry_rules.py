"""Registered queries over page rules, candidates, verdicts made again, and whole runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import acceptability, campaigns, extract, listings, scoring
from tidemark.operators import actions, backfill
from tidemark.plans import candidates, ingest
from tidemark.sources.fixtures import view, view_sql, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_quoted, _words = registry._quoted, registry._words


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages, dealt over the sites of the rule tables and sources, as their sites' pages would arrive."""
    keys = [*extract.ADAPTERS, None]
    rows = view(spark, d, "shaped_pages")
    adapter = F.when(F.col("shape").isin("payload", "broken", "cards"), "gleam").when(F.col("shape") == "tracker", "sweepwidget").otherwise(F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("page_id") % len(keys) + 1).cast("int")))
    return rows.select("page_id", "url", "html", "http_status", adapter.alias("adapter"), (F.col("page_id") % 20).alias("source_id"), F.lit("").alias("anchor_text"))


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, so that rows compare on any engine."""
    return df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array<string>") else F.col(c) for c, t in df.dtypes])


_LINES = r"list_filter(string_split(replace(raw, chr(13), chr(10)), chr(10)), lambda x: regexp_matches(x, pub))"
_PUBLIC = "(?i)(?:" + "|".join(p for p, _ in acceptability.PUBLIC) + ")"
_OTHER = "(?i)(?:" + "|".join(p for p, _ in acceptability.OTHER_WAYS) + ")"


@_add("text_verdict", with_views("texts") + f"""
, r AS (SELECT doc_id, concat_ws(chr(10), nullif(title, ''), nullif(prize, ''), nullif(rules_text, '')) AS raw FROM texts)
, f AS (SELECT doc_id, raw, regexp_matches(strip_accents(lower(raw)) || chr(10) || raw, {_quoted(_PUBLIC)}) AS p, regexp_matches(strip_accents(lower(raw)) || chr(10) || raw, {_quoted(_OTHER)}) AS o, regexp_matches(raw, {_quoted(acceptability.MANDATORY)}) AS must, regexp_matches(raw, {_quoted(acceptability.OPTIONAL)}) AS may,
    list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, {_quoted(_PUBLIC)})) AS lines FROM r)
, k AS (SELECT *, CASE WHEN len(lines) = 0 THEN must AND NOT may ELSE len(list_filter(lines, lambda x: regexp_matches(x, {_quoted(acceptability.MANDATORY)}) AND NOT regexp_matches(x, {_quoted(acceptability.OPTIONAL)}))) = len(lines) END AS only_must,
    CASE WHEN len(lines) = 0 THEN may AND NOT must ELSE len(list_filter(lines, lambda x: regexp_matches(x, {_quoted(acceptability.OPTIONAL)}) AND NOT regexp_matches(x, {_quoted(acceptability.MANDATORY)}))) = len(lines) END AS only_may FROM f)
SELECT doc_id, CASE WHEN trim(raw) = '' THEN NULL WHEN NOT p THEN true WHEN o AND NOT only_must THEN true WHEN only_may THEN true WHEN must OR only_must THEN false END AS acceptable,
  CASE WHEN trim(raw) = '' THEN NULL WHEN NOT p OR (o AND NOT only_must) OR only_may THEN false WHEN must OR only_must THEN true END AS requires_public FROM k""")
def text_verdict(spark, d):
    c = F.col
    v = acceptability.text_verdict(c("title"), c("prize"), c("rules_text"))
    return view(spark, d, "texts").select("doc_id", F.explode(F.array(v)).alias("v")).select("doc_id", "v.acceptable", "v.requires_public")


_BOTH = "concat_ws(' ', nullif(trim(rules_text), ''), nullif(trim(prize), ''))"


@_add("listing_preference", with_views("texts") + f"""
SELECT doc_id, regexp_matches(coalesce(restriction, ''), '(?i)\\bworldwide\\b|\\binternational\\b|\\bopen\\s+worldwide\\b|\\bmonde\\s+entier\\b') AND NOT regexp_matches(lower({_BOTH}), {_quoted('|'.join(listings.UNWANTED))}) AS kept,
  CASE WHEN regexp_matches(lower({_BOTH}), {_quoted('|'.join(listings.UNWANTED))}) THEN false WHEN regexp_matches(lower({_BOTH}), {_quoted('|'.join(listings.WANTED))}) THEN true END AS wanted FROM texts""")
def listing_preference(spark, d):
    c = F.col
    about = F.concat_ws(" ", F.nullif(F.trim("rules_text"), F.lit("")), F.nullif(F.trim("prize"), F.lit("")))
    return view(spark, d, "texts").select("doc_id", listings.listing_preference(c("restriction"), c("rules_text"), c("prize")).alias("kept"), listings.category_wanted(about).alias("wanted"))


@_add("select_candidates", "WITH s AS (SELECT * FROM (" + registry._SQL["candidate_score"] + """)), u AS (SELECT doc_id, score_bp, 'https://x.example/' || CAST(doc_id // 3 AS VARCHAR) AS canonical_url, doc_id % 11 = 0 AS skip, CASE WHEN doc_id % 5 = 0 THEN 0.3 END AS own FROM s)
SELECT canonical_url, doc_id AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY doc_id) AS n FROM u WHERE score_bp / 10000.0 >= coalesce(own, 0.45) AND NOT skip) WHERE n = 1""")
def select_candidates(spark, d):
    s = registry.candidate_score(spark, d)
    u = s.selectExpr("CAST(doc_id AS LONG) AS ordinal", "score_bp / 10000.0D AS score", "concat('https://x.example/', CAST(doc_id DIV 3 AS STRING)) AS canonical_url", "doc_id % 11 = 0 AS skip", "CASE WHEN doc_id % 5 = 0 THEN 0.3D END AS source_threshold")
    return candidates.select_candidates(u).select("canonical_url", "ordinal")


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "texts")
    rows = t.selectExpr(
        "doc_id", "title", "prize", "substring(body, 1, 3000) AS excerpt", "restriction", "rules_text AS method_text", "CASE doc_id % 10 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS purchase_text", "CASE WHEN doc_id % 13 = 0 THEN true END AS free_hint",
        "CAST(NULL AS STRING) AS category", "concat_ws('\n', title, rules_text) AS filter_text", "doc_id % 17 = 0 AS expired", "CASE WHEN doc_id % 19 = 0 THEN 'medium' END AS friction_override", f"CAST(NULL AS {acceptability.VERDICT}) AS platform_says",
    )
    return candidates.candidate_status(rows)


@_add("candidate_status")
def candidate_status(spark, d):
    return _flat(_statuses(spark, d).select("doc_id", "status", "skip_analyze", "skip_reasons", "friction", "method", "scope", "region", "free", "requires_purchase", "requires_social", "priority", "prize_category", "eligibility", F.col("entry_verdict.acceptable").alias("acceptable")))


@_add("candidate_diagnostics")
def candidate_diagnostics(spark, d):
    c, t = F.col, registry._text_columns(spark, d)
    scored = scoring.score_candidates(t, c("url"), c("title"), c("content"), c("anchor"), c("links")).select("doc_id", "score", "evidence")
    return _flat(candidates.candidate_diagnostics(_statuses(spark, d).join(scored, "doc_id")).select("doc_id", "positive_signals", "negative_signals", "would_analyze"))


_FUNNEL = "SELECT page_id % 20 AS source_id, CASE shape WHEN 'cards' THEN 'listing' WHEN 'tracker' THEN 'shell' WHEN 'payload' THEN 'campaign' WHEN 'broken' THEN 'campaign' END AS kind, http_status, CASE shape WHEN 'payload' THEN 'ok' ELSE 'payload_missing' END AS parse_status, page_id % 3 AS links, page_id % 2 AS enqueued, CASE WHEN shape = 'payload' THEN 'c' || CAST(page_id % 97 AS VARCHAR) END AS campaign_id, page_id % 7 = 0 AS filtered_after, 'r' || CAST(page_id % 5 AS VARCHAR) AS reason FROM shaped_pages"


@_add("crawl_funnel", with_views("shaped_pages") + f", f AS ({_FUNNEL})" + """
, c AS (SELECT *, http_status IS NULL OR http_status BETWEEN 200 AND 299 AS ok FROM f)
, g AS (SELECT source_id, count(*) FILTER (kind = 'listing') AS listing_pages, CAST(coalesce(sum(links) FILTER (kind = 'listing'), 0) AS BIGINT) AS links_discovered, CAST(coalesce(sum(enqueued) FILTER (kind = 'listing'), 0) AS BIGINT) AS scheduled, count(*) FILTER (kind = 'shell') AS shell_pages,
  count(*) FILTER (kind = 'campaign') AS fetched, count(*) FILTER (kind = 'campaign' AND ok) AS http_2xx, count(*) FILTER (kind IN ('campaign', 'shell') AND NOT ok) AS http_errors, count(DISTINCT campaign_id) FILTER (kind = 'campaign' AND ok AND parse_status = 'ok') AS parsed,
  count(*) FILTER (kind = 'campaign' AND ok AND parse_status = 'ok') AS tried, count(*) FILTER (kind = 'campaign' AND ok AND parse_status = 'payload_missing') AS parse_failures, count(*) FILTER (kind = 'campaign' AND filtered_after) AS filtered_after_detail,
  coalesce(array_to_string(list_sort(list_distinct(list(reason) FILTER (kind = 'campaign' AND ok AND parse_status = 'payload_missing'))), '|'), '') AS failure_reasons FROM c GROUP BY source_id)
SELECT source_id, listing_pages, links_discovered, scheduled, shell_pages, fetched, http_2xx, http_errors, parsed, tried - parsed AS duplicates, parse_failures, filtered_after_detail, greatest(links_discovered - scheduled, 0) AS filtered_before_detail,
  round(parsed / nullif(CASE WHEN http_2xx > 0 THEN http_2xx ELSE parsed + parse_failures END, 0), 4) AS parse_rate, failure_reasons FROM g""")
def crawl_funnel(spark, d):
    view(spark, d, "shaped_pages").createOrReplaceTempView("_shaped_pages")
    rows = spark.sql(_FUNNEL.replace("VARCHAR", "STRING").replace("shaped_pages", "_shaped_pages"))
    return _flat(candidates.crawl_funnel(rows))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(entry_type), '{p}') THEN '{n}'" for p, n in campaigns.CATEGORIES) + " ELSE 'other' END"


@_add("platform_friction", with_views("campaign_actions") + f"""
, k AS (SELECT *, {_KIND} AS kind FROM campaign_actions)
, g AS (SELECT campaign_id, count(*) FILTER (mandatory) AS n, count(*) FILTER (mandatory AND kind = 'social') AS social, count(*) FILTER (mandatory AND (kind IN ('referral', 'upload') OR regexp_matches(entry_type, '{actions.CREATIVE}'))) AS heavy, count(*) FILTER (mandatory AND (kind IN ('email', 'visit', 'other') OR entry_type IN ('email_subscribe', 'newsletter', 'visit_website', 'visit_page', 'hidden', 'bonus', 'custom_action', 'question', 'choose_image'))) AS easy, coalesce(max(actions_required), count(*) FILTER (mandatory)) AS asked FROM k GROUP BY campaign_id)
SELECT campaign_id, CASE WHEN campaign_id % 23 = 0 OR heavy > 0 OR asked >= 6 OR social >= 4 THEN 'hard' WHEN campaign_id % 9 = 0 OR asked >= 3 OR social >= 2 THEN 'medium' WHEN asked <= 2 AND (n <= 2 OR easy = n) THEN 'easy' WHEN asked <= 4 THEN 'medium' ELSE 'unknown' END AS friction FROM g""")
def platform_friction(spark, d):
    acts = view(spark, d, "campaign_actions")
    campaigns_ = acts.select("campaign_id").distinct().selectExpr("campaign_id", "campaign_id % 9 = 0 AS login_required", "campaign_id % 23 = 0 AS has_paid")
    return actions.platform_friction(acts, campaigns_)


@_add("embedded_payload", registry._SHAPED + f", p AS (SELECT page_id, {registry._CALL} AS payload FROM shaped_pages) SELECT page_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.campaign.key') END AS campaign_key, payload IS NOT NULL AND json_valid(payload) AS read FROM p")
def embedded_payload(spark, d):
    p = campaigns.payload(F.col("html"))
    return view(spark, d, "shaped_pages").select("page_id", p["campaign"]["key"].alias("campaign_key"), p.isNotNull().alias("read"))


@_add("main_text")
def main_text(spark, d):
    return registry.pages(spark, d).select("page_id", extract.main_text(F.col("html")).alias("text"))


@_add("extract_fields")
def extract_fields(spark, d):
    return _flat(extract.extract_fields(site_pages(spark, d)).select("page_id", "adapter", "fields.*"))


@_add("text_campaign_fields")
def text_campaign_fields(spark, d):
    return campaigns.text_campaign_fields(view(spark, d, "shaped_pages"))


_DIRECTORY = """concat(html, '<a class="t" href="/giveaways/ab', CAST(page_id AS STRING), '"><p class="preview-tile__title">', CASE page_id % 3 WHEN 0 THEN 'Gaming PC' WHEN 1 THEN 'A mug' ELSE 'Cash' END, '</p></a><a class="t" href="/giveaways/cd', CAST(page_id AS STRING), '"><p class="preview-tile__title">Tea</p></a><a href="/giveaways?s=n&amp;p=', CAST(page_id % 4 AS STRING), '">n</a><a href="/giveaways?s=f">f</a>') AS html"""


def _directory(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "shaped_pages").where("shape = 'cards'").selectExpr("page_id", "url", _DIRECTORY)


@_add("directory_cards", with_views("shaped_pages") + """SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN (page_id % 3 <> 1) = (pos = 0) OR page_id % 3 = 1 AND pos = 0 THEN 'ab' ELSE 'cd' END || CAST(page_id AS VARCHAR) AS id, page_id % 3 <> 1 AND pos = 0 AS hinted FROM shaped_pages, unnest([0, 1]) AS t(pos) WHERE shape = 'cards' AND length('ab' || CAST(page_id AS VARCHAR)) >= 4""")
def directory_cards(spark, d):
    return campaigns.directory_cards(_directory(spark, d)).select("page_id", "pos", "id", "hinted")


@_add("directory_pages")
def directory_pages(spark, d):
    return campaigns.directory_pages(_directory(spark, d))


@_add("rss_links", "SELECT page_id, CAST(pos AS INT) AS pos, CASE pos WHEN 0 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/competitions/p' || CAST(page_id AS VARCHAR) ELSE 'https://x.example/competitions/q' || CAST(page_id % 9 AS VARCHAR) END AS href FROM pages, unnest([0, 1]) AS t(pos)")
def rss_links(spark, d):
    feed = "concat('<rss><channel><link>', url, '</link><item><title>', page_id, '</title><link>/competitions/p', page_id, '</link></item><item><link><![CDATA[https://x.example/competitions/q', page_id % 9, ']]></link></item><item><link>/blog/', page_id, '</link></item></channel></rss>') AS html"
    return extract.rss_links(registry.pages(spark, d).selectExpr("page_id", "url", feed))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    own = registry.state(spark, d).select("id", "title", "prize", "analyzed_at", "requires_public_social_action", "entry_rejection_reason")
    return view(spark, d, "stored_actions").join(own, "id")


@_add("recover_actions", with_views("stored_actions") + """
, a AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'visit_website:true|instagram_comment:false' WHEN id % 4 = 1 THEN 'twitter_tweet:true' WHEN id % 3 = 0 THEN 'email_subscribe:true|twitter_retweet:true|referral:false' WHEN id % 3 = 1 THEN 'instagram_follow:false|instagram_story:false' ELSE '' END AS actions, CASE WHEN id % 4 = 0 THEN 1 WHEN id % 3 = 0 THEN 2 END AS quota FROM stored_actions) SELECT * FROM a""")
def recover_actions(spark, d):
    named = F.transform("actions", lambda a: F.concat(a["entry_type"], F.lit(":"), a["mandatory"].cast("string")))
    return backfill.recover_actions(_stored(spark, d)).select("id", F.array_join(named, "|").alias("actions"), "quota")


@_add("backfill_verdicts")
def backfill_verdicts(spark, d):
    return backfill.backfill_verdicts(_stored(spark, d))


@_add("reevaluate_rejections")
def reevaluate_rejections(spark, d):
    return backfill.reevaluate_rejections(_stored(spark, d))


def _answers(rows: list[dict]) -> list[dict]:
    """Stands for a user's analysis: decides by the row's id."""
    out = []
    for r in rows:
        i = r["giveaway_id"]
        out.append({"is_giveaway": i % 9 != 0, "france_eligibility": ("eligible", "unknown", "ineligible")[i % 3], "wanted_prize": i % 4 != 0, "entry_acceptable": None if i % 5 == 0 else True, "end_date": None, "confidence": (i % 10) / 10})
    return out


@_add("ingest_pages")
def ingest_pages(spark, d):
    out = ingest.ingest_pages(site_pages(spark, d), registry.state(spark, d), registry.NOW)
    return out.select("id", "canonical_url", "title", "content_hash", "status", "last_seen_at", "manual_status", "prize", "end_at", "platform", "platform_campaign_id")


@_add("drain_queue", registry._STATE_SQL + f""", k AS (SELECT *, {registry._GATE} AS gate, analyzed_at IS NULL AND status = 'candidate' AND manual_status NOT IN ('entered', 'ignored', 'won', 'lost') AS waits FROM g)
, m AS (SELECT *, waits AND gate = 'send' AS sent, waits AND gate IN ('undesirable', 'region_ineligible', 'public_social') AS barred, ['eligible', 'unknown', 'ineligible'][id % 3 + 1] AS fe, CASE WHEN entry_acceptable IS FALSE THEN false WHEN id % 5 = 0 THEN entry_acceptable ELSE true END AS acc, CASE WHEN entry_acceptable IS FALSE OR id % 5 = 0 THEN requires_public_social_action ELSE false END AS pub FROM k)
SELECT id, CASE WHEN waits AND gate = 'expired' THEN 'expired' WHEN barred THEN 'rejected' WHEN NOT sent THEN status WHEN id % 9 = 0 OR coalesce(entry_url_status = 'gone', false) OR fe = 'ineligible' OR id % 4 = 0 OR acc IS FALSE OR pub IS TRUE THEN 'rejected' WHEN end_at < {registry._NOW} THEN 'expired' WHEN (id % 10) / 10.0 < 0.5 OR fe <> 'eligible' OR acc IS NULL THEN 'uncertain' ELSE 'active' END AS status,
  CASE WHEN sent THEN {registry._NOW} ELSE analyzed_at END AS analyzed_at, CASE WHEN sent THEN acc ELSE CASE WHEN waits AND gate = 'public_social' THEN false ELSE entry_acceptable END END AS entry_acceptable FROM m""")
def drain_queue(spark, d):
    return ingest.drain_queue(registry.state(spark, d), _answers, registry.NOW).select("id", "status", "analyzed_at", "entry_acceptable")


@_add("run_pipeline")
def run_pipeline(spark, d):
    """Pages in, the state after ingest and one pass over the queue, summed up by status."""
    return ingest.run_pipeline(site_pages(spark, d), registry.state(spark, d), _answers, registry.NOW)[1]


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
