"""Deterministic views over the driver tables, as SQL expressions that Spark and DuckDB both run.

Each stands for one input of the library: listings, texts, actions, sources, runs and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Columns = list[tuple[str, str, str]]

_GIVEAWAYS: Columns = [
    ('id', "long", 'o_orderkey'),
    ('source_id', "long", 'CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_custkey % 20 END'),
    ('canonical_url', "string", "concat('https://h', CAST(o_custkey % 97 AS STRING), '.example.org/c/', CAST(o_orderkey AS STRING))"),
    ('domain', "string", "concat('h', CAST(o_custkey % 97 AS STRING), '.example.org')"),
    ('title', "string", "CASE o_orderkey % 4 WHEN 0 THEN 'Win a console' WHEN 1 THEN 'Trip to Lisbon' WHEN 2 THEN 'Cash draw' ELSE NULL END"),
    ('prize', "string", "CASE o_orderkey % 3 WHEN 0 THEN 'PlayStation 5' WHEN 1 THEN 'Hotel weekend' ELSE NULL END"),
    ('prize_value_eur', "double", 'CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END'),
    ('prize_category', "string", "CASE o_orderkey % 4 WHEN 0 THEN 'physical_good' WHEN 1 THEN 'travel' WHEN 2 THEN 'cash' ELSE 'unknown' END"),
    ('wanted_prize', "boolean", 'CASE o_orderkey % 4 WHEN 1 THEN false WHEN 3 THEN NULL ELSE true END'),
    ('prize_priority', "int", 'CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS INT) END'),
    ('free_entry', "boolean", 'CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END'),
    ('eligible_france', "boolean", 'CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END'),
    ('france_eligibility', "string", "CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ineligible' WHEN 2 THEN 'unknown' ELSE 'eligible' END"),
    ('entry_method', "string", "CASE o_custkey % 4 WHEN 0 THEN 'web_form' WHEN 1 THEN 'email' WHEN 2 THEN '' ELSE NULL END"),
    ('entry_acceptable', "boolean", 'CASE o_orderkey % 6 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END'),
    ('requires_public_social_action', "boolean", 'CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END'),
    ('entry_rejection_reason', "string", "CASE WHEN o_orderkey % 6 = 0 THEN 'requires public social-media action' ELSE NULL END"),
    ('entry_url_status', "string", "CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'gone' WHEN 2 THEN 'temporary_error' WHEN 3 THEN 'blocked' ELSE 'live' END"),
    ('platform', "string", "CASE o_custkey % 3 WHEN 0 THEN 'gleam' WHEN 1 THEN 'sweepwidget' ELSE NULL END"),
    ('platform_campaign_id', "string", "CASE WHEN o_custkey % 3 = 2 THEN NULL ELSE concat('k', CAST(o_orderkey % 4000 AS STRING)) END"),
    ('status', "string", "CASE o_orderkey % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'active' WHEN 2 THEN 'expired' WHEN 3 THEN 'active' ELSE 'uncertain' END"),
    ('manual_status', "string", "CASE o_custkey % 8 WHEN 0 THEN 'interested' WHEN 1 THEN 'entered' WHEN 2 THEN 'ignored' WHEN 3 THEN 'won' WHEN 4 THEN 'lost' ELSE 'none' END"),
    ('confidence', "double", 'CAST(o_orderkey % 100 AS DOUBLE) / 100'),
    ('content_hash', "string", "concat('h', CAST(o_orderkey % 1000 AS STRING))"),
    ('discovered_at', "timestamp", 'o_orderdate'),
    ('last_seen_at', "timestamp", "o_orderdate + INTERVAL '3' DAY"),
    ('end_at', "timestamp", "CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderdate + INTERVAL '30' DAY ELSE o_orderdate + INTERVAL '7' DAY END"),
    ('analyzed_at', "timestamp", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' DAY END"),
    ('remind_at', "timestamp", "CASE WHEN o_custkey % 9 = 0 THEN o_orderdate + INTERVAL '2' DAY ELSE NULL END"),
    ('analysis_json', "string", 'CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat(\'{"_meta":{"model":"\', CASE WHEN o_orderkey % 2 = 0 THEN \'m1\' ELSE \'\' END, \'"}}\') END'),
]

_TEXTS: Columns = [
    ('doc_id', "long", 'doc_id'),
    ('url', "string", "CASE doc_id % 5 WHEN 0 THEN 'https://a.example/giveaway/1' WHEN 1 THEN 'https://b.example/jeu-concours/2' WHEN 2 THEN 'https://c.example/win' ELSE 'https://d.example/contest' END"),
    ('anchor', "string", "CASE doc_id % 7 WHEN 0 THEN 'Enter the sweepstakes' WHEN 1 THEN 'read more' WHEN 2 THEN 'tentez votre chance' ELSE NULL END"),
    ('title', "string", "CASE doc_id % 6 WHEN 0 THEN 'Official giveaway' WHEN 1 THEN 'Jeu concours' WHEN 2 THEN 'Laptop sale' WHEN 3 THEN 'Prize-ribbon shop' WHEN 4 THEN 'Bitcoin giveaway' ELSE NULL END"),
    ('prize', "string", "CASE doc_id % 9 WHEN 0 THEN 'PlayStation 5' WHEN 1 THEN 'Trip to London' WHEN 2 THEN '500 euros cash' WHEN 3 THEN 'Steam game key' WHEN 4 THEN 'Wedding package' WHEN 5 THEN 'PS5 + trip to Japan' WHEN 6 THEN 'Amazon gift card' WHEN 7 THEN '20 euros off purchases over 100' ELSE NULL END"),
    ('restriction', "string", "CASE doc_id % 8 WHEN 0 THEN 'Open worldwide' WHEN 1 THEN 'UK residents only' WHEN 2 THEN 'United States only' WHEN 3 THEN 'Open to France' WHEN 4 THEN 'Germany and Spain only' WHEN 5 THEN 'EU residents only' WHEN 6 THEN 'Worldwide excluding France' ELSE NULL END"),
    ('rules_text', "string", "CASE doc_id % 7 WHEN 0 THEN 'Retweet to enter' WHEN 1 THEN 'Follow us. Optional: comment below for bonus' WHEN 2 THEN 'No purchase necessary. Enter your email' WHEN 3 THEN 'Purchase required' WHEN 4 THEN 'This competition has closed' WHEN 5 THEN 'How to enter: fill out the form. Closing date soon' ELSE '' END"),
    ('body', "string", 'text'),
]

_CAMPAIGN_ACTIONS: Columns = [
    ('campaign_id', "long", 'l_orderkey'),
    ('position', "int", 'l_linenumber'),
    ('entry_type', "string", "CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN 'email_subscribe' WHEN 1 THEN 'instagram_follow' WHEN 2 THEN 'twitter_retweet' WHEN 3 THEN 'visit_website' WHEN 4 THEN 'referral' WHEN 5 THEN 'upload_image' WHEN 6 THEN 'custom_mystery_widget' WHEN 7 THEN 'instagram_story' ELSE 'discord_join_server' END"),
    ('mandatory', "boolean", 'l_suppkey % 3 = 0'),
    ('actions_required', "int", 'CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE CAST(l_orderkey % 5 AS INT) END'),
]

_SOURCES: Columns = [
    ('id', "long", 's_suppkey % 20'),
    ('name', "string", 's_name'),
    ('base_url', "string", "concat('https://s', CAST(s_suppkey AS STRING), '.example.net/')"),
    ('enabled', "boolean", 's_suppkey % 4 <> 0'),
    ('crawl_interval_minutes', "int", 'CAST(60 * (1 + s_suppkey % 4) AS INT)'),
    ('next_crawl_at', "timestamp", "CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '1996-02-16 00:00:00' ELSE TIMESTAMP '1996-02-18 00:00:00' END"),
]

_CRAWL_RUNS: Columns = [
    ('id', "long", 'event_id'),
    ('source_id', "long", 'user_id % 20'),
    ('started_at', "timestamp", 'ts'),
    ('finished_at', "timestamp", "CASE WHEN event_type = 'view' THEN NULL ELSE ts + INTERVAL '5' MINUTE END"),
    ('pages_fetched', "long", "CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 40 END"),
    ('candidates_found', "long", 'event_id % 7'),
    ('errors_count', "long", "CASE WHEN event_type IN ('error','view') THEN 1 + event_id % 3 ELSE 0 END"),
    ('failed', "boolean", "event_type = 'error'"),
]

_CRAWL_BATCH: Columns = [
    ('ordinal', "long", 'o_orderkey'),
    ('canonical_url', "string", "concat('https://h', CAST((CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 50 ELSE o_custkey END) % 97 AS STRING), '.example.org/c/', CAST((CASE WHEN o_orderkey % 28 = 0 THEN o_orderkey - 4 ELSE o_orderkey END) AS STRING))"),
    ('domain', "string", "concat('h', CAST((CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 50 ELSE o_custkey END) % 97 AS STRING), '.example.org')"),
    ('source_id', "long", 'o_custkey % 19'),
    ('title', "string", "CASE WHEN o_orderkey % 2 = 0 THEN concat('New title ', CAST(o_orderkey % 5 AS STRING)) ELSE NULL END"),
    ('prize', "string", "CASE WHEN o_orderkey % 5 = 0 THEN 'Camera' ELSE NULL END"),
    ('prize_category', "string", "CASE WHEN o_orderkey % 5 = 0 THEN 'physical_good' ELSE NULL END"),
    ('prize_priority', "int", 'CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 90 AS INT) ELSE NULL END'),
    ('free_entry', "boolean", 'CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END'),
    ('entry_method', "string", "CASE WHEN o_custkey % 4 = 0 THEN 'web_form' ELSE NULL END"),
    ('end_at', "timestamp", "CASE WHEN o_custkey % 4 = 1 THEN o_orderdate + INTERVAL '40' DAY ELSE NULL END"),
    ('content_hash', "string", "concat('h', CAST(o_orderkey % 1500 AS STRING))"),
    ('platform', "string", "CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'gleam' WHEN o_custkey % 3 = 1 THEN 'sweepwidget' ELSE NULL END"),
    ('platform_campaign_id', "string", "CASE WHEN o_orderkey % 8 = 0 OR o_custkey % 3 = 2 THEN NULL WHEN o_orderkey % 24 = 12 THEN concat('b', CAST(o_orderkey % 300 AS STRING)) ELSE concat('k', CAST(o_orderkey % 4000 AS STRING)) END"),
    ('entry_url', "string", "CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 24 = 0 THEN concat('https://gleam.io/k', CAST(o_orderkey % 4000 AS STRING), '/x') WHEN o_orderkey % 40 = 8 THEN concat('https://gleam.io/n', CAST(o_orderkey % 1000 AS STRING), '/x') WHEN o_custkey % 5 = 0 THEN 'https://shop.example.org/enter' ELSE NULL END"),
    ('eligible_france', "boolean", 'CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END'),
    ('entry_acceptable', "boolean", 'CASE o_custkey % 7 WHEN 0 THEN false WHEN 1 THEN true ELSE NULL END'),
    ('wanted_prize', "boolean", 'CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END'),
    ('status', "string", "CASE o_orderkey % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'expired' ELSE 'candidate' END"),
    ('seen_at', "timestamp", "o_orderdate + INTERVAL '10' DAY"),
]

_LINK_CHECKS: Columns = [
    ('check_id', "long", 'event_id'),
    ('giveaway_id', "long", 'user_id'),
    ('checked_at', "timestamp", 'ts'),
    ('http_status', "int", "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 503 WHEN 'error' THEN 404 WHEN 'signup' THEN 403 ELSE NULL END"),
]

_ANALYSIS_RESPONSES: Columns = [
    ('ordinal', "long", 'o_orderkey'),
    ('giveaway_id', "long", 'CASE o_orderkey % 11 WHEN 0 THEN o_orderkey + 100000000 WHEN 1 THEN o_orderkey + 1 ELSE o_orderkey END'),
    ('is_giveaway', "boolean", 'o_orderkey % 10 <> 0'),
    ('france_eligibility', "string", "CASE o_custkey % 4 WHEN 0 THEN 'ineligible' WHEN 1 THEN 'unknown' ELSE 'eligible' END"),
    ('wanted_prize', "boolean", 'CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END'),
    ('entry_acceptable', "boolean", 'CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END'),
    ('end_date', "timestamp", "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '20' DAY END"),
    ('confidence', "double", 'CAST(o_orderkey % 100 AS DOUBLE) / 100'),
]

_EDGES: Columns = [
    ('source', "long", 'page_id % 7'),
    ('src', "long", 'page_id'),
    ('dst_a', "long", '(page_id * 3 + 1) % 200'),
    ('dst_b', "long", '(page_id * 5 + 2) % 200'),
]

_SHAPED_PAGES: Columns = [
    ('page_id', "long", 'page_id'),
    ('shape', "string", "CASE page_id % 6 WHEN 0 THEN 'labels' WHEN 1 THEN 'facts' WHEN 2 THEN 'cards' WHEN 3 THEN 'payload' WHEN 4 THEN 'tracker' ELSE 'broken' END"),
    ('url', "string", "CASE page_id % 6 WHEN 2 THEN 'https://gleam.io/giveaways?s=n' WHEN 3 THEN concat('https://gleam.io/key', CAST(page_id AS STRING), '/x') WHEN 4 THEN concat('https://sweepwidget.com/c/', CAST(page_id AS STRING), CASE WHEN page_id % 4 = 0 THEN '-slug' ELSE '' END) WHEN 5 THEN CASE page_id % 5 WHEN 0 THEN 'https://gleam.io/privacy' WHEN 1 THEN concat('https://gleam.io/giveaways/ab', CAST(page_id AS STRING)) ELSE concat('https://gleam.io/bad', CAST(page_id AS STRING), '/x') END ELSE url END"),
    ('http_status', "int", 'CASE WHEN page_id % 30 = 5 THEN 404 WHEN page_id % 42 = 11 THEN 302 ELSE 200 END'),
    ('html', "string", 'concat(CASE WHEN page_id % 66 = 17 THEN \'\' ELSE html END, CASE page_id % 6 WHEN 0 THEN concat(\'<h1>Item \', CAST(page_id AS STRING), \'</h1><p>Promoter\', chr(10), \'Org \', CAST(page_id % 7 AS STRING), chr(10), \'Closing Date\', chr(10), \'2026-10-01</p>\') WHEN 1 THEN concat(\'<dl><dt>Open to</dt><dd>\', CASE WHEN page_id % 4 = 1 THEN \'Worldwide\' ELSE \'United States\' END, \'</dd><dt>Prize</dt><dd>Box \', CAST(page_id AS STRING), \'</dd></dl>\') WHEN 2 THEN concat(\'<a href="/giveaways/c\', CAST(page_id AS STRING), \'a"><b>Camera</b></a><a href="/giveaways/c\', CAST(page_id AS STRING), \'b"><b>Gaming PC</b></a>\') WHEN 3 THEN concat(\'<div data-init="initCampaign({&quot;campaign&quot;:{&quot;key&quot;:&quot;key\', CAST(page_id AS STRING), \'&quot;,&quot;ends_at&quot;:\', CAST(1700000000 + page_id AS STRING), \'},&quot;entry_methods&quot;:[{&quot;entry_type&quot;:&quot;email_subscribe&quot;,&quot;mandatory&quot;:true},{&quot;entry_type&quot;:&quot;referral&quot;,&quot;mandatory&quot;:false}]})"></div>\') WHEN 4 THEN concat(\'<a href="/out?chi=\', CAST(page_id AS STRING), \'&to=https%3A%2F%2Fh\', CAST(page_id AS STRING), \'.example%2Fwin">Offer \', CAST(page_id AS STRING), \'</a>\') ELSE CASE page_id % 11 WHEN 0 THEN \'\' WHEN 1 THEN \'<meta http-equiv="refresh" content="0">\' WHEN 6 THEN \' \' ELSE \'<div data-init="initCampaign({broken"></div>\' END END)'),
]

_STORED_ACTIONS: Columns = [
    ('id', "long", 'o_orderkey'),
    ('entry_method', "string", "CASE o_orderkey % 3 WHEN 0 THEN 'actions_required=2; mandatory:email_subscribe,twitter_retweet; optional:referral' WHEN 1 THEN 'optional:instagram_follow,instagram_story' ELSE NULL END"),
    ('analysis_json', "string", 'CASE o_orderkey % 4 WHEN 0 THEN \'{"actions_required":1,"mandatory_entry_types":["visit_website"],"optional_entry_types":["instagram_comment"]}\' WHEN 1 THEN \'{"_meta":{"mandatory_entry_types":["twitter_tweet"]}}\' ELSE NULL END'),
    ('entry_acceptable', "boolean", 'CASE o_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE NULL END'),
    ('status', "string", "CASE o_custkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'active' WHEN 2 THEN 'candidate' ELSE 'expired' END"),
]

_CHANGES: Columns = [
    ('change_id', "long", 'event_id'),
    ('giveaway_id', "long", 'user_id'),
    ('changed_at', "timestamp", 'ts'),
    ('manual_status', "string", "CASE event_type WHEN 'view' THEN 'interested' WHEN 'click' THEN 'entered' WHEN 'purchase' THEN 'won' WHEN 'error' THEN 'bogus' ELSE 'ignored' END"),
    ('hours', "double", 'CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 800 AS DOUBLE) + 0.5 END'),
    ('interval_minutes', "double", 'CAST(event_id % 120 AS DOUBLE) + 0.25'),
]

#: Name, driver table, columns and filter of each view.
VIEWS: dict[str, tuple[str, Columns, str | None]] = {
    'giveaways': ('orders', _GIVEAWAYS, None),
    'texts': ('documents', _TEXTS, None),
    'campaign_actions': ('lineitem', _CAMPAIGN_ACTIONS, None),
    'sources': ('supplier', _SOURCES, 's_suppkey < 20'),
    'crawl_runs': ('events', _CRAWL_RUNS, None),
    'crawl_batch': ('orders', _CRAWL_BATCH, 'o_orderkey % 4 = 0'),
    'link_checks': ('events', _LINK_CHECKS, None),
    'analysis_responses': ('orders', _ANALYSIS_RESPONSES, None),
    'edges': ('pages', _EDGES, None),
    'shaped_pages': ('pages', _SHAPED_PAGES, None),
    'stored_actions': ('orders', _STORED_ACTIONS, None),
    'changes': ('events', _CHANGES, None),
}

_TYPES = {"long": "BIGINT", "int": "INT", "string": "STRING", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _cast(kind: str, expression: str) -> str:
    return f"CAST({expression} AS {_TYPES[kind]})" if kind in _TYPES else expression


def _spark(expression: str) -> str:
    """Literals without a time zone, like the timestamps of the driver tables."""
    return expression.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the driver table it is derived from."""
    source, columns, where = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    rows = rows.where(where) if where else rows
    return rows.selectExpr(*[f"{_cast(kind, _spark(e))} AS {c}" for c, kind, e in columns])


def view_sql(name: str) -> str:
    """The same view as a SELECT for the oracle."""
    source, columns, where = VIEWS[name]
    body = ", ".join(f"{_cast(kind, e)} AS {c}" for c, kind, e in columns)
    return f"SELECT {body} FROM {source}" + (f" WHERE {where}" if where else "")


def with_views(*names: str) -> str:
    """A WITH clause of the views, named as they are."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names) + "\n"
