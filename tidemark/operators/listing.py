"""Reading the state tables: work queues, the faceted listing, counters and look-ups.

Filters are appended only where asked for, so they reach the scan; ranked reads are an order and a
limit, which Spark runs as one top-k; counters are one pass of conditional counts. Every order ends
with the id, so pages are stable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.logic import after, is_false, is_true, moment, not_false, null_or_not, start_of_day

OPEN = ("none", "interested")
TERMINAL = ("entered", "ignored", "won", "lost")
WANTED_RANK = "CASE WHEN wanted_prize THEN 0 WHEN wanted_prize IS NULL THEN 1 ELSE 2 END"


def region_ok() -> Column:
    return is_true(F.col("eligible_france")) | F.col("france_eligibility").eqNullSafe(F.lit("eligible"))


def in_inbox() -> Column:
    """Open, active, wanted, open to the region, acceptable to enter and not gone."""
    c = F.col
    return c("manual_status").isin(*OPEN) & (c("status") == "active") & is_true(c("wanted_prize")) & region_ok() & is_true(c("entry_acceptable")) & null_or_not(c("entry_url_status"), "gone")


def with_source(rows: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """Adds the source's name, and whether a reminder is due. Sources are a table of sites; Spark picks the join by its size."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    due = F.col("remind_at").isNotNull() & (F.col("remind_at") <= moment(now))
    return rows.join(names, "source_id", "left").withColumn("reminder_due", due)


def due_sources(sources: DataFrame, now: str) -> DataFrame:
    """Enabled sources that were never scheduled or are due, unscheduled ones first."""
    at = F.col("next_crawl_at")
    return sources.where(F.col("enabled") & (at.isNull() | (at <= moment(now)))).orderBy(at.asc_nulls_first(), "name", "id")


def list_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Sources by name; enabled ones first, or alone."""
    return sources.where("enabled").orderBy("name", "id") if enabled_only else sources.orderBy(F.col("enabled").desc(), "name", "id")


def is_pending() -> Column:
    """Whether an analysis still waits for a row."""
    return F.col("analyzed_at").isNull() & (F.col("status") == "candidate") & ~F.col("manual_status").isin(*TERMINAL)


def pending(state: DataFrame, include_analyzed: bool = False, manual_gate: bool = True) -> DataFrame:
    """Rows an analysis still waits for; without ``manual_gate`` the user's terminal decisions don't count."""
    if include_analyzed:
        return state
    rows = state.where("analyzed_at IS NULL AND status = 'candidate'")
    return rows.where(~F.col("manual_status").isin(*TERMINAL)) if manual_gate else rows


def narrowed(rows: DataFrame, exclude: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Rows whose id is not in ``exclude`` and is in ``only``, where given."""
    rows = rows.join(exclude.select("id"), "id", "left_anti") if exclude is not None else rows
    return rows.join(only.select("id"), "id", "left_semi") if only is not None else rows


def analysis_queue(state: DataFrame, limit: int = 100, include_analyzed: bool = False, exclude: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    rows = narrowed(pending(state, include_analyzed), exclude, only)
    return rows.orderBy(F.expr(WANTED_RANK), F.coalesce("prize_priority", F.lit(40)).desc(), "discovered_at", "id").limit(limit)


def pending_count(state: DataFrame, include_analyzed: bool = False) -> DataFrame:
    """Rows in the analysis queue, and by the looser rule that leaves the user's decisions out."""
    loose = pending(state, include_analyzed, manual_gate=False)
    own = F.count_if(~F.col("manual_status").isin(*TERMINAL)) if not include_analyzed else F.count(F.lit(1))
    return loose.agg(own.alias("pending"), F.count(F.lit(1)).alias("pending_any_status"))


def link_check_queue(state: DataFrame, limit: int = 50, only_unchecked: bool = False, exclude: DataFrame | None = None) -> DataFrame:
    c = F.col
    rows = state.where(c("entry_url").isNotNull() | c("canonical_url").isNotNull()).where(c("status").isin("candidate", "active", "uncertain"))
    rows = rows.where(c("entry_url_status").isNull() | c("entry_url_status").isin("unknown", "temporary_error", "blocked") | c("entry_checked_at").isNull())
    rows = rows.where(c("entry_checked_at").isNull() | c("entry_url_status").isNull()) if only_unchecked else rows
    return narrowed(rows, exclude).orderBy(c("entry_checked_at").asc_nulls_first(), "discovered_at", "id").limit(limit)


def verdict_backfill_queue(state: DataFrame, limit: int = 500, force: bool = False) -> DataFrame:
    return (state if force else state.where("entry_acceptable IS NULL")).orderBy(F.col("discovered_at").desc(), "id").limit(limit)


def rejection_review_queue(state: DataFrame, limit: int = 500) -> DataFrame:
    why = F.col("entry_rejection_reason")
    public = is_true(F.col("requires_public_social_action")) | why.ilike("%public social%") | why.ilike("%social-media%")
    return state.where(is_false(F.col("entry_acceptable")) & public).orderBy(F.col("updated_at").desc_nulls_last(), F.col("discovered_at").desc(), "id").limit(limit)


def platform_queue(state: DataFrame, platform: str, limit: int = 20, manual_statuses: tuple[str, ...] = ("interested", "none"), region_gate: bool = False, verdict_gate: bool = True, only: DataFrame | None = None) -> DataFrame:
    c = F.col
    rows = state.where(c("platform") == platform).where(c("manual_status").isin(*manual_statuses))
    rows = rows.where(c("entry_url").isNotNull() | c("platform_campaign_id").isNotNull()).where(null_or_not(c("entry_url_status"), "gone")).where(~c("status").isin("expired", "rejected"))
    rows = rows.where(not_false(c("entry_acceptable"))) if verdict_gate else rows
    rows = rows.where(region_ok()) if region_gate else rows
    rank = F.when(c("manual_status") == "interested", 0).otherwise(1)
    return narrowed(rows, None, only).orderBy(rank, F.coalesce("prize_priority", F.lit(0)).desc(), c("last_seen_at").desc_nulls_last(), c("discovered_at").desc_nulls_last(), "id").limit(limit)


def latest_by(state: DataFrame, *keys: str) -> DataFrame:
    """The row of each key that was seen last; rows with a null in the key are no candidates."""
    last = Window.partitionBy(*keys).orderBy(F.col("last_seen_at").desc_nulls_last(), F.col("id").desc())
    known = state.dropna(subset=list(keys))
    return known.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def provenance_of(provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """Sightings with their source's name, in the order they began."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return provenance.join(names, "source_id", "left").orderBy("giveaway_id", "first_seen_at", "source_id")


def overview_stats(state: DataFrame, now: str) -> DataFrame:
    """The dashboard's counters in one pass."""
    c = F.col
    opened = c("manual_status").isin(*OPEN)
    ending = lambda span: (c("status") == "active") & opened & (c("end_at") >= moment(now)) & (c("end_at") <= after(now, span))
    counts = {
        "inbox": in_inbox(),
        "interested": in_inbox() & (c("manual_status") == "interested"),
        "active": in_inbox(),
        "region_eligible": region_ok() & opened,
        "free_entry": is_true(c("free_entry")) & opened,
        "ending_24h": ending("24 HOURS"),
        "ending_7d": ending("7 DAYS"),
        "discovered_today": (c("discovered_at") >= start_of_day(now)) & opened,
        "reminders_due": (c("remind_at") <= moment(now)) & (c("manual_status") != "ignored"),
        "entered": c("manual_status") == "entered",
        "won": c("manual_status") == "won",
        "ignored": c("manual_status") == "ignored",
    }
    return state.agg(*[F.count_if(v).alias(k) for k, v in counts.items()])


def collector_stats(state: DataFrame, sources: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """Counters over the three tables; each is one row, so joining them pairs nothing out."""
    today = start_of_day(now)
    model = F.coalesce(F.get_json_object("analysis_json", "$._meta.model"), F.lit(""))
    a = sources.agg(F.count_if("enabled").alias("enabled_sources"), F.lit(1).alias("_k"))
    b = state.agg(
        F.count(F.lit(1)).alias("total_giveaways"),
        F.count_if(F.col("status") == "active").alias("active_giveaways"),
        F.count_if(is_true(F.col("free_entry"))).alias("free_giveaways"),
        F.count_if(is_true(F.col("eligible_france"))).alias("region_eligible_giveaways"),
        F.count_if(F.col("discovered_at") >= today).alias("giveaways_discovered_today"),
        F.count_if((F.col("analyzed_at") >= today) & (model != "")).alias("analyses_today"),
        F.lit(1).alias("_k"),
    )
    r = runs.agg(
        F.coalesce(F.sum(F.when(F.col("started_at") >= today, F.col("pages_fetched"))), F.lit(0)).alias("pages_crawled_today"),
        F.coalesce(F.sum(F.when(F.col("started_at") >= after(now, "-24 HOURS"), F.col("errors_count"))), F.lit(0)).alias("errors_last_24h"),
        F.lit(1).alias("_k"),
    )
    return a.join(b, "_k").join(r, "_k").drop("_k")


def recent(state: DataFrame, sources: DataFrame, now: str, n: int = 8) -> DataFrame:
    """The newest rows of the inbox; the top-k precedes the join."""
    return with_source(state.where(in_inbox()).orderBy(F.col("discovered_at").desc(), "id").limit(n), sources, now)


def ending_soon(state: DataFrame, sources: DataFrame, now: str, n: int = 8) -> DataFrame:
    c = F.col
    rows = state.where((c("end_at") >= moment(now)) & c("status").isin("active", "candidate", "uncertain") & c("manual_status").isin(*OPEN))
    return with_source(rows.orderBy("end_at", "id").limit(n), sources, now)


@dataclass(frozen=True)
class Filters:
    """Facets of the listing; the defaults are the inbox page's own."""

    view: str = "inbox"
    status: str = "all"
    sort: str = "priority"
    limit: int = 50
    offset: int = 0
    search: str | None = None
    region: bool = False
    show_unknown_region: bool = False
    show_ineligible: bool = False
    free: bool = False
    wanted_only: bool = False
    show_unwanted: bool = False
    acceptable_only: bool = True
    public_social_required: bool = False
    rejection_reason: str | None = None
    hide_gone: bool = True
    prize_category: str | None = None
    entry_method: str | None = None
    source_id: int | None = None
    manual_status: str | None = None
    ending_soon: bool = False
    reminders_due: bool = False
    has_reminder: bool = False
    min_value: float | None = None


def listing_filter(f: Filters, now: str) -> list[Column]:
    """The active facets as predicates."""
    c = F.col
    views = {
        "inbox": c("manual_status").isin(*OPEN),
        "interested": c("manual_status") == "interested",
        "entered": c("manual_status") == "entered",
        "ignored": c("manual_status") == "ignored",
        "history": c("manual_status").isin(*TERMINAL) | (c("status") == "expired"),
    }
    text = f.search.strip() if f.search else None
    reason = f.rejection_reason.strip() if f.rejection_reason else None
    searched = [c(x).ilike(f"%{text}%") for x in ("title", "prize", "domain", "canonical_url")] if text else [F.lit(True)]
    any_of = searched[0]
    for x in searched[1:]:
        any_of = any_of | x
    choices = [
        (f.view in views, views.get(f.view)),
        (f.status in ("active", "expired"), c("status") == f.status),
        (f.region and not f.show_unknown_region and not f.show_ineligible, region_ok()),
        (f.show_unknown_region, (c("france_eligibility") == "unknown") | (c("france_eligibility").isNull() & c("eligible_france").isNull())),
        (f.show_ineligible, (c("france_eligibility") == "ineligible") | is_false(c("eligible_france"))),
        (f.free, is_true(c("free_entry"))),
        (f.wanted_only and not f.show_unwanted, is_true(c("wanted_prize"))),
        (f.show_unwanted, is_false(c("wanted_prize"))),
        (f.acceptable_only, not_false(c("entry_acceptable"))),
        (f.public_social_required, is_true(c("requires_public_social_action"))),
        (bool(reason), c("entry_rejection_reason").ilike(reason or "")),
        (f.hide_gone, null_or_not(c("entry_url_status"), "gone")),
        (f.prize_category not in (None, "all"), c("prize_category") == f.prize_category),
        (bool(f.entry_method), c("entry_method") == f.entry_method),
        (f.source_id is not None, c("source_id") == f.source_id),
        (f.manual_status not in (None, "all"), c("manual_status") == f.manual_status),
        (f.ending_soon, (c("end_at") >= moment(now)) & (c("end_at") <= after(now, "7 DAYS"))),
        (f.reminders_due, c("remind_at") <= moment(now)),
        (f.has_reminder, c("remind_at").isNotNull()),
        (f.min_value is not None, c("prize_value_eur") >= f.min_value),
        (bool(text), any_of),
    ]
    return [p for active, p in choices if active]


def listing_order(sort: str) -> list[Column]:
    newest = F.col("discovered_at").desc()
    orders = {
        "ending_soon": [F.col("end_at").asc_nulls_last()],
        "remind_at": [F.col("remind_at").asc_nulls_last()],
        "highest_value": [F.col("prize_value_eur").desc_nulls_last(), newest],
        "highest_confidence": [F.col("confidence").desc_nulls_last(), newest],
        "newest": [newest],
        "priority": [F.expr(WANTED_RANK), F.col("prize_priority").desc_nulls_last(), newest],
    }
    return [*orders.get(sort, orders["priority"]), F.col("id")]


def list_giveaways(state: DataFrame, sources: DataFrame, now: str, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """A page of the listing with ``source_name``, ``reminder_due`` and ``total``, the count of all matches.

    The total is a grouped count joined to the page's rows, not a window over all rows on one task.
    """
    rows = state
    for p in listing_filter(filters, now):
        rows = rows.where(p)
    limit, offset = min(max(filters.limit, 1), 200), max(filters.offset, 0)
    page = rows.orderBy(*listing_order(filters.sort)).offset(offset).limit(limit)
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("_k"))
    return with_source(page, sources, now).withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")


def list_runs(runs: DataFrame, sources: DataFrame, n: int = 50) -> DataFrame:
    """The latest runs with their source's name and length in seconds."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    last = runs.orderBy(F.col("started_at").desc(), "id").limit(n)
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    return last.join(names, "source_id", "left").withColumn("duration_seconds", seconds)


def entry_methods(state: DataFrame) -> DataFrame:
    return state.select("entry_method").where("entry_method <> ''").distinct().orderBy("entry_method")


def status_counts(state: DataFrame, now: str) -> DataFrame:
    due = (F.col("remind_at") <= moment(now)) & (F.col("manual_status") != "ignored")
    return state.agg(F.count_if(due).alias("reminders_due"), F.count_if(F.col("manual_status") == "ignored").alias("ignored"))


def source_summary(candidates: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Per source: eligibility, wanted prizes, public actions, dead links, duplicates, and what would be kept."""
    c = F.col
    key = F.coalesce(F.concat(F.lit("p:"), "platform", F.lit(":"), "platform_campaign_id"), F.concat(F.lit("u:"), "canonical_url"))
    eligible = region_ok()
    keep = (c("confidence") >= threshold) & ~c("status").isin("rejected", "expired") & not_false(c("wanted_prize")) & null_or_not(c("france_eligibility"), "ineligible")
    return candidates.withColumn("_key", key).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(~eligible & ((c("france_eligibility") == "ineligible") | is_false(c("eligible_france")))).alias("ineligible"),
        F.count_if(is_true(c("wanted_prize"))).alias("wanted"),
        F.count_if(is_false(c("wanted_prize"))).alias("unwanted"),
        F.count_if(is_true(c("requires_public_social_action"))).alias("public_required"),
        F.count_if(c("entry_url_status") == "gone").alias("dead"),
        (F.count(F.lit(1)) - F.countDistinct("_key")).alias("duplicates"),
        F.count_if(keep).alias("would_keep"),
    )


def pipeline_summary(items: DataFrame, outcome: str = "status") -> DataFrame:
    """Rows of each outcome of a batch or run."""
    return items.groupBy(F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def display_flags(state: DataFrame, now: str) -> DataFrame:
    """Badges of a row: public action required or optional, ending within a week, reminder due, hours to the end."""
    c = F.col
    public = F.when(is_true(c("requires_public_social_action")), F.lit("public_required")).when(is_false(c("requires_public_social_action")), F.lit("private")).otherwise(F.lit("unknown"))
    ends = F.coalesce((c("end_at") >= moment(now)) & (c("end_at") <= after(now, "7 DAYS")), F.lit(False))
    due = F.coalesce((c("remind_at") <= moment(now)) & (c("manual_status") != "ignored"), F.lit(False))
    hours = F.floor(F.timestamp_diff("SECOND", moment(now), c("end_at")) / 3600).cast("long")
    return state.select("id", public.alias("entry_badge"), ends.alias("ends_within_week"), due.alias("reminder_due"), hours.alias("hours_left"))


def entry_url_of(state: DataFrame, classic: str, platform: str = "gleam") -> DataFrame:
    """Adds ``entry``: the stored entry URL, else the classic form for the platform's campaign, else the page itself."""
    before, rest = classic.split("{platform}")
    between, after_ = rest.split("{key}")
    built = F.when(F.col("platform_campaign_id").isNotNull(), F.concat(F.lit(before), F.coalesce("platform", F.lit(platform)), F.lit(between), F.col("platform_campaign_id"), F.lit(after_)))
    return state.withColumn("entry", F.coalesce("entry_url", built, "canonical_url"))
