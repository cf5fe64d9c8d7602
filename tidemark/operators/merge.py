"""Merging sightings, checks, analyses and the user's changes into the state tables.

Each is DataFrame in, DataFrame out: a grouped fold of the events, then one equality join with the
state. Folds are conditional aggregates over the events after a key's last reset, so that a busy
key is pre-aggregated and never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.acceptability import merge_verdict, verdict
from tidemark.functions.logic import is_false, is_true, let, moment
from tidemark.operators.listing import latest_by
from tidemark.sources.snapshots import settled

# Minutes of the first back-off step and of the longest one.
BACKOFF_MINUTES, BACKOFF_MOST = 15, 360
MANUAL_STATUSES = ("none", "interested", "entered", "ignored", "won", "lost")


def fold_after_reset(events: DataFrame, key: str, order: list[str], reset: Column, counts: Column, *last: str) -> DataFrame:
    """Per key: ``streak``, the events with ``counts`` after the last with ``reset``, and the ``last`` columns of the latest event."""
    at = F.struct(*order)
    marked = events.withColumns({"_at": at, "_reset": reset, "_counts": counts})
    resets = marked.where("_reset").groupBy(key).agg(F.max("_at").alias("_from"))
    since = marked.join(resets, key, "left")
    open_ = F.col("_from").isNull() | (F.col("_at") > F.col("_from"))
    return since.groupBy(key).agg(F.count_if(F.col("_counts") & open_).alias("streak"), F.max_by(F.struct(*last), F.col("_at")).alias("_last")).select(key, "streak", "_last.*")


def link_outcome(http_status: Column) -> Column:
    """live, gone, blocked, temporary_error or unknown, from an HTTP status; none at all is a temporary error."""
    s = http_status
    return (
        F.when(s.isNull() | (s == 429) | s.between(500, 599), "temporary_error")
        .when(s.between(200, 399), "live")
        .when(s.isin(404, 410), "gone")
        .when(s.isin(401, 403), "blocked")
        .otherwise("unknown")
    )


def fold_link_checks(checks: DataFrame) -> DataFrame:
    """Per giveaway: failures since the last live check, the latest outcome and its time, and whether any check found it gone.

    Blocked and unknown checks neither add to the count nor reset it.
    """
    c = checks.withColumn("entry_url_status", link_outcome(F.col("http_status")))
    o = F.col("entry_url_status")
    folded = fold_after_reset(c, "giveaway_id", ["checked_at", "check_id"], o == "live", o.isin("temporary_error", "gone"), "entry_url_status", "checked_at")
    gone = c.groupBy("giveaway_id").agg(F.max(F.col("entry_url_status") == "gone").alias("rejected"))
    return folded.join(gone, "giveaway_id").select("giveaway_id", F.col("streak").alias("entry_check_fail_count"), "entry_url_status", F.col("checked_at").alias("entry_checked_at"), "rejected")


def backoff_minutes(failures: Column) -> Column:
    """15 minutes doubling to 360; none without failures."""
    steps = F.lit(BACKOFF_MINUTES) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(20)))
    return F.when(failures > 0, F.least(steps, F.lit(float(BACKOFF_MOST)))).otherwise(0.0).cast("long")


def fold_crawl_runs(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with ``consecutive_failures`` and the next crawl: after the interval, or after the back-off of a failing source. Sources without runs stay as they are."""
    folded = fold_after_reset(runs, "source_id", ["started_at", "id"], ~F.col("failed"), F.col("failed"), "started_at")
    folded = folded.select(F.col("source_id").alias("id"), F.col("streak").alias("_n"), F.col("started_at").alias("_at"))
    wait = F.when(F.col("_n") > 0, backoff_minutes(F.col("_n"))).otherwise(F.col("crawl_interval_minutes").cast("long"))
    then = F.col("_at") + F.make_dt_interval(mins=wait.cast("int"))
    out = sources.join(folded, "id", "left").withColumns({"consecutive_failures": F.coalesce("_n", F.lit(0).cast("long")), "next_crawl_at": F.coalesce(then, "next_crawl_at")})
    return out.drop("_n", "_at")


def run_status(runs: DataFrame) -> DataFrame:
    """failed: errors, no pages and no candidates; partial: errors and candidates; else success."""
    c = F.col
    status = F.when((c("errors_count") > 0) & (c("pages_fetched") == 0) & (c("candidates_found") == 0), "failed").when((c("errors_count") > 0) & (c("candidates_found") > 0), "partial").otherwise("success")
    return runs.withColumn("status", status)


def reset_schedule(sources: DataFrame, now: str) -> DataFrame:
    """Enabled sources are due now, and their failures are forgotten."""
    out = sources.withColumn("next_crawl_at", F.when(F.col("enabled"), moment(now)).otherwise(F.col("next_crawl_at")))
    if "consecutive_failures" not in sources.columns:
        return out
    return out.withColumn("consecutive_failures", F.when(F.col("enabled"), F.lit(0)).otherwise(F.col("consecutive_failures")).cast("long"))


def last_change(changes: DataFrame, value: Column, valid: Column) -> DataFrame:
    """Per giveaway the latest valid change: its ``value`` and ``changed_at``."""
    at = F.struct("changed_at", "change_id")
    return changes.where(F.coalesce(valid, F.lit(False))).groupBy("giveaway_id").agg(F.max_by(F.struct(value.alias("value"), F.col("changed_at")), at).alias("_c")).select(F.col("giveaway_id").alias("id"), F.col("_c.value").alias("_value"), F.col("_c.changed_at").alias("_changed_at"))


def set_manual_status(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The user's latest valid status, with the time of the change; other values are ignored."""
    last = last_change(changes, F.col("manual_status"), F.col("manual_status").isin(*MANUAL_STATUSES))
    out = state.join(last, "id", "left")
    return out.withColumns({"manual_status": F.coalesce("_value", "manual_status"), "manual_status_at": F.col("_changed_at")}).drop("_value", "_changed_at")


def apply_reminders(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A reminder some whole hours after the change, 1 to 720; null hours clear it; other values are ignored (:data:`tidemark.operators.rules.REMINDERS` quarantines them)."""
    hours = F.floor("hours").cast("int")
    last = last_change(changes, hours, F.col("hours").isNull() | hours.between(1, 720))
    out = state.join(last, "id", "left")
    at = F.when(F.col("_changed_at").isNull(), F.col("remind_at")).when(F.col("_value").isNull(), F.lit(None)).otherwise(F.col("_changed_at") + F.make_dt_interval(hours=F.col("_value")))
    return out.withColumn("remind_at", at).drop("_value", "_changed_at")


def source_settings(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Sources after ``changes(id, change_id, changed_at, interval_minutes[, enabled])``: the latest interval, floored, of at least five minutes, and the latest switch on or off."""
    at, c = F.struct("changed_at", "change_id"), F.col
    on = c("enabled") if "enabled" in changes.columns else F.lit(None).cast("boolean")
    minutes = F.when(c("interval_minutes") >= 5, F.floor("interval_minutes").cast("int"))
    last = changes.groupBy("id").agg(F.max_by(minutes, F.when(minutes.isNotNull(), at)).alias("_m"), F.max_by(on, F.when(on.isNotNull(), at)).alias("_on"))
    return sources.join(last, "id", "left").withColumns({"crawl_interval_minutes": F.coalesce("_m", "crawl_interval_minutes"), "enabled": F.coalesce("_on", "enabled")}).drop("_m", "_on")


def merge_provenance(provenance: DataFrame, sightings: DataFrame) -> DataFrame:
    """Sightings per (giveaway, source): first and last time, and the URL of the latest sighting that has one."""
    both = provenance.unionByName(sightings.select("giveaway_id", "source_id", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), "url"))
    url = F.max_by("url", F.when(F.col("url").isNotNull(), F.struct("last_seen_at", "url")))
    return both.groupBy("giveaway_id", "source_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), url.alias("url"))


def reconcile_batch(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request and every unknown response with its outcome: clean, duplicate, missing or unknown, and the number of responses.

    An id that was answered more than once is not applied.
    """
    found = responses.groupBy("giveaway_id").agg(F.count(F.lit(1)).alias("responses"))
    asked = requests.select(F.col("id").alias("giveaway_id")).withColumn("_asked", F.lit(True))
    both = asked.join(found, "giveaway_id", "full")
    outcome = F.when(F.col("_asked").isNull(), "unknown").when(F.col("responses").isNull(), "missing").when(F.col("responses") > 1, "duplicate").otherwise("clean")
    return both.select("giveaway_id", outcome.alias("outcome"), F.coalesce("responses", F.lit(0).cast("long")).alias("responses"))


#: Hosts whose entry URLs identify an offer wherever it is seen.
STRONG_ENTRY_HOST = r"(^|\.)(gleam\.io|sweepwidget\.com)$"


def strong_entry(entry_url: Column) -> Column:
    """The canonical entry URL if its host is one that identifies offers, else null. Only URLs that name such a host are brought into canonical form."""
    canonical = let(F.coalesce(urls.canonical_url(entry_url), F.trim(entry_url)), lambda u: F.when(urls.url_domain(u).rlike(STRONG_ENTRY_HOST), u))
    return F.when(entry_url.rlike(r"(?i)gleam\.io|sweepwidget\.com"), canonical)


def _identity_keys(canonical: Column, platform: Column, campaign: Column, entry_url: Column) -> Column:
    """What identifies an offer, as (rank, key): its URL, its platform's key, its strong entry URL."""
    key = lambda rank, k: F.struct(F.lit(rank).alias("rank"), k.alias("key"))
    by_platform = F.when(platform.isNotNull() & campaign.isNotNull(), F.concat_ws("\1", platform, campaign))
    return F.filter(F.array(key(0, canonical), key(1, by_platform), key(2, strong_entry(entry_url))), lambda x: x["key"].isNotNull())


WAYS = ("url", "platform", "entry")


def resolve_identity(batch: DataFrame, state: DataFrame, ordinal: str = "ordinal", seen_at: str = "seen_at") -> DataFrame:
    """``batch`` with ``giveaway_id`` and ``matched_by``: url, platform (the row seen last), entry (a strong host's; the row analysed, then seen last), batch or new.

    A row that matches nothing in the state takes the identity of the batch's first row of its
    platform key, else of its strong entry URL, and is matched by batch; else it is new. A new row's
    id is a hash of its URL, so that reruns agree and rows of one URL are one offer.

    The state's keys are one grouped maximum, which the batch's keys meet in one join; a key's rows
    are never gathered. The batch and two narrow tables of its rows are stored on the way, so each
    step reads what the last one made.
    """
    c, long_ago = F.col, F.lit("0001-01-01").cast("timestamp_ntz")
    rows = batch.select("*", F.monotonically_increasing_id().alias("_row"), F.struct(seen_at, ordinal).alias("_at"), F.abs(F.xxhash64("canonical_url")).alias("_own"), _identity_keys(c("canonical_url"), c("platform"), c("platform_campaign_id"), c("entry_url")).alias("_keys"))
    rows = settled(rows)
    known = state.select("id", "last_seen_at", "analyzed_at", F.inline(_identity_keys(c("canonical_url"), c("platform"), c("platform_campaign_id"), c("entry_url"))))
    newest = F.struct(F.when(c("rank") == 2, F.coalesce("analyzed_at", long_ago)).otherwise(long_ago), F.coalesce("last_seen_at", long_ago), "id")
    known = known.groupBy("rank", "key").agg(F.max_by("id", newest).alias("_id"))
    asked = rows.select("_row", F.inline("_keys")).join(known, ["rank", "key"])
    best = asked.groupBy("_row").agg(F.min_by(F.struct("_id", "rank"), "rank").alias("_best"))
    key = lambda rank: F.get(F.filter("_keys", lambda x: x["rank"] == rank), F.lit(0))["key"]
    found = settled(rows.select("_row", "_at", "_own", key(1).alias("_key"), key(2).alias("_entry")).join(best, "_row", "left").select("_row", "_at", "_own", "_key", "_entry", "_best._id", "_best.rank"))

    def lent(rows_: DataFrame, by: str, mine: Column) -> DataFrame:
        """Rows with the identity of the first row of their key; rows without a key stay apart."""
        first = rows_.where(c(by).isNotNull()).groupBy(by).agg(F.min_by(mine, c("_at")).alias("_lent"))
        return rows_.where(c(by).isNotNull()).join(first, by).unionByName(rows_.where(c(by).isNull()).withColumn("_lent", F.lit(None).cast("long")))

    # Rows that the state does not know meet by platform key, then by entry URL; rows that it knows lend their ids.
    met = settled(lent(found, "_key", F.coalesce("_id", "_own")).withColumn("_mine", F.coalesce("_id", "_lent", "_own")).drop("_lent"))
    given = lent(met, "_entry", c("_mine"))
    settled_id = F.when(c("_id").isNotNull() | (c("_mine") != c("_own")), c("_mine")).otherwise(F.coalesce("_lent", "_mine"))
    way = F.coalesce(*[F.when(c("rank") == i, name) for i, name in enumerate(WAYS)])
    how = F.coalesce(way, F.when(settled_id == c("_own"), "new").otherwise("batch"))
    ids = given.select("_row", settled_id.alias("giveaway_id"), how.alias("matched_by"))
    return rows.join(ids, "_row").select(*batch.columns, "giveaway_id", "matched_by")


#: How a column of an existing row takes sightings' values, one after the other. Columns that are not listed are never touched.
POLICIES = {
    "replace": ("original_url", "last_seen_at", "content_hash"),
    "first": ("source_id", "platform", "platform_campaign_id"),
    "fill_or_changed": ("title", "description", "raw_excerpt"),
    "new_if_changed": ("link_hints",),
    "new_else_old": ("entry_url", "terms_url", "start_at", "end_at"),
    "keep_once_analyzed": ("prize", "prize_value_eur", "prize_category", "prize_priority", "preference_reason", "requires_travel", "requires_additional_spend", "free_entry", "eligibility_reason", "requires_purchase", "requires_social", "entry_method", "entry_friction", "geo_restriction"),
    "frozen_once_analyzed": ("wanted_prize", "eligible_france", "france_eligibility", "requires_public_social_action", "entry_acceptable", "entry_rejection_reason"),
}
_POLICY = {c: p for p, columns in POLICIES.items() for c in columns} | {"status": "status"}
OVER = ("rejected", "expired")


def _usable(policy: str, c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False)) if policy == "new_if_changed" else c.isNotNull()


def fold_sightings(resolved: DataFrame, ordinal: str = "ordinal", seen_at: str = "seen_at") -> DataFrame:
    """One row for each ``giveaway_id`` with, for each column, a struct of what merging its sightings in order comes down to.

    ``one`` is the first sighting's value, ``first`` and ``last`` the first and last known ones,
    ``changed`` the last known one of a sighting whose content differs from that of the sighting
    before it, and ``over`` the last status that rejects or expires. A sighting is compared with the
    one before it in a window over its offer, which is sorted and may spill; all else is a grouped
    aggregate on the same partitioning.
    """
    c = F.col
    in_order = Window.partitionBy("giveaway_id").orderBy(seen_at, ordinal)
    rows = resolved.withColumns({"_at": F.struct(seen_at, ordinal), "_nth": F.row_number().over(in_order), "_before": F.lag("content_hash").over(in_order)})
    rows = rows.withColumn("_changed", (c("_nth") > 1) & ~c("_before").eqNullSafe(c("content_hash")))
    out = []
    for name in [x for x in resolved.columns if x != "giveaway_id"]:
        policy, value, at = _POLICY.get(name, "one"), c(name), c("_at")
        parts = {"one": F.min_by(value, at)}
        if policy in ("first", "keep_once_analyzed", "fill_or_changed"):
            parts["first"] = F.min_by(value, F.when(value.isNotNull(), at))
        if policy in ("replace", "new_else_old", "keep_once_analyzed", "frozen_once_analyzed") or name == seen_at:
            parts["last"] = F.max_by(value, F.when(value.isNotNull(), at))
        if policy in ("fill_or_changed", "new_if_changed"):
            parts["changed"] = F.max_by(value, F.when(c("_changed") & _usable(policy, value), at))
        if policy == "status":
            parts["over"] = F.max_by(value, F.when(value.isin(*OVER), at))
        out.append(F.struct(*[v.alias(k) for k, v in parts.items()]).alias(name))
    return rows.groupBy("giveaway_id").agg(*out)


def _merged(policy: str, s: Column, old: Column, known: Column, changed: Column, analyzed: Column) -> Column:
    """A column's value after its sightings ``s`` (:func:`fold_sightings`): over the state's row, or from the first sighting on where there is none."""
    if policy == "replace" or policy == "new_else_old":
        return F.coalesce(s["last"], old)
    if policy == "first":
        return F.coalesce(old, s["first"])
    if policy == "fill_or_changed":
        return F.coalesce(s["changed"], F.when(changed | ~known, s["one"]), old, s["first"])
    if policy == "new_if_changed":
        return F.coalesce(s["changed"], F.when(changed & _usable(policy, s["one"]), s["one"]), F.when(known, old).otherwise(s["one"]))
    if policy == "keep_once_analyzed":
        return F.when(analyzed, F.coalesce(old, s["first"])).otherwise(F.coalesce(s["last"], old))
    if policy == "frozen_once_analyzed":
        return F.when(analyzed, old).otherwise(F.coalesce(s["last"], old))
    if policy == "status":
        return F.when(analyzed, old).otherwise(F.coalesce(s["over"], F.when(known, old).otherwise(s["one"])))
    return F.when(known, old).otherwise(s["one"])


def merge_crawl(state: DataFrame, resolved: DataFrame, ordinal: str = "ordinal", seen_at: str = "seen_at") -> DataFrame:
    """State rows after a batch of resolved sightings, as if each had been merged alone, in order of (seen_at, ordinal): one fold, then a full join on the id.

    Sightings of ids that the state lacks become new rows, whose URL and discovery are the first
    one's. A status leaves candidate only for rejected or expired, and only before an analysis. The
    user's columns are never touched. Ids stay unique.
    """
    c = F.col
    folded = fold_sightings(resolved, ordinal, seen_at)
    names = {x: c(x) for x in folded.columns if x in state.columns and x != "id"} | {"last_seen_at": c(seen_at)}
    if "discovered_at" not in resolved.columns:
        names["discovered_at"] = c(seen_at)
    new = folded.select(c("giveaway_id").alias("_id"), c("content_hash").alias("_hash"), *[v.alias(f"_n_{x}") for x, v in names.items()])
    both = state.join(new, state["id"] == new["_id"], "full")
    known, seen = c("id").isNotNull(), c("_id").isNotNull()
    analyzed = known & c("analyzed_at").isNotNull()
    changed = known & ~c("_hash.one").eqNullSafe(c("content_hash"))
    out = []
    for x in state.columns:
        if x == "id":
            value = F.coalesce("id", "_id")
        elif x == "manual_status":
            value = F.when(known, c(x)).otherwise("none")
        elif x in names:
            value = F.when(seen, _merged(_POLICY.get(x, "one"), c(f"_n_{x}"), c(x), known, changed, analyzed)).otherwise(c(x))
        else:
            value = c(x)
        out.append(value.alias(x))
    return both.select(*out)


def upsert_outcome(resolved: DataFrame, state: DataFrame) -> DataFrame:
    """Per source of the batch: rows created, updated, with changed content, and still to be analysed."""
    old = state.select(F.col("id").alias("giveaway_id"), F.col("content_hash").alias("_h"), F.col("analyzed_at").alias("_a"))
    both = resolved.join(old, "giveaway_id", "left")
    created = F.col("matched_by") == "new"
    return both.groupBy("source_id").agg(
        F.count_distinct(F.when(created, F.col("giveaway_id"))).alias("created"),
        F.count_if(~created).alias("updated"),
        F.count_if(~created & ~F.col("_h").eqNullSafe(F.col("content_hash"))).alias("hash_changed"),
        F.count_if(created | F.col("_a").isNull()).alias("needs_analysis"),
    )


def analysed_status(is_giveaway: Column, eligibility: Column, wanted: Column, acceptable: Column, end: Column, confidence: Column, gone: Column, public: Column, now: str) -> Column:
    """rejected for what is no offer, whose link is gone, that is not for the region, unwanted or to be entered in public; expired past its end; uncertain where much is unknown; else active."""
    return (
        F.when(~is_true(is_giveaway) | is_true(gone), "rejected")
        .when((eligibility == "ineligible") | is_false(wanted) | is_false(acceptable) | is_true(public), "rejected")
        .when(end < moment(now), "expired")
        .when((F.coalesce(confidence, F.lit(0.0)) < 0.5) | ~eligibility.eqNullSafe(F.lit("eligible")) | acceptable.isNull(), "uncertain")
        .otherwise("active")
    )


def decide_status(analyses: DataFrame, now: str) -> DataFrame:
    """Analyses with the status they lead to; ``entry_url_status`` and ``requires_public_social_action`` are read where they are there."""
    c = F.col
    has = lambda name, test: test(c(name)) if name in analyses.columns else F.lit(False)
    gone, public = has("entry_url_status", lambda x: x == "gone"), has("requires_public_social_action", is_true)
    return analyses.withColumn("status", analysed_status(c("is_giveaway"), c("france_eligibility"), c("wanted_prize"), c("entry_acceptable"), c("end_date"), c("confidence"), gone, public, now))


def apply_analysis(state: DataFrame, analyses: DataFrame, now: str) -> DataFrame:
    """State after the clean analyses: known fields win over the old ones, the verdicts on entering merge, the status is decided, and the analysis is stamped.

    ``analyses(giveaway_id, is_giveaway, france_eligibility, wanted_prize, entry_acceptable, end_date,
    confidence)`` may have requires_public_social_action, entry_rejection_reason and analysis_json too.
    """
    clean = reconcile_batch(state.select("id"), analyses.select("giveaway_id")).where("outcome = 'clean'").select("giveaway_id")
    names = ("is_giveaway", "france_eligibility", "wanted_prize", "entry_acceptable", "end_date", "confidence", "requires_public_social_action", "entry_rejection_reason", "analysis_json")
    types = {"requires_public_social_action": "boolean", "entry_rejection_reason": "string", "analysis_json": "string"}
    given = [F.col(x) if x in analyses.columns else F.lit(None).cast(types[x]) for x in names]
    new = analyses.join(clean, "giveaway_id", "left_semi").select(F.col("giveaway_id").alias("id"), F.lit(True).alias("_hit"), *[v.alias(f"_{x}") for x, v in zip(names, given, strict=True)])
    d, c = state.join(new, "id", "left"), F.col
    hit = is_true(c("_hit"))
    local = verdict(c("requires_public_social_action"), c("entry_acceptable"), c("entry_rejection_reason"))
    d = d.withColumn("_m", merge_verdict(local, c("_requires_public_social_action"), c("_entry_acceptable"), c("_entry_rejection_reason")))
    wanted, end = F.coalesce("_wanted_prize", "wanted_prize"), F.coalesce("_end_date", "end_at")
    gone = c("entry_url_status") == "gone"
    status = analysed_status(c("_is_giveaway"), F.coalesce("_france_eligibility", "france_eligibility"), wanted, c("_m.acceptable"), end, F.coalesce("_confidence", "confidence"), gone, c("_m.requires_public"), now)
    region = F.when(c("_france_eligibility") == "eligible", True).when(c("_france_eligibility") == "ineligible", False)
    merged = {
        "france_eligibility": F.coalesce("_france_eligibility", "france_eligibility"),
        "eligible_france": F.when(c("_france_eligibility").isNotNull(), region).otherwise(c("eligible_france")),
        "wanted_prize": wanted,
        "entry_acceptable": c("_m.acceptable"),
        "requires_public_social_action": c("_m.requires_public"),
        "entry_rejection_reason": c("_m.reason"),
        "end_at": end,
        "confidence": F.coalesce("_confidence", "confidence"),
        "analysis_json": F.coalesce("_analysis_json", "analysis_json"),
        "analyzed_at": moment(now),
        "status": status,
    }
    return d.withColumns({k: F.when(hit, v).otherwise(c(k)) for k, v in merged.items()}).drop("_hit", "_m", *[f"_{x}" for x in names])


def mark_completed(state: DataFrame, results: DataFrame, platform: str) -> DataFrame:
    """``results(key[, url])`` with the row of that campaign that was seen last (null: missing) and the status it gets. A result without a key has the one of its campaign's URL. Keys are compared without case, once each."""
    key = F.nullif(F.trim("key"), F.lit(""))
    if "url" in results.columns:
        who = urls.platform_identity(F.col("url"))
        key = F.coalesce(key, F.when(who["platform"] == platform, who["campaign_id"]))
    keys = results.select(F.lower(key).alias("key")).where("key IS NOT NULL").distinct()
    rows = state.where(F.col("platform") == platform).withColumn("key", F.lower("platform_campaign_id"))
    last = latest_by(rows, "key").select("key", "id")
    return keys.join(last, "key", "left").withColumn("manual_status", F.when(F.col("id").isNotNull(), "entered"))


def purge(state: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and runs without their rows, of the same columns; sources are no part of it."""
    return state.where(F.lit(False)), runs.where(F.lit(False))


def delete_urls(state: DataFrame, gone: DataFrame) -> DataFrame:
    """The state without the offers of the URLs ``gone(url)``, in any form that has the same canonical one."""
    known = gone.select(F.coalesce(urls.canonical_url(F.col("url")), F.trim("url")).alias("canonical_url")).distinct()
    return state.join(known, "canonical_url", "left_anti").select(*state.columns)


def purge_plan(state: DataFrame, runs: DataFrame) -> DataFrame:
    """What a purge would drop."""
    a = state.agg(F.count(F.lit(1)).alias("giveaways"), F.lit(1).alias("_k"))
    return a.join(runs.agg(F.count(F.lit(1)).alias("crawl_runs"), F.lit(1).alias("_k")), "_k").drop("_k")


def backfill_defaults(state: DataFrame) -> DataFrame:
    """Eligibility from the flag where it is missing, and a time for a manual status that has none."""
    c = F.col
    known = F.when(is_true(c("eligible_france")), "eligible").when(is_false(c("eligible_france")), "ineligible").otherwise("unknown")
    at = F.when(c("manual_status") != "none", c("updated_at"))
    return state.withColumns({"france_eligibility": F.coalesce("france_eligibility", known), "manual_status_at": at})


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``failed_rules``: the names of the rules that are false for them, in order; a rule that is null holds."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("failed_rules", broken)


def seed_sources(sources: DataFrame, catalogue: DataFrame, now: str) -> DataFrame:
    """Upsert a catalogue by base URL; new rows are enabled, hourly and due now unless the catalogue says otherwise."""
    new = catalogue.select("base_url", F.col("name").alias("_name"), F.col("enabled").alias("_on"), F.col("crawl_interval_minutes").alias("_every"))
    both = sources.join(new, "base_url", "full")
    return both.select(
        "id",
        F.coalesce("_name", "name").alias("name"),
        "base_url",
        F.coalesce("_on", "enabled", F.lit(True)).alias("enabled"),
        F.coalesce("_every", "crawl_interval_minutes", F.lit(60)).alias("crawl_interval_minutes"),
        F.when(F.col("name").isNull(), moment(now)).otherwise(F.col("next_crawl_at")).alias("next_crawl_at"),
    )


def expand_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """``(source, node, depth)``: what each source reaches over ``edges(src, dst)`` from its seeds ``(source, node)`` within ``max_depth`` links, its nearest ``max_pages`` by (depth, node).

    A round is one join of what the last one found, and an anti-join with all that was found before;
    it is stored, so no round repeats another. Links are read a round and never copied.
    """
    steps = edges.select(F.col("src").alias("node"), "dst").where("dst IS NOT NULL")
    found = settled(seeds.select("source", "node").distinct().withColumn("depth", F.lit(0)))
    newest = found
    for depth in range(1, max_depth + 1):
        reached = newest.join(steps, "node").select("source", F.col("dst").alias("node")).distinct()
        newest = settled(reached.join(found, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
    near = Window.partitionBy("source").orderBy("depth", "node")
    return found.withColumn("at", F.row_number().over(near)).where(F.col("at") <= max_pages).select("source", "node", "depth")
