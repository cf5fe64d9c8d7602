"""From assessed pages to candidates: selection, status, diagnostics, and the funnel of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import acceptability, entry, prizes, scoring
from tidemark.functions.logic import is_true, once

THRESHOLD = 0.45
# Phrases that speak against a page, as diagnostics name them.
NEGATIVE = (
    "concours cloture", "jeu cloture", "termine", "expire", "expired", "ended", "closed", "plus disponible", "resultats des gagnants", "gagnants du concours", "iexpired",
    "this competition has closed", "purchase required", "free spins", "no deposit",
)
#: Answers to "purchase required".
NO, YES = ("no", "false", "0", "n"), ("yes", "true", "1", "y")


def select_candidates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``scored(canonical_url, score, skip, ordinal, ..)`` that reach the threshold (``source_threshold`` where that column has one) and are not skipped; the first of each URL.

    URLs are deduplicated by a grouped minimum, so a URL seen everywhere is pre-aggregated.
    """
    least = F.coalesce("source_threshold", F.lit(threshold)) if "source_threshold" in scored.columns else F.lit(threshold)
    kept = scored.where((F.col("score") >= least) & ~F.coalesce("skip", F.lit(False)) & F.col("canonical_url").isNotNull())
    first = F.struct(*[c for c in kept.columns if c != "canonical_url"])
    return kept.groupBy("canonical_url").agg(F.min_by(first, "ordinal").alias("r")).select("canonical_url", "r.*").select(*scored.columns)


def _answer(c: Column) -> Column:
    return F.trim(scoring.normalize_text(c))


def candidate_status(rows: DataFrame) -> DataFrame:
    """``rows`` with everything that is decided about a candidate before an analysis.

    Reads title, prize, excerpt, restriction, method_text, purchase_text, free_hint, category,
    filter_text, expired, friction_override and platform_says (a verdict or null). Adds friction,
    method, scope, region, free, requires_purchase, requires_social, priority, the prize's columns,
    eligibility, eligibility_reason, entry_verdict, skip_reasons, skip_analyze and status: rejected
    for what speaks against the offer, an ineligible region or a public action that must be done;
    expired for what is over.
    """
    c, n = F.col, scoring.normalize_text
    body = F.coalesce(F.when(F.trim(c("filter_text")) != "", c("filter_text")), c("excerpt"))
    d = once(
        rows,
        {
            "_text": n(F.concat_ws(" ", "method_text", "method_text", body)),
            "_fields": n(F.concat_ws("\n", *[F.when(F.trim(c(x)) != "", c(x)) for x in ("title", "prize", "category")])),
            "_body": n(F.concat_ws(" ", body, "method_text")),
            "_own": n(body),
            "_restriction": n(c("restriction")),
            "_bought": _answer(c("purchase_text")),
            "_method": n(c("method_text")),
        },
    )
    no = c("purchase_text").isNotNull() & c("_bought").isin(*NO)
    d = once(d, {"_f": entry.entry_friction(c("_text"), c("_method")), "scope": entry.geo_scope(c("_restriction")), "region": entry.region_allowed(c("_restriction"))})
    # A stated "no" cancels what reads like a purchase; the next rules decide then.
    plain = F.regexp_replace("_text", f"{entry.HARD[0][0]}|{entry.REQUIRED}", " ")
    d = once(d, {"_g": entry.entry_friction(plain, c("_method"))})
    d = d.withColumns({"friction": F.when(no, c("_g.friction")).otherwise(c("_f.friction")), "method": F.when(no, c("_g.method")).otherwise(c("_f.method"))})
    stated = F.when(c("purchase_text").isNotNull() & c("_bought").isin(*YES), False).when(no, True)
    d = once(d, {"free": F.coalesce("free_hint", stated, entry.free_entry(F.concat_ws(" ", "_bought", "_own")))})
    reasons = entry.undesirable_reasons(c("_fields"), F.concat_ws("\n", "_fields", "_body"))
    d = once(d, {"_said": reasons})
    d = once(
        d.withColumn("_reasons", F.when(no | is_true(c("free_hint")), F.array_remove("_said", "purchase_required")).otherwise(c("_said"))),
        {
            "requires_purchase": F.when((c("free").eqNullSafe(F.lit(False))) | F.arrays_overlap("_reasons", F.array(F.lit("purchase_required"), F.lit("paid_entry"))), True).when(c("free"), False),
            "requires_social": F.when(c("method").isin("instagram", "facebook", "social") | F.array_contains(entry.tags(c("_text"), entry.MEDIUM), "social"), True),
            "friction": F.when(c("friction_override").isin("easy", "medium", "hard", "unknown"), c("friction_override")).otherwise(c("friction")),
        },
    )
    d = d.withColumn("priority", entry.discovery_priority(c("free"), c("friction"), c("region"), c("scope")))
    # Nulls stay null, so that they leave no separator; the excerpt is normalised once for both texts.
    d = once(d, {f"_n_{x}": F.when(c(x).isNotNull(), n(c(x))) for x in ("restriction", "title", "prize", "excerpt")})
    d = prizes.prize_preference(once(d, {"_about": F.concat_ws(" ", "_n_title", "_n_prize", "_n_excerpt")}), c("_about"), prefix="prize_")
    d = once(d, {"_r": entry.region_eligibility(F.concat_ws("\n", "_n_restriction", "_n_title", "_n_prize", "_n_excerpt"), c("_restriction"))})
    local = acceptability.text_verdict(c("title"), c("prize"), c("excerpt"), c("method"))
    d = once(d.withColumns({"eligibility": c("_r.state"), "eligible": c("_r.flag"), "eligibility_reason": c("_r.reason")}), {"entry_verdict": F.coalesce("platform_says", local)})
    over, barred, public = F.coalesce("expired", F.lit(False)), c("eligibility") == "ineligible", c("entry_verdict.acceptable").eqNullSafe(F.lit(False))
    bad = F.size("_reasons") > 0
    more = F.array_compact(F.array(F.when(barred, c("eligibility_reason")), F.when(public, F.coalesce("entry_verdict.reason", F.lit(acceptability.REASON)))))
    d = d.withColumns(
        {
            "skip_reasons": F.array_union("_reasons", more),
            "skip_analyze": bad | over | barred | public,
            "status": F.when(bad | barred | public, "rejected").when(over, "expired").otherwise("candidate"),
        }
    )
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def _phrase(text: Column, phrase: str) -> Column:
    return F.contains(text, F.lit(phrase)) if " " in phrase else scoring.has_word(text, phrase)


def candidate_diagnostics(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rows(score, evidence, title, excerpt, expired, skip_reasons, skip_analyze, ..)`` with positive_signals, negative_signals (twelve at most) and would_analyze."""
    c, e = F.col, F.col("evidence")
    flags = [F.when(e[key], F.lit(label)) for key, label in (("in_url", "url_keyword"), ("in_title", "title_keyword"), ("in_anchor", "anchor_keyword"), ("terms", "terms_link"), ("deadline", "deadline"), ("entry", "entry_language"))]
    counts = [F.when(e[key] > 0, F.concat(F.lit(f"content_{key}_hits="), e[key].cast("string"))) for key in ("strong", "weak")]
    named = F.transform(F.slice(e["matched"], 1, 12), lambda t: F.concat(F.lit("term:"), t))
    positive = F.array_distinct(F.concat(F.array_compact(F.array(*flags, *counts)), named))
    text = scoring.normalize_text(c("excerpt"))
    phrases = [F.when(_phrase(text, p), F.lit(f"phrase:{p}")) for p in NEGATIVE]
    filters = F.transform(F.slice(F.coalesce("skip_reasons", F.array().cast("array<string>")), 1, 8), lambda r: F.concat(F.lit("filter:"), r))
    weak = F.when((F.size(e["matched"]) == 0) & ~e["in_url"], F.lit("weak_evidence"))
    negative = F.concat(F.array_compact(F.array(*phrases, F.when(F.coalesce("expired", F.lit(False)), F.lit("adapter:expired")))), filters, F.array_compact(F.array(weak)))
    full = F.trim(F.coalesce(F.nullif("title", F.lit("")), "excerpt", F.lit(""))) != ""
    would = (c("score") >= threshold) & full & ~F.coalesce("skip_analyze", F.lit(False))
    return rows.withColumns({"positive_signals": positive, "negative_signals": F.slice(F.array_distinct(negative), 1, 12), "would_analyze": would})


def crawl_funnel(pages: DataFrame) -> DataFrame:
    """Per source what became of ``pages(source_id, kind, http_status, links, parse_status, reason, campaign_id, enqueued, filtered_after)``.

    ``kind`` is listing, shell or campaign. The parse rate is the parsed share of what answered,
    else of what was tried. Reasons are the first twenty by name.
    """
    c = F.col
    ok = c("http_status").isNull() | c("http_status").between(200, 299)
    listing, shell, campaign = (c("kind") == k for k in ("listing", "shell", "campaign"))
    parsed = campaign & ok & (c("parse_status") == "ok")
    failed = campaign & ok & (c("parse_status") == "payload_missing")
    out = pages.groupBy("source_id").agg(
        F.count_if(listing).alias("listing_pages"),
        F.coalesce(F.sum(F.when(listing, c("links"))), F.lit(0)).alias("links_discovered"),
        F.coalesce(F.sum(F.when(listing, c("enqueued"))), F.lit(0)).alias("scheduled"),
        F.count_if(shell).alias("shell_pages"),
        F.count_if(campaign).alias("fetched"),
        F.count_if(campaign & ok).alias("http_2xx"),
        F.count_if((campaign | shell) & ~ok).alias("http_errors"),
        F.count_if(parsed & c("campaign_id").isNull()).alias("_anonymous"),
        F.count_if(parsed).alias("_parsed"),
        F.count_distinct(F.when(parsed, c("campaign_id"))).alias("_campaigns"),
        F.count_if(failed).alias("parse_failures"),
        F.count_if(campaign & c("filtered_after")).alias("filtered_after_detail"),
        F.slice(F.array_sort(F.collect_set(F.when(failed, F.coalesce("reason", F.lit("other"))))), 1, 20).alias("failure_reasons"),
    )
    parsed_n = c("_campaigns") + c("_anonymous")
    tried = F.when(c("http_2xx") > 0, c("http_2xx")).otherwise(parsed_n + c("parse_failures"))
    out = out.withColumns({"parsed": parsed_n, "duplicates": c("_parsed") - parsed_n, "filtered_before_detail": F.greatest(c("links_discovered") - c("scheduled"), F.lit(0)), "parse_rate": F.round(F.try_divide(parsed_n, tried), 4)})
    return out.drop("_anonymous", "_parsed", "_campaigns")
