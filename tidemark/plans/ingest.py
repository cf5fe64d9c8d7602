"""Jobs: pages to state, enrichment by a user's function, and both in one run."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import extract, pages, scoring, urls
from tidemark.functions.logic import moment, once
from tidemark.operators import actions, listing, merge
from tidemark.plans import candidates, gates
from tidemark.sources.snapshots import settled

Fn = Callable[[list[dict]], list[dict]]
#: What an analysis gives for a row.
ANALYSIS = "is_giveaway boolean, france_eligibility string, wanted_prize boolean, entry_acceptable boolean, end_date timestamp_ntz, confidence double"


@dataclass(frozen=True)
class Ingested:
    """``state`` after the pages, their ``sightings`` (giveaway_id, source_id, seen_at, url), and per source the ``outcome`` of the run."""

    state: DataFrame
    sightings: DataFrame
    outcome: DataFrame


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns that ``df`` lacks."""
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})


def page_candidates(snapshots: DataFrame, threshold: float = candidates.THRESHOLD) -> DataFrame:
    """Candidates of ``snapshots(page_id, url, html[, adapter, http_status, source_id, anchor_text])``, one for each canonical URL: what their sites' rules read, how they score, and what is decided about them.

    A page gives itself, unless its rules skip it, and a candidate for each card of its listing. The
    actions of a campaign's payload decide before its texts how hard it is to enter and whether it
    may be entered. What the rules read is stored once (fields, not markup); after that all is
    projection but the choice of each URL's first page. ``ordinal`` is ``(page_id, place)``.
    """
    c, n, none = F.col, scoring.normalize_text, F.lit(None).cast("string")
    rows = _with(snapshots, adapter=none, http_status=F.lit(200), source_id=F.lit(None).cast("long"), anchor_text=F.lit(""))
    f = lambda name: c(f"fields.{name}")
    # A page is a candidate unless its rules skip it, and each card of its listing is one.
    page = F.struct(
        c("url").alias("url"), F.coalesce(f("title"), pages.page_title(c("html"))).alias("title"), f("prize").alias("prize"), F.coalesce(f("excerpt"), extract.main_text(c("html"))).alias("excerpt"),
        f("restriction").alias("restriction"), f("entry_url").alias("entry_url"), f("end_date").alias("end_date"), F.lit(False).alias("is_card"),
    )
    read = once(extract.extract_fields(rows), {"_page": page, "_hints": pages.link_hints(c("html"))}).drop("html")
    or_page = lambda x, name: F.coalesce(F.nullif(x[name], F.lit("")), c(f"_page.{name}"))
    card = lambda x: F.struct(
        x["url"].alias("url"), or_page(x, "title").alias("title"), or_page(x, "prize").alias("prize"), or_page(x, "excerpt").alias("excerpt"),
        or_page(x, "restriction").alias("restriction"), x["entry_url"].alias("entry_url"), or_page(x, "end_date").alias("end_date"), F.lit(True).alias("is_card"),
    )
    none_of = lambda a: F.coalesce(a, F.from_json(F.lit("[]"), extract.CHILDREN))
    offers = F.concat(F.filter(F.array(c("_page")), lambda _: ~F.coalesce(f("skip"), F.lit(False))), F.transform(none_of(f("children")), card))
    read = read.select("*", F.posexplode(offers).alias("_pos", "o"))
    identity = urls.platform_identity(F.coalesce(c("o.entry_url"), c("o.url")))
    read = read.select(
        # Cards follow their page.
        F.struct("page_id", "_pos").alias("ordinal"),
        "source_id",
        c("url").alias("original_url"),
        F.coalesce(urls.canonical_url(c("o.url")), F.when(c("o.is_card"), c("o.url"))).alias("canonical_url"),
        F.lit(False).alias("skip"),
        c("o.title").alias("title"),
        c("o.prize").alias("prize"),
        c("o.excerpt").alias("excerpt"),
        c("o.restriction").alias("restriction"),
        f("method").alias("method_text"),
        f("purchase").alias("purchase_text"),
        f("free_hint").alias("free_hint"),
        f("category").alias("category"),
        f("filter_text").alias("filter_text"),
        actions.array_friction(f("actions"), f("quota"), f("login"), f("paid")).alias("friction_override"),
        f("expired").alias("expired"),
        c("o.entry_url").alias("entry_url"),
        f("terms_url").alias("terms_url"),
        F.try_to_timestamp(F.substring(c("o.end_date"), 1, 10), F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("end_at"),
        identity["platform"].alias("platform"),
        identity["campaign_id"].alias("platform_campaign_id"),
        actions.array_verdict(f("actions"), f("quota")).alias("platform_says"),
        "anchor_text",
        c("_hints").alias("link_hints"),
        # A card's title is part of its text, so that a short card reaches the threshold.
        F.when(c("o.is_card"), F.concat_ws("\n", "o.title", "o.excerpt")).otherwise(c("o.excerpt")).alias("_scored"),
    )
    # Stored, so that what decides about candidates neither carries the rules' plan nor the markup.
    read = settled(read)
    scored = scoring.score_candidates(read, n(c("canonical_url")), n(c("title")), n(c("_scored")), n(c("anchor_text")), n(F.array_join("link_hints", " "))).drop("_scored")
    return candidates.candidate_status(candidates.select_candidates(scored, threshold))


def follow_edges(snapshots: DataFrame) -> DataFrame:
    """``(src, dst)``: the links that each page's rules follow, both in canonical form, each once."""
    rows = _with(snapshots, adapter=F.lit(None).cast("string"), http_status=F.lit(200))
    links = extract.extract_fields(rows.withColumn("src", urls.canonical_url(F.col("url")))).select("src", F.explode("fields.follow").alias("to"))
    return links.select("src", urls.canonical_url(F.col("to")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def crawl_frontier(snapshots: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """:func:`~tidemark.operators.merge.expand_frontier` over the pages' own links, from ``seeds(source, url)``: ``(source, node, depth)``."""
    start = seeds.select("source", F.coalesce(urls.canonical_url(F.col("url")), F.col("url")).alias("node"))
    return merge.expand_frontier(settled(follow_edges(snapshots)), start, max_depth, max_pages)


def resolve_pages(snapshots: DataFrame, state: DataFrame, seen_at: str, threshold: float = candidates.THRESHOLD, totals: Observation | None = None) -> DataFrame:
    """Pages to candidates as sightings of the state's offers or of new ones, stored. ``totals`` observes how many candidates the same job made, and how many it rejects."""
    c, at = F.col, moment(seen_at)
    found = page_candidates(snapshots, threshold)
    if totals is not None:
        found = found.observe(totals, F.count(F.lit(1)).alias("candidates"), F.count_if(c("status") == "rejected").alias("rejected"), F.count_if("skip_analyze").alias("skipped"))
    batch = found.select(
        "ordinal", "source_id", "canonical_url", "original_url", "title", "prize", "link_hints", "entry_url", "terms_url", "end_at", "platform", "platform_campaign_id", "status",
        urls.url_domain(c("canonical_url")).alias("domain"),
        c("excerpt").alias("raw_excerpt"),
        pages.content_hash(c("title"), c("excerpt")).alias("content_hash"),
        c("score").alias("confidence"),
        c("prize_category"), c("prize_wanted").alias("wanted_prize"), c("prize_priority"),
        c("free").alias("free_entry"), c("eligible").alias("eligible_france"), c("eligibility").alias("france_eligibility"), "eligibility_reason",
        "requires_purchase", "requires_social", c("method").alias("entry_method"), c("friction").alias("entry_friction"), c("restriction").alias("geo_restriction"),
        c("entry_verdict.requires_public").alias("requires_public_social_action"), c("entry_verdict.acceptable").alias("entry_acceptable"), c("entry_verdict.reason").alias("entry_rejection_reason"),
        at.alias("seen_at"),
    )
    return settled(merge.resolve_identity(batch, state))


def ingest(snapshots: DataFrame, state: DataFrame, seen_at: str, threshold: float = candidates.THRESHOLD) -> Ingested:
    """Pages to candidates, matched against the state and each other, merged into it by the columns' policies."""
    resolved = resolve_pages(snapshots, state, seen_at, threshold)
    return Ingested(merge.merge_crawl(state, resolved), _sightings(resolved), merge.upsert_outcome(resolved, state))


def _sightings(resolved: DataFrame) -> DataFrame:
    return resolved.where("source_id IS NOT NULL").select("giveaway_id", "source_id", "seen_at", F.col("original_url").alias("url"))


@dataclass(frozen=True)
class CrawlRun:
    """What a run over pages leaves: the ``state``, the ``provenance`` of its offers, a row for each source in ``runs``, the ``sources`` with their next crawl, and run-wide ``totals``, counted while the pages were read."""

    state: DataFrame
    provenance: DataFrame
    runs: DataFrame
    sources: DataFrame
    totals: Observation


#: Fixed value: what a run without pages says.
NO_PAGES = "Crawl produced no pages (blocked, network, or robots.txt)"


def run_rows(snapshots: DataFrame, resolved: DataFrame, state: DataFrame, started_at: str) -> DataFrame:
    """A row for each source of the pages: ``(source_id, started_at, pages_fetched, errors_count, candidates_found, created, updated, previously_known, needs_analysis, status, error_summary)``.

    A page that was not answered with 2xx, or has no markup, is an error of its source. A source
    without answers fails; the others' rows do not depend on it.
    """
    c = F.col
    ok = F.coalesce(c("http_status").between(200, 299) & c("html").isNotNull(), F.lit(False))
    fetched = snapshots.groupBy("source_id").agg(F.count_if(ok).alias("pages_fetched"), F.count_if(~ok).alias("errors_count"))
    old = state.select(c("id").alias("giveaway_id"), c("content_hash").alias("_hash"))
    made = resolved.join(old, "giveaway_id", "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("candidates_found"),
        F.count_if(c("matched_by") == "new").alias("created"),
        F.count_if((c("matched_by") != "new") & c("_hash").eqNullSafe(c("content_hash"))).alias("previously_known"),
    )
    rows = fetched.join(made, fetched["source_id"].eqNullSafe(made["source_id"]), "left").drop(made["source_id"]).fillna(0, ["candidates_found", "created", "previously_known"])
    rows = merge.run_status(rows.withColumn("started_at", moment(started_at)))
    rows = rows.withColumns({"updated": c("candidates_found") - c("created"), "needs_analysis": c("candidates_found") - c("previously_known"), "error_summary": F.when(c("status") == "failed", NO_PAGES)})
    return rows.select("source_id", "started_at", "pages_fetched", "errors_count", "candidates_found", "created", "updated", "previously_known", "needs_analysis", "status", "error_summary")


def schedule_after(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources after a run: a failed one waits for its back-off, one more step of it, any other for its interval. Sources that were not run stay as they are."""
    c = F.col
    ran = runs.where("source_id IS NOT NULL").select(c("source_id").alias("id"), c("started_at").alias("_at"), (c("status") == "failed").alias("_failed"))
    both = sources.join(ran, "id", "left")
    before = F.coalesce("consecutive_failures", F.lit(0)).cast("long") if "consecutive_failures" in sources.columns else F.lit(0).cast("long")
    failures = F.when(c("_at").isNull(), before).when(c("_failed"), before + 1).otherwise(0).cast("long")
    both = both.withColumn("consecutive_failures", failures)
    wait = F.when(c("_failed"), merge.backoff_minutes(c("consecutive_failures"))).otherwise(c("crawl_interval_minutes").cast("long"))
    return both.withColumn("next_crawl_at", F.coalesce(c("_at") + F.make_dt_interval(mins=wait.cast("int")), "next_crawl_at")).drop("_at", "_failed")


def crawl_run(snapshots: DataFrame, state: DataFrame, sources: DataFrame, provenance: DataFrame, seen_at: str, threshold: float = candidates.THRESHOLD) -> CrawlRun:
    """One run over the pages of some sources, and all that it leaves. ``snapshots`` has ``source_id`` and ``http_status``."""
    totals = Observation()
    resolved = resolve_pages(snapshots, state, seen_at, threshold, totals)
    runs = settled(run_rows(snapshots, resolved, state, seen_at))
    return CrawlRun(merge.merge_crawl(state, resolved), merge.merge_provenance(provenance, _sightings(resolved)), runs, schedule_after(sources, runs), totals)


def ingest_pages(snapshots: DataFrame, state: DataFrame, seen_at: str, threshold: float = candidates.THRESHOLD) -> DataFrame:
    """The state after the pages."""
    return ingest(snapshots, state, seen_at, threshold).state


def enrich_batches(rows: DataFrame, fn: Fn, schema: str, limit: int | None = None, batch_size: int = 10, order: list[Column] | None = None) -> DataFrame:
    """Calls ``fn`` on lists of at most ``batch_size`` rows; adds ``schema``'s columns and ``error``.

    A batch whose call fails keeps its rows with the error's text and nulls, so that they stay
    pending. ``limit`` caps the rows of a run: the first by ``order``, dealt again over tasks.
    """
    names = [f.split()[0] for f in schema.split(",")]
    given = rows.orderBy(*order) if order else rows
    if limit is not None:
        given = given.limit(limit).repartition(max(1, math.ceil(limit / (batch_size * 10))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch_size):
                part = pdf.iloc[lo : lo + batch_size].reset_index(drop=True)
                try:
                    out = pd.DataFrame(fn(part.to_dict("records")), columns=names)
                    if len(out) != len(part):
                        raise ValueError(f"{len(out)} results for {len(part)} rows")
                    yield part.join(out).assign(error=None)
                except Exception as e:  # a user's function may fail in any way
                    yield part.assign(**{n: None for n in names}, error=str(e))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInPandas(run, f"{ddl}, {schema}, error string")


def drain_queue(state: DataFrame, fn: Fn, now: str, limit: int | None = None, batch_size: int = 10) -> DataFrame:
    """The state after one pass over its analysis queue: local gates first, the user's function on what is left, one merge.

    Rows whose call fails stay pending and are not tried again in the run.
    """
    gated = gates.analysis_gates(state, now)
    skipped = gates.apply_local_skips(gated.withColumn("gate", F.when(listing.is_pending(), F.col("gate"))))
    queue = listing.pending(gated).where("gate = 'send'").select("id", "title", "prize", "canonical_url", "prize_priority", "wanted_prize", "discovered_at")
    answers = enrich_batches(queue.withColumnRenamed("id", "giveaway_id").drop("wanted_prize"), fn, ANALYSIS, limit, batch_size, [F.col("prize_priority").desc_nulls_last(), F.col("discovered_at"), F.col("giveaway_id")] if limit else None)
    clean = answers.where("error IS NULL").select("giveaway_id", *[x.split()[0] for x in ANALYSIS.split(", ")])
    return merge.apply_analysis(skipped, clean, now)


def run_pipeline(snapshots: DataFrame, state: DataFrame, fn: Fn, now: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The state after the pages and one pass over the queue, and the run's summary: rows by status."""
    after = drain_queue(settled(ingest_pages(snapshots, state, now)), fn, now, limit)
    return after, listing.pipeline_summary(after)
