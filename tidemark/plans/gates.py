"""What is decided locally before an offer goes to an analysis, and how that is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import entry, scoring
from tidemark.functions.logic import is_false, is_true, moment
from tidemark.operators.listing import TERMINAL

_ENDED_ON = r"\bended\s+on\s+(\d{4}-\d{2}-\d{2})\b"


def clearly_expired(end_at: Column, text: Column, now: str) -> Column:
    """The end has passed, or the text says that it is over, or names a past day on which it ended."""
    named = F.try_to_timestamp(F.nullif(F.regexp_extract(text, _ENDED_ON, 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return F.coalesce(end_at < moment(now), F.lit(False)) | text.rlike(entry.EXPIRED) | F.coalesce(named < moment(now), F.lit(False))


def assess(rows: DataFrame) -> DataFrame:
    """``rows(.., text, fields, restriction)`` with friction, method, scope, region, free, reasons, priority and clear_skip."""
    c = F.col
    out = rows.withColumns({"_f": entry.entry_friction(c("text"), F.lit("")), "scope": entry.geo_scope(c("restriction")), "region": entry.region_allowed(c("restriction")), "free": entry.free_entry(c("text")), "reasons": entry.undesirable_reasons(c("fields"), c("text"))})
    out = out.withColumns({"friction": c("_f.friction"), "method": c("_f.method")}).drop("_f")
    return out.withColumns({"priority": entry.discovery_priority(c("free"), c("friction"), c("region"), c("scope")), "clear_skip": F.size("reasons") > 0})


def analysis_gates(state: DataFrame, now: str, threshold: float = 0.45) -> DataFrame:
    """State rows with ``gate``: the first reason not to send a row to an analysis, or send."""
    c = F.col
    also = [x for x in ("description", "raw_excerpt") if x in state.columns]
    text = scoring.normalize_text(F.concat_ws("\n", "title", "prize", *also))
    fields = scoring.normalize_text(F.concat_ws("\n", "title", "prize"))
    gate = (
        F.when(c("title").isNull() & c("prize").isNull(), "missing_content")
        .when(c("analyzed_at").isNotNull(), "already_analyzed")
        .when(c("manual_status").isin(*TERMINAL), "terminal")
        .when(F.coalesce("confidence", F.lit(0.0)) < threshold, "below_threshold")
        .when(clearly_expired(c("end_at"), text, now), "expired")
        .when(F.size(entry.undesirable_reasons(fields, text)) > 0, "undesirable")
        .when((c("france_eligibility") == "ineligible") | is_false(c("eligible_france")), "region_ineligible")
        .when(is_false(c("entry_acceptable")) & is_true(c("requires_public_social_action")), "public_social")
        .otherwise("send")
    )
    return state.withColumn("gate", gate)


def apply_local_skips(gated: DataFrame) -> DataFrame:
    """Rows after their gates: expired ones expire, barred ones are rejected with the reason as JSON and the flags that follow; ``analyzed_at`` stays as it is."""
    skipped = F.col("gate").isin("expired", "undesirable", "region_ineligible", "public_social")
    status = F.when(F.col("gate") == "expired", "expired").when(skipped, "rejected").otherwise(F.col("status"))
    why = F.when(skipped, F.to_json(F.struct(F.col("gate").alias("local_skip")))).otherwise(F.col("analysis_json"))
    region, public = F.col("gate") == "region_ineligible", F.col("gate") == "public_social"
    flags = {"eligible_france": F.when(region, False).otherwise(F.col("eligible_france")), "france_eligibility": F.when(region, "ineligible").otherwise(F.col("france_eligibility"))}
    flags |= {"entry_acceptable": F.when(public, False).otherwise(F.col("entry_acceptable")), "requires_public_social_action": F.when(public, True).otherwise(F.col("requires_public_social_action"))}
    return gated.withColumns({"status": status, "analysis_json": why, **flags}).drop("gate")
