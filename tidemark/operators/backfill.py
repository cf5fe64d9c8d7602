"""Verdicts on entering, made again from what is stored: actions out of JSON or text, and what changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.acceptability import REASON, text_verdict
from tidemark.functions.logic import is_false, is_true, once
from tidemark.operators.actions import platform_verdict

_ACTION = "struct<entry_type: string, mandatory: boolean>"
#: How stored JSON may list actions: as objects, as strings, or by type; at the top or under _meta.
_LISTS = "mandatory_actions array<string>, optional_actions array<string>, mandatory_entry_types array<string>, optional_entry_types array<string>, actions_required string"
_STORED = f"{_LISTS}, requirements array<string>, summary string, eligibility_notes string, entry_method string, _meta struct<{_LISTS.replace(' array', ': array').replace(' string', ': string')}>"
_NONE = "array<struct<entry_type: string, mandatory: boolean>>"


def _listed(items: Column, mandatory: bool) -> Column:
    """Actions of an array of JSON objects or plain strings."""

    def one(x: Column) -> Column:
        read = F.from_json(x, "entry_type string, mandatory boolean")
        return F.struct(F.when(F.startswith(F.ltrim(x), F.lit("{")), read["entry_type"]).otherwise(x).alias("entry_type"), F.coalesce(read["mandatory"], F.lit(mandatory)).alias("mandatory"))

    return F.coalesce(F.filter(F.transform(items, one), lambda a: F.coalesce(a["entry_type"], F.lit("")) != ""), F.array().cast(_NONE))


def _named(text: Column, label: str, mandatory: bool) -> Column:
    """Actions that a text names behind a label, parted by commas, semicolons or blanks."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i){label}\s*:\s*([a-z0-9_,\-\s]+)"), F.lit(1))
    words = F.flatten(F.transform(runs, lambda r: F.split(F.trim(F.lower(r)), r"[\s,;]+")))
    kept = F.filter(words, lambda w: (w != "") & (~w.isin("required", "optional") if mandatory else F.lit(True)))
    return F.transform(kept, lambda w: F.struct(w.alias("entry_type"), F.lit(mandatory).alias("mandatory")))


def _required_lines(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)Required:\s*([a-z0-9_\-]+)"), F.lit(1))
    return F.transform(found, lambda w: F.struct(F.lower(w).alias("entry_type"), F.lit(True).alias("mandatory")))


def recover_actions(state: DataFrame) -> DataFrame:
    """``state`` with ``stored`` (its JSON, read), ``actions`` and ``quota``: from the JSON's lists, else from the wording of method, excerpt and the JSON's own texts."""
    c, s = F.col, F.col("stored")
    d = once(state, {"stored": F.from_json("analysis_json", _STORED)})
    excerpt = c("raw_excerpt") if "raw_excerpt" in state.columns else F.lit(None).cast("string")
    of = lambda x: [_listed(x["mandatory_actions"], True), _listed(x["optional_actions"], False), _listed(x["mandatory_entry_types"], True), _listed(x["optional_entry_types"], False)]
    listed = F.concat(*of(s), *of(s["_meta"]))
    texts = (c("entry_method"), excerpt, s["entry_method"], s["summary"])
    worded = F.concat(*[part for t in texts for part in (_named(t, "mandatory", True), _named(t, "optional", False), _required_lines(t))])
    number = lambda t: F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), r"(?i)actions_required\s*=\s*(\d+)", 1), F.lit("")).cast("int")
    stated = lambda x: F.when(x.isNotNull(), F.greatest(x.try_cast("int"), F.lit(0)))
    quota = F.coalesce(stated(s["actions_required"]), stated(s["_meta"]["actions_required"]), number(c("entry_method")), number(excerpt))
    return d.withColumns({"actions": F.when(F.size(listed) > 0, listed).otherwise(worded), "quota": quota})


def reassessed(state: DataFrame) -> DataFrame:
    """``state`` with ``says``: the verdict of its recovered actions, else of its texts.

    A row's actions are counted by id, one grouped pass over the exploded actions.
    """
    c, d = F.col, recover_actions(state)
    acts = d.select(c("id").alias("campaign_id"), F.explode("actions").alias("a"), c("quota").alias("actions_required")).select("campaign_id", "a.entry_type", "a.mandatory", "actions_required")
    platform = platform_verdict(acts).select(c("campaign_id").alias("id"), c("says").alias("_by_actions"))
    body = [c(x) for x in ("raw_excerpt", "description") if x in state.columns]
    stored = [c(f"stored.{x}") for x in ("summary", "eligibility_notes", "entry_method")]
    text = text_verdict(c("title"), c("prize"), *body, *stored, F.array_join("stored.requirements", "\n"), c("entry_method"))
    return once(d.join(platform, "id", "left"), {"says": F.coalesce("_by_actions", text)}).drop("_by_actions", "stored", "actions", "quota")


def _changed(d: DataFrame) -> Column:
    c = F.col
    same = c("requires_public_social_action").eqNullSafe(c("says.requires_public")) & c("entry_acceptable").eqNullSafe(c("says.acceptable")) & F.nullif("entry_rejection_reason", F.lit("")).eqNullSafe(c("says.reason"))
    return ~same


def _change_set(d: DataFrame, status: Column) -> DataFrame:
    c = F.col
    return d.select("id", c("says.requires_public").alias("requires_public_social_action"), c("says.acceptable").alias("entry_acceptable"), F.when(is_false(c("says.acceptable")), F.coalesce("says.reason", F.lit(REASON))).alias("entry_rejection_reason"), status.alias("status"), c("status").alias("old_status"))


def backfill_verdicts(state: DataFrame, force: bool = False) -> DataFrame:
    """The change set ``(id, requires_public_social_action, entry_acceptable, entry_rejection_reason, status, old_status)`` of rows without a verdict, or of all where forced; a rejection moves open rows to rejected."""
    d = reassessed(state if force else state.where("entry_acceptable IS NULL"))
    rows = d if force else d.where(_changed(d))
    moved = F.when(is_false(F.col("says.acceptable")) & F.col("status").isin("active", "candidate", "uncertain"), "rejected").otherwise(F.col("status"))
    return _change_set(rows, moved)


def reevaluate_rejections(state: DataFrame) -> DataFrame:
    """The change set of rows once rejected for a public action whose verdict is another now; a rejected row goes back to active if it was analysed, else to candidate, unless it is rejected again."""
    c = F.col
    reason = F.lower(F.coalesce("entry_rejection_reason", F.lit("")))
    was = is_false(c("entry_acceptable")) & (reason.rlike("public social|social-media") | is_true(c("requires_public_social_action")))
    d = reassessed(state.where(was))
    back = F.when((c("status") == "rejected") & ~is_false(c("says.acceptable")), F.when(c("analyzed_at").isNotNull(), "active").otherwise("candidate")).otherwise(c("status"))
    return _change_set(d.where(_changed(d)), back)


def verdict_summary(changes: DataFrame) -> DataFrame:
    """How many changes reject, accept or leave open, and how many move a status."""
    c = F.col
    return changes.agg(
        F.count(F.lit(1)).alias("updated"),
        F.count_if(is_false(c("entry_acceptable"))).alias("rejected"),
        F.count_if(is_true(c("entry_acceptable"))).alias("acceptable"),
        F.count_if(c("entry_acceptable").isNull()).alias("unknown"),
        F.count_if(c("status") != c("old_status")).alias("moved"),
    )


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State rows with the change set's values."""
    names = ("requires_public_social_action", "entry_acceptable", "entry_rejection_reason", "status")
    new = changes.select("id", F.lit(True).alias("_hit"), *[F.col(n).alias(f"_{n}") for n in names])
    return state.join(new, "id", "left").withColumns({n: F.when(F.col("_hit"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names}).drop("_hit", *[f"_{n}" for n in names])
