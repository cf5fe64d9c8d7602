"""Whether an offer can be entered without acting in public: verdicts on texts, and how verdicts merge.

A verdict is a struct: ``requires_public``, ``acceptable``, ``reason``, ``signals``, ``has_path``,
``public_available`` and ``non_public`` (how many other ways there are); what is not known is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.heads import head_pattern, holds, seen
from tidemark.functions.logic import is_false, is_true, let
from tidemark.functions.scoring import normalize_text

Rules = tuple[tuple[str, str], ...]

# The reason of a rejection, patterns of public actions and of other ways, and words that frame an action.
REASON = "requires public social-media action"
PUBLIC: Rules = (
    (r"\btag\s+(?:a\s+)?(?:friend|friends|\d+\s+friends?)\b", "tag_friend"),
    (r"\btag\s+\d+\b", "tag_friend"),
    (r"\bmention\s+(?:a\s+)?(?:friend|friends|\d+\s+friends?)\b", "mention_friend"),
    (r"\bidentifi(?:ez|er)\s+(?:un\s+)?ami\b", "tag_friend_fr"),
    (r"\btagu(?:ez|er)\s+(?:un\s+)?ami\b", "tag_friend_fr"),
    (r"\bmentionn(?:ez|er)\s+(?:un\s+)?ami\b", "mention_friend_fr"),
    (r"\binvit(?:ez|er)\s+(?:des\s+)?amis?\s+publiquement\b", "invite_friends_fr"),
    (r"\bcomment\s+below\b", "comment"),
    (r"\bleave\s+a\s+comment\b", "comment"),
    (r"\bpost\s+a\s+comment\b", "comment"),
    (r"\bcomment\s+on\s+(?:this\s+)?(?:post|photo|video|reel)\b", "comment"),
    (r"\bcomment(?:ez|er)\b", "comment_fr"),
    (r"\blaissez?\s+un\s+commentaire\b", "comment_fr"),
    (r"\bshare\s+(?:this\s+)?(?:post|photo|video|reel)\b", "share"),
    (r"\bshare\s+to\s+(?:your\s+)?(?:story|stories)\b", "story"),
    (r"\bshare\s+on\s+(?:instagram|facebook|tiktok|twitter|x)\b", "share"),
    (r"\brepost\b", "repost"),
    (r"\bretweet\b", "retweet"),
    (r"\bquote[- ]?post\b", "quote_post"),
    (r"\breshare\b", "reshare"),
    (r"\bpartagez?\s+(?:cette\s+)?(?:publication|poste?|photo|vid[eé]o)\b", "share_fr"),
    (r"\brepartagez?\b", "reshare_fr"),
    (r"\brepubliez?\b", "repost_fr"),
    (r"\bpubliez?\s+en\s+story\b", "story_fr"),
    (r"\bpartagez?\s+(?:en|sur\s+(?:votre\s+)?)story\b", "story_fr"),
    (r"\bpost\s+(?:a\s+)?(?:photo|video|reel|story)\b", "post_content"),
    (r"\bpost\s+to\s+(?:instagram|facebook|tiktok|twitter|x)\b", "post_content"),
    (r"\bpublish\s+(?:a\s+)?(?:post|photo|video)\b", "post_content"),
    (r"\bcreate\s+(?:a\s+)?(?:post|story|video|ugc)\b", "ugc"),
    (r"\buser[- ]generated\s+content\b", "ugc"),
    (r"\bpubliez?\s+(?:une\s+)?(?:photo|vid[eé]o|publication)\b", "post_content_fr"),
    (r"\buse\s+(?:the\s+)?hashtag\b", "hashtag"),
    (r"\bpost\s+(?:with\s+)?#\w+", "hashtag"),
    (r"\butilisez?\s+(?:le\s+)?hashtag\b", "hashtag_fr"),
    (r"\bpublic\s+(?:testimonial|review)\b", "testimonial"),
    (r"\bpublic\s+referral\s+post\b", "referral_post"),
)
OTHER_WAYS: Rules = (
    (r"\bfollow\b", "follow"),
    (r"\bsubscribe\b", "subscribe"),
    (r"\bnewsletter\b", "newsletter"),
    (r"\bemail\b", "email"),
    (r"\bvisit\b", "visit"),
    (r"\benter\s+(?:your\s+)?(?:name|email)\b", "form"),
    (r"\bcreate\s+an\s+account\b", "account"),
    (r"\blog\s*in\b", "login"),
    (r"\bjoin\s+(?:our\s+)?discord\b", "discord"),
    (r"\babonnez[- ]vous\b", "subscribe_fr"),
    (r"\bsuivez[- ]nous\b", "follow_fr"),
    (r"\bvisitez\b", "visit_fr"),
)
OPTIONAL = r"(?i)\b(?:optional|bonus|extra\s+entr(?:y|ies)|for\s+bonus|optionnel|bonus\s+d[' ]?entr[eé]es?|pour\s+plus\s+d[' ]?entr[eé]es?)\b"
MANDATORY = r"(?i)\b(?:must|required|mandatory|to\s+enter|in\s+order\s+to\s+enter|obligatoire|pour\s+participer|afin\s+de\s+participer)\b"

VERDICT = "struct<requires_public: boolean, acceptable: boolean, reason: string, signals: array<string>, has_path: boolean, public_available: boolean, non_public: bigint>"
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def verdict(requires_public=None, acceptable=None, reason=None, signals=None, has_path=None, public_available=None, non_public=None) -> Column:
    """A verdict of columns or plain values."""
    values = {"requires_public": requires_public, "acceptable": acceptable, "reason": reason, "signals": signals, "has_path": has_path, "public_available": public_available, "non_public": non_public}
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[column(v).alias(k) for k, v in values.items()]).cast(VERDICT)


_PATTERNS = tuple(p for p, _ in (*PUBLIC, *OTHER_WAYS))


def _labels(t: Column, rules: Rules) -> Column:
    """Labels of the rules that the normalised text matches, then of those that only the raw one does, each once."""
    found = lambda text: [F.when(holds(text, p, t["begun"], _PATTERNS, "(?i)"), F.lit(label)) for p, label in rules]
    return F.array_distinct(F.array_compact(F.array(*found(t["normal"]), *found(t["raw"]))))


def text_verdict(*texts: Column) -> Column:
    """The verdict on an offer's own texts, one line or more each.

    No public action named accepts. A public action beside another way accepts, unless every line
    that names one says that it must be done. Only optional public actions accept, ones that must be
    done reject, all else stays open.
    """
    raw = F.concat_ws("\n", *[F.when(F.trim(t) != "", t) for t in texts])
    # All the patterns begin at the edge of a word, so it is tried once.
    any_public = r"(?i)\b(?:" + "|".join(p.removeprefix(r"\b") for p, _ in PUBLIC) + ")"
    must, may = (lambda x: x.rlike(MANDATORY)), (lambda x: x.rlike(OPTIONAL))

    def begun(t: Column) -> Column:
        return F.struct(t["raw"].alias("raw"), t["normal"].alias("normal"), seen(F.concat_ws("\n", t["normal"], t["raw"]), _PATTERNS).alias("begun"))

    def labels(t: Column) -> Column:
        return F.struct(t["raw"].alias("raw"), _labels(t, PUBLIC).alias("public"), _labels(t, OTHER_WAYS).alias("other"))

    def facts(t: Column) -> Column:
        # Only the steps behind a public action ask for them.
        named = lambda x: F.when(F.size(t["public"]) > 0, x)
        lines = F.filter(F.split(t["raw"], _LINE_ENDS), lambda x: F.when(x.rlike(head_pattern(tuple(p for p, _ in PUBLIC))), x.rlike(any_public)).otherwise(F.lit(False)))
        return F.struct(t["raw"].alias("raw"), t["public"].alias("public"), t["other"].alias("other"), named(lines).alias("lines"), named(must(t["raw"])).alias("must"), named(may(t["raw"])).alias("may"))

    def ladder(f: Column) -> Column:
        lines, public, ways = f["lines"], f["public"], F.size(f["other"]).cast("long")
        only_must = F.when(F.size(lines) == 0, f["must"] & ~f["may"]).otherwise(F.forall(lines, lambda x: must(x) & ~may(x)))
        only_may = F.when(F.size(lines) == 0, f["may"] & ~f["must"]).otherwise(F.forall(lines, lambda x: may(x) & ~must(x)))
        return (
            F.when(F.trim(f["raw"]) == "", verdict())
            .when(F.size(public) == 0, verdict(False, True, has_path=F.when(ways > 0, True), public_available=False, non_public=F.when(ways > 0, ways)))
            .when((ways > 0) & ~only_must, verdict(False, True, None, public, True, True, ways))
            .when(only_may, verdict(False, True, None, public, True, True))
            .when(f["must"] | only_must, verdict(True, False, REASON, public, False, True))
            .otherwise(verdict(signals=public, public_available=True))
        )

    return let(let(let(let(let(raw, lambda r: F.struct(r.alias("raw"), normalize_text(r).alias("normal"))), begun), labels), facts), ladder)


def merge_verdict(local: Column, external_requires: Column, external_acceptable: Column, external_reason: Column) -> Column:
    """A local rejection stands, then a local acceptance with a known way; then the external verdict, else the local one."""
    kept = {"signals": local["signals"], "non_public": local["non_public"]}
    return (
        F.when(is_false(local["acceptable"]), local)
        .when(is_true(local["acceptable"]) & is_true(local["has_path"]), verdict(False, True, None, has_path=True, public_available=local["public_available"], **kept))
        .when(is_false(external_acceptable) | is_true(external_requires), verdict(True, False, F.coalesce(F.nullif(external_reason, F.lit("")), F.lit(REASON)), has_path=False, public_available=True, **kept))
        .when(is_true(external_acceptable), verdict(False, True, None, has_path=True, public_available=local["public_available"], **kept))
        .otherwise(local)
    )
