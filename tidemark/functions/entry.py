"""How an offer is entered, who may enter, and what speaks against it: rules as data, ladders as columns.

All texts are normalised first (lower case, plain letters), so the patterns are in lower case and
read alike on every regex engine: none looks behind, and "not preceded by no" is a removal followed
by a test. Rules for flag emoji are left out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.heads import holds, seen
from tidemark.functions.logic import let

Rules = list[tuple[str, str]]

# Patterns with their labels, in order of rank.
HARD: Rules = [
    (r"\bmust\s+purchase\b|\bbuy\s+to\s+enter\b", "purchase_required"),
    (r"\bpaid\s+entr(?:y|ies)\b|\bentry\s+fee\b|\bticket\s+(?:to\s+)?enter\b", "paid_entry"),
    (r"\bpostal\s+(?:entr(?:y|ies)|only)\b|\bsend\s+(?:a\s+)?(?:sae|stamped\s+addressed\s+envelope)\b|\bmail[- ]?in\s+(?:only\s+)?entr", "postal_only"),
    (r"\bdaily\s+entr(?:y|ies)\b|\benter\s+(?:every|each)\s+day\b", "daily_entry"),
    (r"\bcreative\s+submission\b|\bsubmit\s+(?:a\s+)?(?:photo|video|essay|slogan)\b", "creative"),
]
MEDIUM: Rules = [
    (r"\b(?:create|sign\s*up\s+for|register)\s+(?:an?\s+)?account\b", "account"),
    (r"\blog\s*in\s+required\b|\bmust\s+(?:be\s+)?logged\s+in\b", "login"),
    (r"\bnewsletter\b", "newsletter"),
    (r"\bfollow\s+(?:us\s+)?on\s+(?:instagram|facebook|twitter|x|tiktok)\b|\blike\s+(?:our\s+)?(?:facebook|page|post)\b|\bshare\s+(?:this|on)\b", "social"),
    (r"\bmultiple\s+steps?\b", "multi_step"),
]
EASY: Rules = [
    (r"\benter\s+your\s+details\b", "web_form"),
    (r"\bname\s+and\s+email\b", "name_email"),
    (r"\bemail\s+(?:address\s+)?(?:only\s+)?(?:to\s+)?enter\b", "email"),
    (r"\bsimple\s+(?:online\s+)?form\b|\bonline\s+entry\s+form\b", "web_form"),
    (r"\banswer\s+the\s+question", "one_question"),
    (r"\bwebsite\b", "website"),
    (r"\bgleam\b", "gleam"),
]
METHODS: Rules = [("gleam", "gleam"), ("instagram", "instagram"), ("facebook", "facebook"), ("website|web form|web_form", "web_form"), ("email", "email")]
UNDESIRABLE: Rules = [
    (r"\bfree\s+spins?\b|\bno\s+deposit\b|\bcasino\b", "casino"),
    (r"\bgambling\b", "gambling"),
    (r"\blottery\b", "lottery"),
    (r"\bcryptocurrenc|\bbitcoin\b|\bethereum\b|\btoken\s+airdrop\b|\bnft\s+giveaway\b|\bwin\s+(?:free\s+)?(?:crypto|bitcoin|ethereum|nft)s?\b|\bcrypto\s+giveaway\b", "crypto"),
    (r"\bsurvey\s+(?:funnel|only)\b|\bcomplete\s+(?:this\s+)?survey\b|\blead[- ]?gen", "survey"),
]
SHORT_FIELDS: Rules = [(r"\bcrypto\b|\bnft\b|\bairdrop\b|\bbitcoin\b|\bethereum\b", "crypto")]
EXPIRED = r"\bcompetition\s+has\s+closed\b|\bhas\s+ended\b|\bexpired\b|\bno\s+longer\s+(?:open|available)\b|\bconcours\s+termin|\bjeu\s+clotur"
NO_PURCHASE = r"\bno\s+purchase\s+(?:necessary|required)\b|\bpurchase\s+required\s*:\s*no\b|\bfree\s+to\s+enter\b|\bfree\s+online\s+competition"
NOT_REQUIRED = r"\bno\s+purchase\s+required\b|\bpurchase\s+required\s*:?\s*no\b"
REQUIRED = r"\bpurchase\s+required\b"
FEE = r"\bpaid\s+entr(?:y|ies)\b|\bentry\s+fee\b"
SCOPES: Rules = [
    (r"\bworldwide\b|\binternational\b|\bopen\s+(?:to\s+)?(?:all\s+)?countries\b|\banywhere\s+in\s+the\s+world\b", "worldwide"),
    (r"\buk\s+residents?\s+only\b|\bunited\s+kingdom\s+only\b|\bonly\s+(?:open\s+to\s+)?(?:uk|united\s+kingdom)\b|\buk\s+entrants?\b|\bavailable\s+in\s+united\s+kingdom\b|\bopen\s+to\s+united\s+kingdom\b|^(?:uk|united kingdom)$", "uk"),
    (r"\bus\s+residents?\s+only\b|\bunited\s+states\s+only\b|\bonly\s+(?:open\s+to\s+)?(?:us|u\.s\.|united\s+states)\b|\blegal\s+residents?\s+of\s+the\s+united\s+states\b|\bavailable\s+in\s+united\s+states\b|\bopen\s+to\s+united\s+states\b|^(?:us|u\.s\.|united states|usa)$", "us"),
    (r"\bcanada\s+only\b|\bcanadian\s+residents?\s+only\b|\bavailable\s+in\s+canada\b|^(?:canada|ca)$", "canada"),
    (r"\bfrance\s+only\b|\bopen\s+to\s+(?:france|french\s+residents)\b|\bresidents?\s+(?:of\s+)?france\b|\belligible\s+france\b|\bfrance\s+(?:et|/)\s*(?:belgique|dom|tom)", "france"),
    (r"\beu\s+(?:only|residents)\b|\beuropean\s+union\b|\beurope\s+only\b", "eu"),
    (r"\bonly\b|\bresidents?\b|\bavailable\s+in\b|\bopen\s+to\b", "specific"),
]
EXCLUDED = r"\bexclud(?:e|ing|es)\s+france\b|\bnot\s+(?:open|available)\s+(?:in|to)\s+france\b"
#: The ladder over all texts, each step with its reason and what it means for the region.
LADDER: list[tuple[str, str, bool]] = [
    (EXCLUDED + r"|\bexcept\s+france\b|\bhors\s+france\b", "france_excluded", False),
    (r"\bus\s+residents?\s+only\b|\bunited\s+states\s+only\b|\busa\s+only\b|\b50\s+united\s+states\b|\blegal\s+residents?\s+of\s+the\s+(?:fifty\s+)?(?:50\s+)?united\s+states\b|\bonly\s+(?:open\s+to\s+)?(?:us|u\.s\.|usa|united\s+states)\b|\bopen\s+to\s+(?:legal\s+)?residents?\s+of\s+the\s+united\s+states\b|\bavailable\s+in\s+united\s+states\b|\beligible[:\s]+(?:us|usa|united\s+states)\b|^us$", "us_only", False),
    (r"\buk\s+residents?\s+only\b|\bunited\s+kingdom\s+only\b|\bonly\s+(?:open\s+to\s+)?(?:uk|united\s+kingdom)\b|\buk\s+entrants?\b|\bgb\s+residents?\s+only\b|\bopen\s+to\s+(?:uk|united\s+kingdom)\s+residents?\b|\bavailable\s+in\s+(?:the\s+)?united\s+kingdom\b", "uk_only", False),
    (r"\bcanada\s+only\b|\bcanadian\s+residents?\s+only\b|\bonly\s+(?:open\s+to\s+)?(?:canada|canadian)\b|\bavailable\s+in\s+canada\b", "canada_only", False),
    (r"\baustralia\s+only\b|\baustralian\s+residents?\s+only\b|\bonly\s+(?:open\s+to\s+)?(?:australia|australian)\b|\bau\s+residents?\s+only\b", "australia_only", False),
    (r"\bfrance\b", "france_explicit", True),
    (r"\bworldwide\b|\binternational\b|\bopen\s+(?:to\s+)?(?:all\s+)?countries\b|\banywhere\s+in\s+the\s+world\b|\bmonde\s+entier\b|\binternationalement\b", "worldwide", True),
    (r"\beu\s+(?:only|residents)\b|\beuropean\s+union\b|\beurope\s+only\b|\beuropean\s+residents?\b|\bunion\s+europeenne\b|\bresidents?\s+(?:de\s+)?l[' ]?ue\b|\beu\s*/\s*eea\b|\beea\s+residents?\b", "eu", True),
]
SHIPPING = r"\bships?\s+only\s+to\b|\bshipping\s+(?:limited|restricted)\s+to\b|\bdeliver(?:y|ies)?\s+only\s+(?:to|within)\b"


def tags(text: Column, rules: Rules, begun: Column | None = None, patterns: tuple[str, ...] = (), needs: dict[str, tuple[str, ...]] = {}) -> Column:
    """Labels of the rules a text matches, in order, each once; ``begun`` are the heads of ``patterns`` in it, if they were looked up, and ``needs`` has letters by label, one of which every match holds."""

    def test(p: str, label: str) -> Column:
        if label not in needs:
            return holds(text, p, begun, patterns)
        return F.when(reduce(or_, [F.contains(text, F.lit(x)) for x in needs[label]]), text.rlike(p)).otherwise(F.lit(False))

    return F.array_distinct(F.array_compact(F.array(*[F.when(test(p, label), F.lit(label)) for p, label in rules])))


def first_tag(text: Column, rules: Rules) -> Column:
    """Label of the first rule a text matches, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for p, label in rules])


def purchase_required(text: Column) -> Column:
    """A purchase is asked for and nothing in the text says otherwise."""
    asked = F.regexp_replace(text, NOT_REQUIRED, " ").rlike(REQUIRED) | text.rlike(HARD[0][0])
    return asked & ~text.rlike(NO_PURCHASE)


def hard_label(text: Column) -> Column:
    return F.when(purchase_required(text), "purchase_required").otherwise(first_tag(text, HARD[1:]))


def entry_friction(text: Column, method: Column) -> Column:
    """(friction, method): hard over medium over easy; the method is an easy, medium or hard label, unless its own text names one."""
    def ladder(t: Column) -> Column:
        level = F.when(t["empty"], "unknown").when(t["hard"].isNotNull(), "hard").when(t["medium"].isNotNull(), "medium").when(t["easy"].isNotNull(), "easy")
        level = level.when(method.isin("website", "web form", "online", "form"), "easy").otherwise("unknown")
        return F.struct(level.alias("friction"), F.coalesce(first_tag(method, METHODS), t["easy"], t["medium"], t["hard"]).alias("method"))

    return let(F.struct((F.trim(text) == "").alias("empty"), hard_label(text).alias("hard"), first_tag(text, MEDIUM).alias("medium"), first_tag(text, EASY).alias("easy")), ladder)


def geo_scope(restriction: Column) -> Column:
    return F.coalesce(first_tag(F.trim(restriction), SCOPES), F.lit("unknown"))


def region_allowed(restriction: Column) -> Column:
    """Whether the restriction alone lets the region in; null where it does not say."""
    return let(
        geo_scope(restriction),
        lambda scope: F.when(restriction.rlike(EXCLUDED), False)
        .when(scope.isin("worldwide", "france", "eu"), True)
        .when(scope.isin("uk", "us", "canada"), False)
        .when((scope == "specific") & restriction.rlike(r"\bonly\b"), False),
    )


def region_reason(text: Column, restriction: Column) -> Column:
    """The step of the ladder that decides: over all texts first, then the restriction's scope."""
    patterns = (*(p for p, _, _ in LADDER), SHIPPING)

    def ladder(t: Column) -> Column:
        scope, begun = t["scope"], t["begun"]
        steps = F.when(F.trim(text) == "", "insufficient_text")
        for pattern, reason, _ in LADDER:
            steps = steps.when(holds(text, pattern, begun, patterns), reason)
        steps = steps.when(scope.isin("worldwide", "france", "eu", "uk", "us", "canada"), F.concat(F.lit("scope_"), scope))
        steps = steps.when((scope == "specific") & restriction.rlike(r"\bonly\b"), "specific_only_without_france")
        return steps.when(holds(text, SHIPPING, begun, patterns), "shipping_restricted_ambiguous").otherwise("unknown")

    return let(F.struct(geo_scope(restriction).alias("scope"), seen(text, patterns).alias("begun")), ladder)


def region_eligibility(text: Column, restriction: Column) -> Column:
    """(state, flag, reason) of the region; what is not said stays unknown."""
    yes = [r for _, r, good in LADDER if good] + ["scope_worldwide", "scope_france", "scope_eu"]
    no = [r for _, r, good in LADDER if not good] + ["scope_uk", "scope_us", "scope_canada", "specific_only_without_france"]

    def told(reason: Column) -> Column:
        flag = F.when(reason.isin(*yes), True).when(reason.isin(*no), False)
        state = F.when(flag, "eligible").when(~flag, "ineligible").otherwise("unknown")
        return F.struct(state.alias("state"), flag.alias("flag"), F.concat(F.lit("local_"), reason).alias("reason"))

    return let(region_reason(text, restriction), told)


def undesirable_reasons(fields: Column, text: Column) -> Column:
    """What speaks against an offer: rules on all texts, short words in its own fields only, being over, and costs."""
    costs = F.array_compact(F.array(F.when(purchase_required(text), F.lit("purchase_required")), *[F.when(text.rlike(p), F.lit(label)) for p, label in HARD[1:3]]))
    over = F.array_compact(F.array(F.when(text.rlike(EXPIRED), F.lit("expired"))))
    return F.array_distinct(F.concat(tags(text, UNDESIRABLE), tags(fields, SHORT_FIELDS), over, costs))


def free_entry(text: Column) -> Column:
    """Whether entering is free, as far as the text says."""
    return F.when(text.rlike(NO_PURCHASE), True).when(F.regexp_replace(text, NOT_REQUIRED, " ").rlike(REQUIRED) | text.rlike(FEE), False)


def discovery_priority(free: Column, friction: Column, region: Column, scope: Column) -> Column:
    """Rank of an offer; a lower one is better."""
    no, free_or_open = free.eqNullSafe(F.lit(False)), ~free.eqNullSafe(F.lit(False))
    near = region.eqNullSafe(F.lit(True)) | scope.isin("france", "eu")
    return (
        F.when(no, 90)
        .when(friction == "hard", 80)
        .when((scope == "worldwide") & (friction == "easy") & free.eqNullSafe(F.lit(True)), 1)
        .when(near & (friction == "easy") & free_or_open, 2)
        .when((scope == "worldwide") & (friction == "medium"), 3)
        .when(friction == "easy", 4)
        .when(friction == "medium", 5)
        .when(friction == "unknown", 6)
        .otherwise(70)
    )
