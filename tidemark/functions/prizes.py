"""What kind of prize an offer has, whether it is wanted, and how much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.entry import tags
from tidemark.functions.heads import seen
from tidemark.functions.logic import once

Rules = list[tuple[str, str]]

# Patterns over normalised text by family, in order.
FAMILIES: dict[str, Rules] = {
    "cash": [
        # The sign is no letter, so it counts only beside one: "eur 50" and "50 euros", but neither of the signs alone.
        (r"\b(?:€|eur|euros?)\s*\d|\b\d[\d\s.,]*\s*(?:€|eur|euros?)\b", "cash_amount"),
        (r"\b(?:cash|argent|virement|bank\s+transfer)\b", "cash"),
        (r"\bpaypal\b", "paypal"),
        (r"\bprepaid\s+(?:visa|mastercard|card)\b|\bcarte\s+prepayee\s+(?:visa|mastercard)\b|\bvisa\s+prepaid\b|\bmastercard\s+prepaid\b", "prepaid_card"),
    ],
    "physical": [
        (r"\bps\s*5\b|\bplaystation\b|\bxbox\s*series|\bnintendo\s+switch", "console"),
        (r"\bgaming\s+(?:pc|laptop|rig|monitor|chair|headset|keyboard|mouse)\b", "gaming_hw"),
        (r"\b(?:gpu|graphics\s+card|rtx\s*\d|radeon|geforce)\b", "pc_component"),
        (r"\b(?:iphone|smartphone|galaxy\s+s\d|pixel\s+\d|ipad|tablet)\b", "phone_tablet"),
        (r"\b(?:tv|television|ecran\s+oled|oled\s+tv)\b", "tv"),
        (r"\b(?:headphones?|earbuds?|airpods|casque|ecouteurs)\b", "audio"),
        (r"\b(?:camera|appareil\s+photo|gopro|dslr|mirrorless)\b", "camera"),
        (r"\b(?:laptop|ordinateur|macbook|imac|pc\s+portable|computer)\b", "computer"),
        (r"\b(?:kitchenaid|mixeur|blender|airfryer|air\s+fryer|robot\s+cuisine|four|frigo|refrigerateur|lave[- ]?vaisselle|lave[- ]?linge|aspirateur|dyson|electromenager)\b", "appliance"),
        (r"\b(?:furniture|meuble|canape|sofa|matelas|bureau|chaise\s+de\s+bureau)\b", "furniture"),
        (r"\b(?:velo|bicycle|bike|trottinette|scooter|e[- ]?bike)\b", "mobility"),
        (r"\b(?:outil|tools?|perceuse|drill|scie)\b", "tools"),
        (r"\belectroni", "electronics"),
    ],
    "digital": [
        (r"\bsteam\b", "steam"),
        (r"\b(?:psn|playstation)\s+(?:store\s+)?(?:code|card|key|credit)\b|\bxbox\s+(?:live\s+)?(?:gift\s+)?(?:card|code|key|credit)\b|\bnintendo\s+(?:eshop|e[- ]?shop|gift)\b", "console_digital"),
        (r"\b(?:game\s+key|steam\s+key|cd\s*key|cle\s+(?:steam|jeu))\b|\b(?:video\s+)?game\s+(?:code|key|download)\b", "game_key"),
        (r"\blicen[cs]e\s+(?:logiciel|software)\b|\b(?:adobe|microsoft\s+365|office\s+365)\s+(?:licence|license|subscription)?\b", "software"),
    ],
    "gift": [(r"\bamazon\s+(?:gift\s+)?card\b|\bcarte\s+(?:cadeau\s+)?amazon\b", "amazon_gc"), (r"\bcarte\s+cadeau\b|\bgift\s+card\b", "gift_card")],
    "travel": [(r"\b(?:voyage|trip|holiday|vacation|sejour|week[- ]?end)\b|\b(?:hotel|flight|vol\s+(?:aller|pour)|billets?\s+d[' ]avion)\b|\b(?:travel\s+package|forfait\s+voyage|city\s+break)\b", "travel")],
    "tickets": [(r"\b(?:concert|festival|billet|ticket)s?\b|\b(?:cinema|match|stadium|stade)\b|\b(?:sports?\s+tickets?|event\s+tickets?)\b", "event_ticket")],
    "experience": [
        (r"\b(?:escape\s*(?:game|room)|escape[- ]game)\b|\b(?:restaurant|repas|diner|meal|dinner)\b|\b(?:spa|wellness|massage)\b|\b(?:experience|activite)\b", "experience"),
        (r"\b(?:mariage|wedding\s+package|wedding)\b", "wedding"),
        (r"\b(?:shooting|photoshoot|seance\s+photo|photography\s+session)\b|\b(?:coaching|formation|course|cours|workshop)\b", "service"),
    ],
    "books": [(r"\b(?:livres?|books?|ebooks?|ebook\s+bundle|bundle\s+de\s+livres|book\s+bundle)\b", "books"), (r"\b(?:magazine|abonnement\s+(?:magazine|presse)|magazine\s+subscription)\b", "subscription")],
    "discount": [
        (r"\b(?:reduction|remise|discount|coupon|%\s*off|pourcent)\b", "discount"),
        (r"\b(?:bon\s+d[' ]achat\s+des|offerts?\s+des|voucher\s+(?:valid\s+)?(?:on|for)\s+purchases?\s+over)\b|\b\d+\s*(?:€|eur|euros)?\s*(?:off|de\s+reduction).{0,40}(?:over|des|a\s+partir|achat|spend|purchases?)\b|\b(?:purchases?\s+over|minimum\s+spend|spend\s+(?:of\s+)?(?:€|\$|eur)?\s*\d+)\b|\b(?:des\s+\d+|a\s+partir\s+de\s+\d+).{0,20}(?:€|eur\b)", "min_spend"),
    ],
}
#: Letters of which every match of a rule without plain beginnings holds one.
NEEDS = {
    "cash_amount": ("€", "eur"),
    "mobility": ("velo", "bicycle", "bike", "trottinette", "scooter"),
    "discount": ("reduction", "remise", "discount", "coupon", "%", "pourcent"),
    "min_spend": ("achat", "offert", "purchase", "off", "reduction", "spend", "€", "eur"),
}
HIGH = ("console", "gaming_hw", "pc_component", "phone_tablet", "computer", "tv")
USEFUL = ("appliance", "furniture", "tools", "mobility", "camera", "audio", "electronics")
GAMES = ("steam", "game_key", "console_digital")
#: The ladder of what is not wanted: test, category, priority.
FAR = ("travel", "event_ticket", "experience", "service", "books_media", "discount", "restricted_gift_card", "subscription")


def prize_preference(rows: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """``rows`` with category, wanted, priority, travel, spend, mixed and the rank in the analysis queue, each with ``prefix`` before its name.

    Any wanted asset beats what is unwanted beside it. A bare amount of money is weak: it is dropped
    next to discounts, and next to travel, events or services where nothing else says cash.
    """
    c = F.col
    patterns = tuple(p for rules in FAMILIES.values() for p, _ in rules)
    d = once(rows, {"_text": text})
    d = once(d, {"_begun": seen(c("_text"), patterns)})
    d = once(d, {f"_{name}": tags(c("_text"), rules, c("_begun"), patterns, NEEDS) for name, rules in FAMILIES.items()})
    has = lambda family: F.size(f"_{family}") > 0
    label = lambda family, *names: F.arrays_overlap(F.col(f"_{family}"), F.array(*map(F.lit, names)))
    spend = label("discount", "min_spend")
    paid = label("cash", "cash", "paypal", "prepaid_card")
    amount = label("cash", "cash_amount")
    cash = paid | (amount & ~has("discount") & ~(has("travel") | has("tickets") | has("experience") | has("books")))
    market = label("gift", "amazon_gc") & ~spend
    wanted = cash | has("physical") | has("digital") | market
    row = lambda category, want, priority: F.struct(F.lit(category).alias("category"), F.lit(want).cast("boolean").alias("wanted"), F.lit(priority).cast("int").alias("priority"))
    verdict = (
        F.when(F.trim("_text") == "", row("unknown", None, None))
        .when(cash & label("cash", "prepaid_card"), row("general_gift_card", True, 95))
        .when(cash & label("cash", "paypal"), row("cash", True, 95))
        .when(cash, row("cash", True, 98))
        .when(label("physical", *HIGH), row("physical_good", True, 92))
        .when(label("physical", *USEFUL), row("physical_good", True, 78))
        .when(label("digital", *GAMES), row("digital_game", True, 75))
        .when(has("digital"), row("digital_good", True, 70))
        .when(market, row("general_gift_card", True, 80))
        .when(spend | (has("gift") & has("discount")), row("restricted_gift_card", False, 3))
        .when(has("discount"), row("discount", False, 2))
        .when(has("travel") & ~has("tickets") & ~has("experience"), row("travel", False, 2))
        .when(has("tickets"), row("event_ticket", False, 2))
        .when(label("experience", "wedding"), row("service", False, 1))
        .when(label("experience", "service"), row("service", False, 3))
        .when(has("experience"), row("experience", False, 3))
        .when(label("books", "subscription"), row("subscription", False, 4))
        .when(has("books"), row("books_media", False, 4))
        .when(has("gift"), row("general_gift_card", None, 55))
        .when(amount, row("cash", True, 90))
        .otherwise(row("unknown", None, 50))
    )
    d = d.withColumns({"_v": verdict, f"{prefix}mixed": wanted & (has("travel") | has("tickets") | has("experience") | has("books") | has("discount")), f"{prefix}travel": has("travel"), f"{prefix}spend": spend})
    v = c("_v")
    rank = F.when(v["wanted"].isNull(), 100).when(v["wanted"], 50 - F.least(v["priority"], F.lit(100))).when(v["category"].isin(*FAR), 300 + (10 - F.least(v["priority"], F.lit(10)))).otherwise(200)
    d = d.withColumns({f"{prefix}category": v["category"], f"{prefix}wanted": v["wanted"], f"{prefix}priority": v["priority"], f"{prefix}rank": rank})
    return d.drop("_v", "_text", "_begun", *[f"_{name}" for name in FAMILIES])
