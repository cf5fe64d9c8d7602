"""Cards of listings: where they are open, what they are about, and whether they are worth a visit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hints in a card's category or title, and badges of where it is open.
WANTED = (
    "electronics", "gadget", "gaming", "game", "console", "pc", "computer", "technology", "tech", "smartphone", "tablet", "home", "furniture", "appliance", "kitchen", "tools", "hardware", "cash", "paypal",
    "gift card", "giftcard", "prepaid", "visa", "mastercard", "steam", "playstation", "xbox", "nintendo",
)
UNWANTED = ("travel", "hotel", "flight", "vacation", "holiday", "concert", "ticket", "experience", "escape", "restaurant", "wedding", "crypto", "nft", "course", "book")
WORLDWIDE = r"(?i)\bworldwide\b|\binternational\b|\bopen\s+worldwide\b|\bmonde\s+entier\b"
US_BADGE = r"(?i)\b(?:us|usa|united\s+states)\b(?!\s*/)"
UK_BADGE = r"(?i)\b(?:uk|united\s+kingdom)\b"


def _has(text: Column, hints: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(hints)), F.lit(False))


def is_worldwide(text: Column) -> Column:
    return F.coalesce(text.rlike(WORLDWIDE), F.lit(False))


def us_only(text: Column) -> Column:
    return F.coalesce(text.rlike(US_BADGE), F.lit(False)) & ~is_worldwide(text)


def uk_only(text: Column) -> Column:
    return F.coalesce(text.rlike(UK_BADGE) & ~F.contains(F.lower(text), F.lit("uk/")), F.lit(False)) & ~is_worldwide(text)


def category_wanted(text: Column) -> Column:
    """False with an unwanted hint, true with a wanted one, else null."""
    return F.when(_has(text, UNWANTED), False).when(_has(text, WANTED), True)


def listing_preference(geo: Column, category: Column, title: Column, require_worldwide: bool = True) -> Column:
    """Whether a card is worth a visit: open worldwide, if that is asked for, and of no unwanted category."""
    about = F.concat_ws(" ", F.nullif(F.trim(category), F.lit("")), F.nullif(F.trim(title), F.lit("")))
    wanted = F.coalesce(category_wanted(about), F.lit(True))
    return is_worldwide(geo) & wanted if require_worldwide else wanted
