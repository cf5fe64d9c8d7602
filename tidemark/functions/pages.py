"""Pages as columns: titles, links, hints, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of a link (target, text), of the title element and of the og:title.
ANCHOR = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
OG_TITLE = r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)"


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by newlines; null counts as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def plain(html: Column) -> Column:
    """Text of a piece of markup: no tags, blanks squeezed, the five XML entities resolved."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def page_title(html: Column) -> Column:
    """The title element, else the og:title; null without either."""
    title = F.nullif(plain(F.regexp_extract(html, TITLE, 1)), F.lit(""))
    og = F.nullif(plain(F.regexp_extract(html, OG_TITLE, 1)), F.lit(""))
    return F.coalesce(title, og)


def link_hints(html: Column, limit: int = 40, most: int = 120) -> Column:
    """Texts of the first links, or their targets where they have no text."""
    texts = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    targets = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    pairs = F.slice(F.arrays_zip(texts.alias("t"), targets.alias("h")), 1, limit)
    return F.transform(pairs, lambda p: F.substring(F.coalesce(F.nullif(plain(p["t"]), F.lit("")), p["h"]), 1, most))


def absolute(base: Column, href: Column) -> Column:
    """A link's target seen from its page: absolute, from the scheme, from the root, or beside the page."""
    scheme = F.regexp_extract(base, "^([A-Za-z]+:)", 1)
    root = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, href))


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, href, anchor_text)``: every link of every page, absolute, in order from 0."""
    zipped = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("t"))
    links = pages.select("page_id", "url", F.posexplode(zipped).alias("pos", "link"))
    return links.select("page_id", "pos", absolute(F.col("url"), F.col("link.h")).alias("href"), plain(F.col("link.t")).alias("anchor_text"))
