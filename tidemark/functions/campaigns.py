"""Campaign pages: labelled values, listing cards, embedded payloads and their actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import RESERVED, absolute_or_null, decode_redirect, platform_identity

METHODS = "array<struct<entry_type: string, mandatory: boolean, worth: int, requires_authentication: boolean, actions_required: int>>"
PAYLOAD = f"""campaign struct<key: string, name: string, starts_at: bigint, ends_at: bigint, site_name: string, site_url: string, terms_and_conditions: string, login_first: boolean,
  login_types: array<string>, require_contact_info: boolean, has_paid_entry_methods: boolean, finished: boolean>,
 incentive struct<name: string, description: string, actions_required: int>,
 entry_methods {METHODS}"""
#: From a page's bootstrap call on: whatever quotes it, over several lines too.
CALL = r"(?s)initCampaign\((.+)"
CARD = r'(?is)<a\s+href="([^"]*)"[^>]*>(.*?)</a>'

# What an action's type says about its category, in order of rank.
CATEGORIES = [
    ("refer|^share_action$", "referral"),
    ("upload|_media$|^submit_content$", "upload"),
    ("email|newsletter", "email"),
    ("twitter|facebook|instagram|tiktok|youtube|spotify|twitch|discord", "social"),
    ("visit", "visit"),
]


def value_after(text: Column, label: str) -> Column:
    """The line below a label, or what follows it after a colon or bar; null without it."""
    below = F.regexp_extract(text, rf"(?is)(?:^|[\n>])\s*{label}\s*(?:[:|]\s*|\n\s*)([^\n<]+)", 1)
    return F.nullif(F.trim(below), F.lit(""))


def fact(html: Column, label: str) -> Column:
    """A definition list's value for a label."""
    return F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<dt[^>]*>\s*{label}\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1)), F.lit(""))


def filter_text(title: Column, prize: Column, category: Column, region: Column) -> Column:
    """Only what belongs to the offer itself, one line each, so that a site's own words can't decide."""
    known = lambda c, prefix="": F.when(F.trim(c) != "", F.concat(F.lit(prefix), F.trim(c)))
    return F.concat_ws("\n", known(title), known(prize), known(category, "Category: "), known(region, "Eligible: "))


def listing_children(pages: DataFrame) -> DataFrame:
    """``(page_id, item, title, target)``: a listing's cards; an item is its id or link, and its first card on a page counts."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(CARD), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(CARD), F.lit(2)).alias("t"))
    cards = pages.select("page_id", "url", F.posexplode(pairs).alias("pos", "c"))
    item = F.coalesce(F.nullif(F.regexp_extract("c.h", r"[?&](?:chi|i|ix)=(\d+)", 1), F.lit("")), F.col("c.h"))
    target = F.coalesce(decode_redirect(F.col("c.h")), absolute_or_null(F.col("url"), F.col("c.h")))
    found = cards.select("page_id", "pos", item.alias("item"), F.trim(F.regexp_replace("c.t", "<[^>]*>", "")).alias("title"), target.alias("target"))
    return found.groupBy("page_id", "item").agg(F.min_by(F.struct("title", "target"), "pos").alias("c")).select("page_id", "item", "c.title", "c.target")


def payload_text(html: Column) -> Column:
    """The markup from the object that a page hands to its script on, entities resolved; null without such a call or object.

    A JSON reader takes the first whole object of it and leaves what follows, so braces and quotes
    inside its strings need no care here.
    """
    text = F.regexp_extract(html, CALL, 1)
    for entity, mark in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*)", 1), F.lit(""))


def payload(html: Column) -> Column:
    """The campaign that a page hands to its script; null if there is none or it can't be read."""
    read = F.from_json(payload_text(html), PAYLOAD)
    return F.when(read["campaign"].isNotNull(), read)


def failure_reason(html: Column, http_status: Column, url: Column) -> Column:
    """Why a page gave no campaign, the first that holds; null if it did."""
    body = F.coalesce(html, F.lit(""))
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    who = platform_identity(url)
    return (
        F.when(~http_status.between(200, 299), F.concat(F.lit("HTTP status "), http_status.cast("string")))
        .when(path.rlike("^/giveaways/[A-Za-z0-9]{4,12}/?$") & who.isNotNull(), "unsupported directory detail shape")
        .when(who.isNull() & ~path.rlike("^/giveaways/?$"), "missing campaign identity")
        .when(body.rlike(r"(?i)http-equiv=[\"']?refresh|window\.location\s*=|meta[^>]+refresh"), "redirect")
        .when(F.trim(body) == "", "other")
        .when(~body.rlike(CALL), "no initCampaign payload")
        .when(payload(html).isNull(), "invalid JSON/payload")
    )


def _moment(at: Column) -> Column:
    """Seconds since 1970; times above ten digits are milliseconds."""
    return F.timestamp_seconds(F.when(at > 10_000_000_000, F.floor(at / 1000)).otherwise(at)).cast("timestamp_ntz")


def _no_markup(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def terms_region(terms: Column) -> Column:
    """(geo, scope) that a campaign's terms state: worldwide, one country only, or the residents of some."""
    low = F.lower(terms)
    row = lambda geo, scope: F.struct(geo.alias("geo"), F.lit(scope).alias("scope"))
    named = F.regexp_extract(terms, r"(?i)(only open to (?:legal\s+)?residents of [^.\n]{3,80})", 1)
    return (
        F.when(low.rlike(r"\bopen worldwide\b|\bworldwide\b.*\bvoid where prohibited\b"), row(F.lit("Worldwide"), "worldwide"))
        .when(low.rlike(r"\buk\s+residents?\s+only\b|\bunited\s+kingdom\s+only\b"), row(F.lit("UK residents only"), "uk"))
        .when(low.rlike(r"\bus\s+residents?\s+only\b|\bunited\s+states\s+(?:residents?\s+)?only\b"), row(F.lit("US residents only"), "us"))
        .when(named != "", row(F.substring(F.trim(named), 1, 300), "specific"))
        .otherwise(row(F.lit(None).cast("string"), "unknown"))
    )


def described(p: Column) -> Column:
    """What a payload says, typed: title, organizer, times, terms, region, login, costs, actions, and summaries of them."""
    k, i = p["campaign"], p["incentive"]
    methods = F.coalesce(p["entry_methods"], F.from_json(F.lit("[]"), METHODS))
    must = F.filter(methods, lambda m: F.coalesce(m["mandatory"], F.lit(False)))
    may = F.filter(methods, lambda m: ~F.coalesce(m["mandatory"], F.lit(False)))
    names = lambda a: F.transform(a, lambda m: F.coalesce(m["entry_type"], F.lit("unknown")))
    of_kind = lambda kind: F.filter(names(methods), lambda t: action_category(t) == kind)
    terms = _no_markup(k["terms_and_conditions"])
    region, paid = terms_region(terms), F.coalesce(k["has_paid_entry_methods"], F.lit(False))
    title = F.coalesce(F.nullif(k["name"], F.lit("")), F.nullif(i["name"], F.lit("")))
    login = F.coalesce(k["login_first"], F.lit(False)) | F.exists(must, lambda m: F.coalesce(m["requires_authentication"], F.lit(False)))
    listed = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, ",")))
    asked = F.when(i["actions_required"].isNotNull(), F.concat(F.lit("actions_required="), i["actions_required"].cast("string")))
    summary = F.concat_ws("; ", asked, listed("mandatory:", names(must)), listed("optional:", F.slice(names(may), 1, 12)), F.when(login, "login_required"), listed("referral:", of_kind("referral")), listed("upload:", of_kind("upload")))
    organizer = F.nullif(k["site_name"], F.lit(""))
    each = lambda label, a: F.array_join(F.transform(F.slice(names(a), 1, 8), lambda t: F.concat(F.lit(label), t)), "\n")
    chunks = [title, F.concat(F.lit("Prize: "), title), F.concat(F.lit("Organizer: "), organizer), F.concat(F.lit("Eligibility: "), region["geo"]), F.substring(terms, 1, 1200), F.nullif(each("Required: ", must), F.lit("")), F.nullif(each("Optional: ", may), F.lit(""))]
    return F.struct(
        F.nullif(k["key"], F.lit("")).alias("campaign_key"),
        title.alias("title"),
        _no_markup(i["description"]).alias("description"),
        organizer.alias("organizer"),
        F.nullif(k["site_url"], F.lit("")).alias("organizer_url"),
        _moment(k["starts_at"]).alias("starts_at"),
        _moment(k["ends_at"]).alias("ends_at"),
        F.substring(k["terms_and_conditions"], 1, 8000).alias("terms_html"),
        F.substring(terms, 1, 4000).alias("terms_text"),
        region["geo"].alias("geo"),
        region["scope"].alias("scope"),
        login.alias("login_required"),
        k["login_types"].alias("login_types"),
        k["require_contact_info"].alias("require_contact_info"),
        paid.alias("has_paid"),
        i["actions_required"].alias("actions_required"),
        F.size(methods).alias("actions"),
        F.size(must).alias("mandatory_actions"),
        F.when(paid, False).when(terms.rlike(r"(?i)no purchase (is )?necessary|no purchase required"), True).alias("free"),
        k["finished"].alias("finished"),
        F.coalesce(F.nullif(summary, F.lit("")), F.lit("gleam_campaign")).alias("instructions"),
        F.substring(F.concat_ws("\n", *chunks), 1, 3000).alias("excerpt"),
    )


def campaign_fields(pages: DataFrame) -> DataFrame:
    """``(page_id, ..)`` with what each page's payload says (:func:`described`); pages without one are left out."""
    read = pages.select("page_id", payload(F.col("html")).alias("p")).where("p IS NOT NULL")
    return read.select("page_id", F.explode(F.array(described(F.col("p")))).alias("d")).select("page_id", "d.*")


# Prizes whose cards come first, and the sorts of the directory's pages.
HINTS = r"(?i)\b(?:ps5|playstation|xbox|nintendo|steam\s*deck|gaming\s*pc|pc|gpu|rtx|radeon|monitor|oled|macbook|laptop|smartphone|iphone|airpods?|headphones?|tv|e-?bike|bike|kitchenaid|appliance|cash|gift\s*card)\b"
SORTS = {"": 0, "n": 1, "e": 2, "s": 3}
_TILE = r"(?is)<a[^>]+href=[\"'](/giveaways/[A-Za-z0-9]{4,12})[\"'][^>]*>(.*?)</a>"


def cards(html: Column) -> Column:
    """A directory's cards as an array of (id, title, organizer, time_left, image_url, hinted): titled ones, each id once, hinted prizes first and else in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(_TILE), F.lit(1)).alias("h"), F.regexp_extract_all(html, F.lit(_TILE), F.lit(2)).alias("b"))
    some = lambda text, pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))

    def card(p: Column, at: Column) -> Column:
        title = _no_markup(some(p["b"], r"(?i)class=[\"']preview-tile__title[\"'][^>]*>\s*([^<]+)\s*<"))
        sponsor = _no_markup(some(p["b"], r"(?i)preview-tile__focusable-sponsor[\"'][^>]*>\s*([^<]+)"))
        return F.struct(
            (~F.coalesce(title.rlike(HINTS), F.lit(False))).cast("int").alias("late"),
            at.alias("at"),
            F.substring_index(p["h"], "/", -1).alias("id"),
            title.alias("title"),
            F.nullif(F.regexp_replace(sponsor, r"(?i)^by\s+", ""), F.lit("")).alias("organizer"),
            some(p["b"], r"(?i)(\d+\s+(?:day|days|month|months|hour|hours)\s+left)").alias("time_left"),
            some(p["b"], r"(?i)(?:srcset|src)=[\"'](https?://[^\"'\s]+)[\"']").alias("image_url"),
        )

    found = F.filter(F.transform(pairs, card), lambda x: x["title"].isNotNull() & ~F.lower(x["id"]).isin(*RESERVED))
    ids = F.transform(found, lambda x: x["id"])
    once = F.filter(found, lambda x, i: F.array_position(ids, x["id"]) == i + 1)
    return F.transform(F.array_sort(once), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["organizer"].alias("organizer"), x["time_left"].alias("time_left"), x["image_url"].alias("image_url"), (x["late"] == 0).alias("hinted")))


def directory_cards(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, id, title, organizer, time_left, image_url, hinted)``: the cards of directory pages."""
    return pages.select("page_id", F.posexplode(cards(F.col("html"))).alias("pos", "c")).select("page_id", "pos", "c.*")


def directory_pages(pages: DataFrame, max_pages: int = 5) -> DataFrame:
    """``(page_id, pos, href)``: the listing pages that a directory page leads to, in canonical form, by (sort, page), at most so many of each page."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)href=[\"']([^\"']*giveaways[^\"']*)[\"']"), F.lit(1))

    def parts(h: Column) -> Column:
        url = absolute_or_null(F.col("url"), F.replace(h, F.lit("&amp;"), F.lit("&")))
        listing = F.coalesce(url.rlike(r"(?i)^https?://(?:www\.)?(?:[a-z0-9-]+\.)*gleam\.io/giveaways/?(?:[?#].*)?$"), F.lit(False))
        sort = F.lower(F.trim(F.regexp_extract(url, r"[?&]s=([^&#]*)", 1)))
        page = F.greatest(F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]p=(\d{1,9})(?:[&#]|$)", 1), F.lit("")).cast("int"), F.lit(1)), F.lit(1))
        rank = F.coalesce(*[F.when(sort == s, F.lit(n)) for s, n in SORTS.items()])
        query = F.concat_ws("&", F.when(sort != "", F.concat(F.lit("s="), sort)), F.when(page > 1, F.concat(F.lit("p="), page.cast("string"))))
        return F.when(listing & rank.isNotNull(), F.struct(rank.alias("rank"), page.alias("page"), F.concat(F.lit("https://gleam.io/giveaways"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")).alias("href")))

    found = F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(hrefs, parts), lambda x: x.isNotNull()))), 1, max_pages)
    return pages.select("page_id", F.posexplode(found).alias("pos", "p")).select("page_id", "pos", "p.href")


def text_campaign(html: Column, body: Column) -> Column:
    """The second platform's campaign page, by its wording: title, prize, dates, region, counts, finished and an excerpt."""
    first = lambda patterns, most: F.coalesce(*[F.substring(_no_markup(F.nullif(F.regexp_extract(html, p, 1), F.lit(""))), 1, most) for p in patterns])
    return F.struct(
        first((r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)property=\"og:title\"\s+content=\"([^\"]+)\""), 500).alias("title"),
        first((r"(?is)(?:Prizes|Prize)[^<]{0,40}</h2>\s*<p[^>]*>(.*?)</p>", r"(?i)(\$\d[\d,]*(?:\.\d+)?\s*(?:Cash|PayPal)?)"), 400).alias("prize"),
        first((r"(?i)ENDED on ([A-Za-z]+ \d{1,2}, \d{4})", r"(?i)Ends?(?: on)?[:\s]+([A-Za-z]+ \d{1,2}, \d{4})", r"(?i)End(?:s| Date)[:\s]+([A-Za-z0-9 ,]+)"), 80).alias("end_date"),
        first((r"(?is)Start Time[^<]*</h2>\s*<p[^>]*>(.*?)</p>",), 80).alias("start_date"),
        html.rlike(r"(?i)\bENDED\b").alias("finished"),
        first((r"(?i)(Open to (?:residents )?worldwide)", r"(?i)(Open worldwide)", r"(?i)(Eligibility[:\s]+[^<\n]{5,120})", r"(?i)(Available (?:to|in) [^<\n]{5,120})", r"(?i)(US(?:A)? (?:residents? )?only)", r"(?i)(UK (?:residents? )?only)"), 300).alias("geo"),
        F.nullif(F.regexp_extract(html, r"(?i)([\d,]+)\s+participants?", 1), F.lit("")).alias("participants"),
        F.nullif(F.regexp_extract(html, r"(?i)([\d,]+)\s+entr(?:y|ies)", 1), F.lit("")).alias("entries"),
        F.substring(F.coalesce(_no_markup(html), F.lit("")), 1, 3000).alias("excerpt"),
    )


def text_campaign_fields(pages: DataFrame) -> DataFrame:
    """``(page_id, campaign_id, entry_url, ..)`` of the second platform's campaign pages (:func:`text_campaign`); the id is the URL's, else that of the page's first campaign link."""
    inner = F.regexp_extract("html", r"/giveaways/(\d+)(?:-[A-Za-z0-9]+)?", 0)
    who = F.coalesce(platform_identity(F.col("url")), platform_identity(F.concat(F.lit("https://sweepwidget.com"), F.nullif(inner, F.lit("")))))
    read = pages.select("page_id", who.alias("w"), F.explode(F.array(text_campaign(F.col("html"), F.col("html")))).alias("t"))
    return read.where("w.platform = 'sweepwidget'").select("page_id", "w.campaign_id", "w.entry_url", "t.*")


def action_category(entry_type: Column) -> Column:
    t = F.lower(entry_type)
    return F.coalesce(*[F.when(t.rlike(pattern), F.lit(name)) for pattern, name in CATEGORIES], F.lit("other"))


def campaign_actions(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, entry_type, mandatory, category)``: the actions of each page's campaign."""
    read = pages.select("page_id", payload(F.col("html")).alias("p")).where("p IS NOT NULL")
    acts = read.select("page_id", F.posexplode("p.entry_methods").alias("pos", "a"))
    return acts.select("page_id", "pos", "a.entry_type", "a.mandatory", action_category(F.col("a.entry_type")).alias("category"))
