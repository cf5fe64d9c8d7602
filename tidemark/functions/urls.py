"""URLs as columns: canonical form, host, followable links, redirects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and their prefixes.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader", "utm_name", "utm_social", "utm_social-type", "fbclid", "gclid",
    "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "twclid", "li_fat_id", "mc_cid", "mc_eid", "_ga", "_gl", "_hsenc", "_hsmi", "yclid", "igshid", "ncid", "cmpid",
    "mkt_tok",
)
TRACKING_PREFIXES = ("utm_", "mtm_", "pk_")
# File endings and hosts that are never followed.
ASSETS = (
    "css", "js", "mjs", "map", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "avi", "mov", "zip", "rar", "gz", "7z",
    "xml", "json", "rss", "atom",
)
CLOSED_HOSTS = (
    "facebook.com", "fb.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "pinterest.com", "tiktok.com", "youtube.com", "youtu.be", "doubleclick.net",
    "googletagmanager.com", "google-analytics.com", "googleadservices.com",
)
# Letters that trackers spell as marks.
LETTERS = {"!!2": "i", "!!3": "e", "!!4": "r", "!!5": "a"}

# Paths of the first platform's own pages.
RESERVED = (
    "giveaways", "app", "blog", "docs", "help", "tools", "pricing", "integrations", "features", "templates", "partners", "about", "legal", "careers", "contact", "login",
    "signup", "auth", "dashboard", "shopify-install", "cms_pages", "signed-in", "guides", "customers", "success", "security", "privacy", "terms", "faq", "atom",
    "webpack", "images", "by",
)

_WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _decoded(c: Column) -> Column:
    plus = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(F.replace(plus, F.lit(" "), F.lit("%20"))), plus)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_domain(url: Column) -> Column:
    """The lower-cased host; null where there is none."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]*)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def query_pairs(url: Column) -> Column:
    """The query's parameters as an array of (k, v), decoded; blank values stay."""
    items = F.filter(F.split(F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    key = lambda x: F.when(F.contains(x, F.lit("=")), F.substring_index(x, "=", 1)).otherwise(x)
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    return F.transform(items, lambda x: F.struct(_decoded(key(x)).alias("k"), _decoded(value(x)).alias("v")))


def canonical_url(url: Column) -> Column:
    """One form for equal pages: lower-case scheme and host, no default port, fragment or tracking parameters, the others sorted; null for what is no absolute http(s) URL."""
    raw = F.trim(url)
    scheme = F.lower(F.regexp_extract(raw, _WHOLE, 1))
    authority, path = F.regexp_extract(raw, _WHOLE, 2), F.regexp_extract(raw, _WHOLE, 3)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    lower = lambda p: F.lower(p["k"])
    tracks = lambda p: lower(p).isin(*TRACKING) | F.startswith(lower(p), F.lit(TRACKING_PREFIXES[0])) | F.startswith(lower(p), F.lit(TRACKING_PREFIXES[1])) | F.startswith(lower(p), F.lit(TRACKING_PREFIXES[2]))
    kept = F.filter(query_pairs(url), lambda p: ~tracks(p))
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.lower(p["k"]).alias("l"), p["v"].alias("v"), i.alias("i"), p["k"].alias("k"))))
    query = F.array_join(F.transform(ordered, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    built = F.concat(scheme, F.lit("://"), user, url_domain(url), port, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https"), built)


def followable(url: Column, allowed: Column, closed: tuple[str, ...] = tuple(CLOSED_HOSTS)) -> Column:
    """Whether a link leads on: absolute http(s), no asset, no closed host, and within the allowed domains if there are any."""
    host = url_domain(url)
    within = lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))
    path = F.lower(F.regexp_extract(F.trim(url), _WHOLE, 3))
    asset = path.rlike(r"\.(" + "|".join(ASSETS) + ")$")
    shut = F.exists(F.array(*map(F.lit, closed)), within)
    return F.coalesce(F.trim(url).rlike("^(?i)https?://") & ~asset & ~shut & ((F.size(allowed) == 0) | F.exists(allowed, within)), F.lit(False))


def decode_redirect(url: Column, parameter: str = "to") -> Column:
    """The target that a tracker link carries, if it starts with http."""
    raw = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1)
    plain = F.coalesce(F.try_url_decode(raw), raw)
    for token, letter in LETTERS.items():
        plain = F.replace(plain, F.lit(token), F.lit(letter))
    return F.when(F.startswith(plain, F.lit("http")), plain)


def absolute_or_null(base: Column, href: Column) -> Column:
    """A link's target from its page's root; null for links that are neither absolute nor from the root."""
    root = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(root, href))


def platform_identity(url: Column) -> Column:
    """(platform, campaign_id, slug, entry_url) of a campaign URL, else null: a short key under the first platform's host, alone, with a slug, or in its directory; or a number, perhaps with a slug, in the second's two directories on any host."""
    path = F.regexp_extract(F.trim(url), _WHOLE, 3)
    host = F.regexp_replace(url_domain(url), r"^www\.", "")
    directory = F.regexp_extract(path, "^/giveaways/([A-Za-z0-9]{4,12})/?$", 1)
    key = F.regexp_extract(path, r"^/([A-Za-z0-9]{4,12})(?:/[A-Za-z0-9._-]+)?/?$", 1)
    slug = F.nullif(F.regexp_extract(path, r"^/[A-Za-z0-9]{4,12}/([A-Za-z0-9._-]+)/?$", 1), F.lit(""))
    number = F.regexp_extract(path, r"(?i)^/(?:giveaways|c)/(\d+)(?:-[A-Za-z0-9]+)?/?$", 1)
    tail = F.nullif(F.regexp_extract(path, r"(?i)^/(?:giveaways|c)/\d+-([A-Za-z0-9]+)/?$", 1), F.lit(""))
    row = lambda p, i, s, e: F.struct(F.lit(p).alias("platform"), i.alias("campaign_id"), s.alias("slug"), e.alias("entry_url"))
    joined = lambda base, i, mark, s: F.concat(F.lit(base), i, F.coalesce(F.concat(F.lit(mark), s), F.lit("")))
    none = F.lit(None).cast("string")
    first = (host == "gleam.io") | F.endswith(host, F.lit(".gleam.io"))
    return (
        F.when(first & (directory != "") & ~F.lower(directory).isin(*RESERVED), row("gleam", directory, none, F.concat(F.lit("https://gleam.io/giveaways/"), directory)))
        .when(first & (path.rlike("^/giveaways/?$") | (directory != "")), None)
        .when(first & (key != "") & ~F.lower(key).isin(*RESERVED), row("gleam", key, slug, joined("https://gleam.io/", key, "/", slug)))
        .when(number != "", row("sweepwidget", number, tail, joined("https://sweepwidget.com/giveaways/", number, "-", tail)))
    )
