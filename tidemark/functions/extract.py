"""Fields of pages by rules per site, as columns: main text, links, labelled lines, and what each site's pages say.

A site is a row of :data:`SITES`; :func:`extract_fields` reads every page by the rules of its own
site. Pages are only projected, never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import campaigns, listings, pages
from tidemark.functions.logic import let
from tidemark.functions.urls import decode_redirect, platform_identity, url_domain

# Elements that hold a site's own words, and where a page's text is looked for (tag, mark in it).
CHROME = ("svg", "iframe", "nav", "footer", "header", "aside")
_ROLE = r"role=[\"']main[\"']"
MAIN = (("main", ""), ("article", ""), ("div", _ROLE), ("section", _ROLE), ("body", ""))


def _or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def text_lines(html: Column, drop: tuple[str, ...] = ("script", "style", "noscript")) -> Column:
    """The text of a piece of markup: a line for each run of text between tags, blanks squeezed, empty lines left out."""
    bare = F.regexp_replace(html, rf"(?is)<({'|'.join(drop)})\b[^>]*>.*?</\1\s*>|<!--.*?-->", "\n")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(F.regexp_replace(bare, "<[^>]*>", "\n") if entity == "&nbsp;" else bare, F.lit(entity), F.lit(mark))
    lines = F.transform(F.split(bare, r"\R"), lambda x: F.trim(F.regexp_replace(x, r"[ \t ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _tag_parts(html: Column, tags: str) -> Column:
    """The markup cut behind each opening or closing tag of the names; the last part has none."""
    # Runs without a tag's beginning are taken whole, so a page is read once and not tried letter by letter.
    return F.regexp_extract_all(html, F.lit(rf"(?i)[^<]*+(?:<(?!/?(?:{tags})\b[^>]*>)[^<]*+)*+(?:<[^>]*>|\z)"), F.lit(0))


def _step(part: Column, tags: str) -> Column:
    """How a part's tag changes the depth."""
    return F.when(part.rlike(rf"(?is)</(?:{tags})\s*>\z"), -1).when(part.rlike(rf"(?is)<(?:{tags})\b[^>]*(?<!/)>\z"), 1).otherwise(0)


def elements(html: Column, tag: str, mark: str = "", most: int | None = None) -> Column:
    """The elements of a tag whose opening tag matches ``mark``, whole, nested ones of the same tag included, in order; the first ``most`` of them.

    An element ends where as many tags of its name have closed as opened, else where the page does.
    """
    opening = rf"(?is)<{tag}\b[^>]*>\z"

    def cut(parts: Column) -> Column:
        steps = F.transform(parts, lambda x: _step(x, tag))
        starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.coalesce(F.regexp_extract(F.element_at(parts, i), opening, 0).rlike(mark or "<"), F.lit(False)))
        starts = F.slice(starts, 1, most) if most else starts

        def whole(i: Column) -> Column:
            behind = F.aggregate(
                F.slice(steps, i + 1, F.size(parts)),
                F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")),
                lambda a, d: F.when(a["depth"] == 0, a).otherwise(F.struct((a["depth"] + d).alias("depth"), (a["n"] + 1).alias("n"))),
            )
            return F.concat(F.regexp_extract(F.element_at(parts, i), opening, 0), F.array_join(F.slice(parts, i + 1, behind["n"]), ""))

        return F.transform(starts, whole)

    return F.when(~html.rlike(rf"(?i)<{tag}\b[^>]*>"), F.array().cast("array<string>")).otherwise(let(_tag_parts(html, tag), cut))


def inner(html: Column, tag: str, mark: str = "") -> Column:
    """What the first such element holds; null without one."""
    return F.regexp_replace(F.get(elements(html, tag, mark, 1), F.lit(0)), rf"(?is)^<{tag}\b[^>]*>|</{tag}\s*>\z", "")


def without(html: Column, tags: tuple[str, ...]) -> Column:
    """The markup without the elements of these tags, whatever they nest; as it is where their tags do not close."""
    names = "|".join(tags)

    def kept(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
        bare = lambda x: F.regexp_replace(x, rf"(?is)</?(?:{names})\b[^>]*>\z", "\n")
        walk = F.aggregate(parts, start, lambda a, x: F.struct(F.greatest(a["depth"] + _step(x, names), F.lit(0)).alias("depth"), F.when(a["depth"] == 0, F.concat(a["text"], bare(x))).otherwise(a["text"]).alias("text")))
        return let(walk, lambda w: F.when(w["depth"] == 0, w["text"]))

    return F.coalesce(let(_tag_parts(html, names), kept), html)


def main_text(html: Column, max_chars: int = 3000) -> Column:
    """The text of the first of main, article, role=main and body (else of all), without the site's own parts, cut at a blank with an ellipsis."""
    # Each text is made once: what reads it twice would cut the page anew for each reading.
    own = lambda tag, mark: let(inner(html, tag, mark), _or_null)
    found = F.coalesce(*[F.when(html.rlike(mark), own(tag, mark)) if mark else own(tag, mark) for tag, mark in MAIN], html)

    def short(text: Column) -> Column:
        head = F.substring(text, 1, max_chars)
        cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
        return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.rtrim(cut), F.lit("…")))

    return let(text_lines(let(found, lambda x: without(x, CHROME))), short)


def anchors(base: Column, html: Column) -> Column:
    """Links as an array of (href, text), absolute, without fragments, scripts and mail."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pages.ANCHOR), F.lit(1)).alias("h"), F.regexp_extract_all(html, F.lit(pages.ANCHOR), F.lit(2)).alias("t"))
    kept = F.filter(pairs, lambda p: (F.trim(p["h"]) != "") & ~F.trim(p["h"]).rlike("(?i)^(#|javascript:|mailto:)"))
    return F.transform(kept, lambda p: F.struct(pages.absolute(base, F.trim(F.replace(p["h"], F.lit("&amp;"), F.lit("&")))).alias("href"), F.lower(pages.plain(p["t"])).alias("text")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def _inside(url: Column, host: str) -> Column:
    return F.coalesce(url_domain(url).rlike(rf"(^|\.){host.replace('.', '[.]')}$"), F.lit(False))


def first_of(text: Column, patterns: tuple[str, ...], most: int = 300) -> Column:
    """What the first pattern that finds something has in its first group, at most so long."""
    return F.coalesce(*[F.substring(_or_null(F.regexp_extract(text, p, 1)), 1, most) for p in patterns]) if patterns else F.lit(None).cast("string")


def below(label: str) -> tuple[str, ...]:
    """A labelled value: the line below the label, or what follows it behind a colon or bar."""
    return (rf"(?i)(?:^|\n){label}[ \t]*\n[ \t]*([^\n]+)", rf"(?i){label}[ \t]*[:|][ \t]*([^\n]+)")


def section(label: str, *stops: str) -> str:
    """All lines behind a label's line up to a stop label or the end."""
    return rf"(?is)(?:^|\n){label}[ \t]*\n(.+?)(?:\n(?:{'|'.join(stops)})|\z)"


@dataclass(frozen=True)
class Entry:
    """Which link enters an offer: its text and its target match; ``outside`` leaves out the site's own links."""

    text: str = ""
    href: str = ""
    outside: bool = False


@dataclass(frozen=True)
class Site:
    """One site's rules; patterns are over the page's path, its text (a line a run) or its markup."""

    host: str
    detail: str
    not_detail: str = r"(?!)"
    follow: str = ""
    follow_not: str = r"(?!)"
    title: tuple[str, ...] = (r"(?is)<h1[^>]*>(.*?)</h1>",)
    prize: tuple[str, ...] = ()
    end_date: tuple[str, ...] = ()
    organizer: tuple[str, ...] = ()
    restriction: tuple[str, ...] = ()
    method: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    purchase: tuple[str, ...] = ()
    facts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    entry: tuple[Entry, ...] = ()
    terms: str = ""
    closed: str = ""
    free_hint: bool = False
    france: str = ""
    #: Whether a worldwide page is open worldwide "first" of all, or only where no rule says a restriction ("last").
    worldwide: str = ""
    prize_or_title: bool = False
    skip: Callable[[Column, Column, Column], Column] | None = None
    #: The first link that meets any rule enters, not the first rule that any link meets.
    either: bool = False
    #: A listing's cards (tag, mark), the ones worth a visit, on which pages they count, and when all links stand in for them: "none" kept, no "cards", or never.
    card: tuple[str, str] | None = None
    card_kept: Callable[[Column], Column] | None = None
    card_pages: str = ""
    card_else: str = ""
    #: What the offer says of itself, beside its title, prize, category and region; its excerpt and the text that filters read are made of these.
    about: Callable[[Column], Column] | None = None


_PLATFORM_LINK = r"gleam\.io/|sweepwidget\.com/|viralsweep\.com/"


def _abroad(restriction: Column, category: Column, title: Column) -> Column:
    low = F.lower(restriction)
    return low.rlike(r"\b(uk|united kingdom|us|usa|united states|canada|australia)\b") & ~low.rlike("worldwide|international|france")


def _open_to_abroad(restriction: Column, category: Column, title: Column) -> Column:
    return F.lower(restriction).rlike("united states|usa|us only|uk only|united kingdom|canada|australia") & ~listings.is_worldwide(restriction)


def _unwanted(restriction: Column, category: Column, title: Column) -> Column:
    return ~F.coalesce(listings.category_wanted(F.coalesce(category, title)), F.lit(True))


def _unexpired(card: Column) -> Column:
    return ~card.rlike(r"(?i)^<[^>]*\biexpired\b")


def _worldwide_card(card: Column) -> Column:
    return F.lower(pages.plain(card)).rlike("worldwide")


# Categories by which a card is judged instead of by all its words.
_CARD_CATEGORIES = ("electronics", "gadget", "gaming", "home", "furniture", "appliance", "cash", "gift card", "tools")


def _preferred_card(card: Column) -> Column:
    text = F.regexp_replace(card, "<[^>]*>", " ")
    title = pages.plain(F.regexp_extract(card, r"(?is)class=\"[^\"]*gg-card-title[^\"]*\"[^>]*>(.*?)</", 1))
    category = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(x)), F.lit(x)) for x in _CARD_CATEGORIES], text)
    return listings.listing_preference(F.when(text.rlike("Worldwide|\U0001f30d"), "Worldwide"), category, title)


def _wanted_card(card: Column) -> Column:
    """A card with a worldwide badge is open to all, and one without is not asked for it, so only the category decides."""
    return F.coalesce(listings.category_wanted(F.regexp_replace(card, "<[^>]*>", " ")), F.lit(True))


def _blurb(body: Column) -> Column:
    """The text under the offer's own heading, else its first line of twenty characters that is no label."""
    under = F.substring(_or_null(F.regexp_replace(F.regexp_extract(body, r"(?is)About This Giveaway\s*\n(.+?)(?:\n(?:Grand Prize|End date|Eligible|Category)\b|\z)", 1), r"\s+", " ")), 1, 800)
    lines = F.filter(F.split(body, "\n"), lambda x: (F.length(x) >= 20) & ~x.rlike(r"(?i)^(Eligible|Category|End date|Ends|Grand Prize|Single Entry)\b"))
    return F.coalesce(under, F.substring(F.get(lines, F.lit(0)), 1, 500))


def _opening_text(body: Column) -> Column:
    return F.substring(body, 1, 1500)


# Where each site has its offers and how its pages name what they say.
SITES: dict[str, Site] = {
    "concours_du_net": Site(
        host="concours-du-net.com",
        detail=r"(?i)/jeu-concours-[a-z0-9-]+",
        follow=r"(?i)/jeu-concours-[a-z0-9-]+",
        prize=(
            r"(?is)class=\"[^\"]*home-contest-prize[^\"]*\"[^>]*>(.*?)<",
            r"(?is)<h1[^>]*>(.*?)</h1>",
        ),
        entry=(Entry("particip", r"track\.php"), Entry("", r"track\.php")),
    ),
    "concours_fr": Site(
        host="concours.fr",
        detail=r"^/[^/]+",
        not_detail=r"(?i)/wp-content|/wp-includes|/feed/?$|/categorie-|/category/?$",
        follow=r"^/[^/]+",
        follow_not=r"(?i)/wp-content|/wp-includes|/feed/?$|/categorie-",
        entry=(
            Entry("^(participer|je participe)", outside=True),
            Entry("^(participer|je participe)", r"instagram\.com"),
        ),
    ),
    "echantillonsclub": Site(
        host="echantillonsclub.com",
        detail=r"(?i)/\d+-jeu-.+\.html$",
        follow=r"(?i)/\d+-jeu-.+\.html$",
        card=("div", r"class=[\"'][^\"']*\bitem-list\b"),
        card_kept=_unexpired,
        entry=(Entry("", r"/url/"), Entry("je joue|je tente|je profite|participer", r"/url/")),
    ),
    "giveario": Site(
        host="giveario.com",
        detail=r"(?i)^/en/giveaways/[a-z0-9-]+/?$",
        follow=r"(?i)^/en/giveaways/[a-z0-9-]+/?$",
        facts={
            "prize": ("Prize",),
            "end_date": ("Deadline", "Ends"),
            "restriction": ("Open to", "Available in"),
            "purchase": ("Purchase required",),
            "organizer": ("Organizer",),
        },
        method=(r"(?is)(how to enter.{0,588})",),
        entry=(Entry(r"official promotion|^enter( now)?$", outside=True), Entry("visit the official")),
        terms="official rules|terms",
    ),
    "le_demon_du_jeu": Site(
        host="ledemondujeu.com",
        detail=r"(?i)jeux-concours-.+\.html$",
        not_detail=r"nouveaux-jeux-concours|jeux-concours-cloture",
        follow=r"(?i)jeux-concours-.+\.html$|^/concours-",
        title=(
            r"(?is)class=\"[^\"]*bloc-article(?:-text)?-titre[^\"]*\"[^>]*>(.*?)<",
            r"(?is)<h1[^>]*>(.*?)</h1>",
        ),
        entry=(Entry("", r"toconc"), Entry("voir le concours")),
        france=r"(?i)ouvert\s+[àa]\s+toute\s+personne\s+r[eé]sidant\s+en\s+france",
    ),
    "mes_echantillons_gratuits": Site(
        host="mesechantillonsgratuits.fr",
        detail=r"(?i)/jeux-concours/[^/]+/?$",
        not_detail=r"(?i)/jeux-concours/(page/\d+/?|produits-beaute|bebe|parfums|nourriture|voyages|bijoux-accessoires|culture|mode|argent|maisons)/?$",
        follow=r"(?i)/jeux-concours/[^/]+/?$",
        follow_not=r"(?i)/jeux-concours/(page/\d+|produits-beaute|bebe|parfums|nourriture|voyages|bijoux-accessoires|culture|mode|argent|maisons)/?$",
        entry=(Entry("j'en profite|jen profite|je participe|participer", outside=True),),
    ),
    "online_competition": Site(
        host="onlinecompetition.co.uk",
        detail=r"(?i)^/competitions/[a-z0-9-]+/?$",
        follow=r"(?i)^/competitions/[a-z0-9-]+/?$",
        prize=(section("The prize", "Closing date", "Who can enter"),),
        end_date=(r"(?:^|\n)Closing date\n([^\n]+)",),
        restriction=(r"(?:^|\n)Who can enter\n([^\n]+)",),
        method=(section("How to enter", "Entry limit", "Go to"), r"(?i)(website) entry"),
        organizer=(r"Promoted by ([^·\n]+)",),
        purchase=(r"(?i)(no purchase)",),
        entry=(Entry("original competition|go to the original", outside=True),),
        terms="official terms|terms and conditions",
        closed=r"(?i)this competition has closed",
        free_hint=True,
    ),
    "prize_runner": Site(
        host="prizerunner.co.uk",
        detail=r"(?i)^/\d{4}/\d{2}/[a-z0-9-]+/?$",
        follow=r"(?i)^/\d{4}/\d{2}/[a-z0-9-]+/?$",
        organizer=(r"(?:^|\n)Promoter\n([^\n]+)",),
        method=(r"(?:^|\n)Entry Method\n([^\n]+)",),
        end_date=(r"(?:^|\n)Closing Date\n([^\n]+)",),
        entry=(
            Entry(r"enter this competition|^enter( now)?$", outside=True),
            Entry("enter", outside=True),
        ),
        free_hint=True,
    ),
    "the_prize_finder": Site(
        host="theprizefinder.com",
        detail=r"(?i)^/competitions/[a-z0-9-]+/?$",
        not_detail=r"(?i)/(new-competitions|closing-soon|top-prizes|facebook-competitions|twitter-competitions|instagram-competitions|blog-competitions|tv-competitions|daily-entry-competitions)(?:/|$)",
        follow=r"(?i)^/competitions/[a-z0-9-]+/?$",
        follow_not=r"(?i)/(new-competitions|closing-soon|top-prizes)(?:/|$)",
        end_date=(
            r"(?is)field--name-field-closing-date.*?field--item[^>]*>(.*?)<",
            r"Closing Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})",
        ),
        organizer=(r"(?is)field--name-website-name.*?field--item[^>]*>(.*?)<",),
        method=(
            r"(?is)field--name-field-instructions.*?field--item[^>]*>(.*?)<",
            r"(?:^|\n)Instructions\s*\n\s*([^\n]+)",
        ),
        restriction=(
            r"(?is)field--name-field-restriction.*?field--item[^>]*>(.*?)<",
            r"(?:^|\n)Restriction\s*\n\s*([^\n]+)",
        ),
        entry=(Entry("view competition", "link-track"), Entry("", "link-track")),
        skip=_abroad,
        card=("article", ""),
        card_kept=_worldwide_card,
        card_pages="(?i)worldwide",
        card_else="none",
    ),
    "giveaway_base": Site(
        host="giveawaybase.com",
        detail=r"^/[^/]+",
        not_detail=r"(?i)^/category/|/tag/|/page/|/submit|/best-of|/author/",
        follow=r"^/[^/]+",
        follow_not=r"(?i)^/category/|/tag/|/page/|/submit|/best-of|/author/",
        end_date=below("GIVEAWAY END"),
        restriction=below("OPEN TO"),
        prize=below("GIVEAWAY PRIZE"),
        method=(section("GIVEAWAY REQUIREMENTS", "GIVEAWAY ", "OPEN TO"),),
        entry=(
            Entry("", _PLATFORM_LINK + r"|woobox\.com/|kingsumo\.com/"),
            Entry("enter", outside=True),
        ),
        either=True,
        skip=_open_to_abroad,
    ),
    "gleam": Site(
        host="gleam.io",
        detail=r"^/[A-Za-z0-9]{4,12}(?:/[A-Za-z0-9._-]+)?/?$",
        not_detail=r"^/giveaways",
    ),
    "gleam_giveaways": Site(
        host="gleamgiveaways.com",
        detail=r"(?i)/giveaways/[a-z0-9-]+/?$",
        not_detail=r"/giveaways/platform/|/giveaways/category/|/category/|/platforms/",
        follow=r"(?i)/giveaways/[a-z0-9-]+/?$",
        follow_not=r"/giveaways/platform/|/giveaways/category/",
        restriction=(*below("Eligible"), r"(?i)Eligible\s*([^\n]{2,40})"),
        category=below("Category"),
        end_date=(*below("End date"), *below("Ends")),
        prize=(*below("Grand Prize Value"), r"(\$[\d,]+(?:\s*[–-]\s*\$[\d,]+)?)"),
        entry=(Entry("enter", r"^[A-Za-z]+://[^/?#]*+(?!/giveaways/)"), Entry("", _PLATFORM_LINK + r"|wn\.nr/|swee\.ps/")),
        prize_or_title=True,
        either=True,
        about=_blurb,
        card=("div", r"class=[\"'](?:[^\"']* )?gg-card[ \"']"),
        card_kept=_preferred_card,
        card_else="none",
    ),
    "gleam_finder": Site(
        host="gleamfinder.com",
        detail=r"(?i)^/giveaway/[A-Za-z0-9]+/[^/]+/?$",
        follow=r"(?i)^/giveaway/[A-Za-z0-9]+/[^/]+/?$",
        organizer=(r"by\s+([^\n]+)",),
        end_date=(r"(?i)(?:Giveaway runs|Ends?|End date)[:\s]+([^\n]+)",),
        restriction=(r"(?i)(Open [^\n]{0,80})",),
        prize=(r"(?i)(?:^|\n)PRIZE\s*\n([^\n]+)",),
        entry=(Entry("", r"gleam\.io/"), Entry("enter.*gleam|gleam.*enter")),
        either=True,
        about=_opening_text,
        worldwide="first",
    ),
    "sweepwidget": Site(
        host="sweepwidget.com",
        detail=r"(?i)^/(?:giveaways|c)/\d+(?:-[A-Za-z0-9]+)?/?$",
        follow=r"(?i)^/(?:giveaways|c)/\d+(?:-[A-Za-z0-9]+)?/?$",
    ),
    "world_free_prizes": Site(
        host="worldfreeprizes.com",
        detail=r"(?i)^/giveaways/[a-z0-9-]+/?$",
        follow=r"(?i)^/giveaways/[a-z0-9-]+/?$",
        category=(*below("Prize category"), *below("Category")),
        end_date=(*below("Ends"), *below("End date")),
        prize=below("Prize"),
        restriction=(
            section(r"Who Can Enter\?", "How to Enter", "Eligibility"),
            r"(?i)(open (?:to|worldwide)[^\n]{0,120}|legal residents of[^\n]{0,120})",
        ),
        entry=(
            Entry("visit official|continue to official|official giveaway|enter", outside=True),
            Entry("", _PLATFORM_LINK),
        ),
        prize_or_title=True,
        worldwide="last",
        skip=_unwanted,
        either=True,
        card=("article", ""),
        card_kept=_wanted_card,
        card_else="cards",
    ),
    "sweepstakes_bible": Site(
        host="sweepstakesbible.com",
        detail=r"(?i)^/giveaways/[a-z0-9-]+/?$",
        follow=r"(?i)^/giveaways/[a-z0-9-]+/?$",
        category=(r"(?i)Prize Type\s*:\s*([^\n]+)",),
        end_date=(r"(?i)End Date\s*:\s*([^\n]+)",),
        method=(r"(?i)Entry Type\s*:\s*([^\n]+)",),
        entry=(Entry(r"enter to win|^enter$", outside=True), Entry("", _PLATFORM_LINK)),
        either=True,
        worldwide="first",
        skip=_unwanted,
    ),
}

#: A listing's card that is a candidate of its own.
CHILDREN = "array<struct<item: string, url: string, title: string, entry_url: string, excerpt: string, end_date: string, restriction: string, prize: string>>"
FIELDS = {
    "skip": "boolean", "title": "string", "prize": "string", "end_date": "string", "entry_url": "string", "terms_url": "string", "organizer": "string", "restriction": "string", "method": "string", "category": "string",
    "purchase": "string", "excerpt": "string", "expired": "boolean", "free_hint": "boolean", "follow": "array<string>", "parse_status": "string", "parse_reason": "string", "filter_text": "string",
    "actions": "array<struct<entry_type: string, mandatory: boolean>>", "quota": "int", "login": "boolean", "paid": "boolean", "children": CHILDREN,
}


def _fields(**values: Column | None) -> Column:
    one = lambda name, kind: F.lit(None).cast(kind) if values.get(name) is None else values[name].cast(kind)
    return F.struct(*[one(n, kind).alias(n) for n, kind in FIELDS.items()])


def _site_fields(site: Site) -> Column:
    """What a page of the columns url, html, body (its text), path and links says by a site's rules."""
    c = F.col
    html, body, links, path = c("html"), c("_body"), c("_links"), c("_path")
    detail = path.rlike(site.detail) & ~path.rlike(site.not_detail)
    target = lambda a: path_of(a["href"])
    leads = lambda a: target(a).rlike(site.follow) & ~target(a).rlike(site.follow_not) & _inside(a["href"], site.host)
    followed = F.transform(F.filter(links, leads), lambda a: a["href"]) if site.follow else F.array().cast("array<string>")
    if site.card:
        every = followed if site.card_else else F.array().cast("array<string>")
        first = lambda x: F.slice(F.transform(F.filter(anchors(c("url"), x), leads), lambda a: a["href"]), 1, 1)

        def of_cards(found: Column) -> Column:
            kept = F.flatten(F.transform(F.filter(found, site.card_kept), first))
            return F.when(F.size(found if site.card_else == "cards" else kept) > 0, kept).otherwise(every)

        cards_count = c("url").rlike(site.card_pages) if site.card_pages else F.lit(True)
        followed = F.when(cards_count, let(elements(html, *site.card), of_cards)).otherwise(followed)
    found = lambda patterns, most=300: first_of(F.concat_ws("\n", body, html), patterns, most)
    stated = {k: F.coalesce(*[campaigns.fact(html, label) for label in labels]) for k, labels in site.facts.items()}
    value = lambda name, patterns, most=300: F.substring(pages.plain(F.coalesce(stated.get(name, F.lit(None).cast("string")), found(patterns, most))), 1, most)
    title = F.coalesce(*[_or_null(pages.plain(F.regexp_extract(html, p, 1))) for p in site.title], pages.page_title(html))
    category, prize = value("category", site.category), value("prize", site.prize, 500)
    if site.prize_or_title:
        prize = F.coalesce(prize, title)
    restriction = value("restriction", site.restriction, 400)
    if site.france:
        restriction = F.when(body.rlike(site.france), "Le concours est ouvert à toute personne résidant en France")
    if site.worldwide:
        badge = F.when(listings.is_worldwide(body), "Worldwide")
        restriction = F.coalesce(badge, restriction) if site.worldwide == "first" else F.coalesce(restriction, badge)
    hit = lambda e: lambda a: (a["text"].rlike(e.text) if e.text else F.lit(True)) & (a["href"].rlike(e.href) if e.href else F.lit(True)) & (~_inside(a["href"], site.host) if e.outside else F.lit(True))
    either = lambda a: reduce(lambda x, y: x | y, [hit(e)(a) for e in site.entry])
    entries = [F.get(F.filter(links, test), F.lit(0))["href"] for test in ([either] if site.either else map(hit, site.entry))]
    terms = F.get(F.filter(links, lambda a: a["text"].rlike(site.terms) & ~_inside(a["href"], site.host)), F.lit(0))["href"] if site.terms else None
    skip = F.coalesce(site.skip(restriction, category, title), F.lit(False)) if site.skip else F.lit(False)
    excerpt = F.substring(body, 1, 3000)
    if site.about:
        own = campaigns.filter_text(title, F.coalesce(prize, title), category, restriction)
        own = F.concat_ws("\n", _or_null(own), _or_null(site.about(body)))
        excerpt = F.substring(own, 1, 3000)
    said = _fields(
        skip=skip, title=title, prize=prize, end_date=value("end_date", site.end_date, 120), entry_url=F.coalesce(*entries, F.lit(None).cast("string")), terms_url=terms, organizer=value("organizer", site.organizer, 200),
        restriction=restriction, method=value("method", site.method, 600), category=category, purchase=value("purchase", site.purchase, 60), excerpt=excerpt, filter_text=own if site.about else None,
        expired=body.rlike(site.closed) if site.closed else F.lit(False), free_hint=F.lit(True) if site.free_hint else None,
    )
    return F.when(detail, said).otherwise(_fields(skip=F.lit(True), follow=F.array_distinct(followed)))


def _campaign_fields() -> Column:
    """A page of the first platform: its directory, a shell that leads to a campaign, or a campaign."""
    c, html = F.col, F.col("html")
    who = platform_identity(c("url"))
    p = campaigns.payload(html)
    directory, shell = c("_path").rlike("^/giveaways/?$"), c("_path").rlike("^/giveaways/[A-Za-z0-9]{4,12}/?$")
    widget = _or_null(F.regexp_extract(html, r"(?i)data-widget=[\"'](https?://(?:www\.)?gleam\.io/[A-Za-z0-9]{4,12}/[^\"']+)[\"']", 1))

    def read(p: Column, said: Column) -> Column:
        methods = F.coalesce(p["entry_methods"], F.from_json(F.lit("[]"), campaigns.METHODS))
        return _fields(
            skip=F.lit(False), title=said["title"], prize=said["title"], end_date=F.date_format(said["ends_at"], "yyyy-MM-dd'T'HH:mm:ss"), entry_url=who["entry_url"], organizer=said["organizer"], restriction=said["geo"], method=said["instructions"],
            purchase=F.when(said["free"], "No").when(~said["free"], "Yes"), excerpt=said["excerpt"], expired=F.coalesce(said["finished"], F.lit(False)), free_hint=said["free"], parse_status=F.lit("ok"),
            actions=F.transform(methods, lambda m: F.struct(m["entry_type"].alias("entry_type"), m["mandatory"].alias("mandatory"))), quota=said["actions_required"], login=said["login_required"], paid=said["has_paid"],
        )

    campaign = let(p, lambda x: let(campaigns.described(x), lambda said: read(x, said)))
    failed = _fields(skip=F.lit(False), entry_url=F.coalesce(who["entry_url"], c("url")), parse_status=F.lit("payload_missing"), parse_reason=campaigns.failure_reason(html, c("http_status"), c("url")))
    return (
        F.when(directory, _fields(skip=F.lit(True), follow=F.transform(campaigns.cards(html), lambda x: F.concat(F.lit("https://gleam.io/"), x["id"], F.lit("/x")))))
        .when(shell, _fields(skip=F.lit(True), title=pages.page_title(html), entry_url=F.coalesce(widget, F.concat(F.lit("https://gleam.io/"), who["campaign_id"], F.lit("/x"))), follow=F.array(F.coalesce(widget, F.concat(F.lit("https://gleam.io/"), who["campaign_id"], F.lit("/x"))))))
        .when(who.isNull(), _fields(skip=F.lit(True)))
        .when(p.isNotNull(), campaign)
        .otherwise(failed)
    )


# Where the site of cards has its listings, tracker links and pages, and how its text begins a card.
CONTESTS = "contestgirl.com"
_BLOCK = r"\n(?=[A-Z][^\n]{0,80}--[^\n]+)"


def contest_cards(url: Column, html: Column) -> Column:
    """The offers of a listing of tracker links, as :data:`CHILDREN`: each item once, in order.

    A link's title names the block of the page's text that begins with it, whose lines say the end
    date, the restriction and the prize. Of items with one title, the last has the block.
    """
    some = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pages.ANCHOR), F.lit(1)).alias("h"), F.regexp_extract_all(html, F.lit(pages.ANCHOR), F.lit(2)).alias("t"))

    def link(p: Column) -> Column:
        href = pages.absolute(url, F.trim(F.replace(p["h"], F.lit("&amp;"), F.lit("&"))))
        item = F.coalesce(*[some(href, rf"[?&]{key}=(\d+)(?:[&#]|$)") for key in ("chi", "i", "ix")], some(href, r"[?&](?:chi|i|ix)=(\d+)"))
        return F.struct(item.alias("item"), _or_null(pages.plain(p["t"])).alias("title"), decode_redirect(href, "chu").alias("entry"))

    def distinct(found: Column) -> Column:
        ids = F.transform(found, lambda x: x["item"])
        return F.filter(found, lambda x, i: F.array_position(ids, x["item"]) == i + 1)

    hits = F.filter(F.transform(F.filter(pairs, lambda p: F.contains(p["h"], F.lit("countHits.pl"))), link), lambda x: x["item"].isNotNull())
    lines_of = lambda block: F.filter(F.transform(F.split(block, "\n"), F.trim), lambda x: x != "")
    blocks = F.filter(F.transform(F.split(F.substring(text_lines(html), 1, 20000), _BLOCK), lines_of), lambda b: F.size(b) > 0)

    def described(both: Column) -> Column:
        cards, parts = both["cards"], both["blocks"]
        titles = F.transform(cards, lambda x: F.lower(x["title"]))

        def one(x: Column, i: Column) -> Column:
            title = F.lower(x["title"])
            last = ~F.exists(F.slice(titles, i + 2, F.size(titles)), lambda t: F.coalesce(t == title, F.lit(False)))
            own = F.when(last, F.filter(parts, lambda b: F.lower(F.get(b, F.lit(0))) == title))
            said = lambda label: F.trim(F.substring_index(F.try_element_at(F.filter(F.flatten(own), lambda y: F.startswith(F.lower(y), F.lit(label))), F.lit(-1)), ":", -1))
            prizes = F.filter(F.transform(own, lambda b: F.get(F.filter(F.slice(b, 2, F.size(b)), lambda y: F.startswith(F.lower(y), F.lit("enter for a chance"))), F.lit(0))), lambda y: y.isNotNull())
            return F.struct(
                x["item"].alias("item"),
                pages.absolute(url, F.concat(F.lit("/contests/comment.pl?i="), x["item"])).alias("url"),
                x["title"].alias("title"),
                x["entry"].alias("entry_url"),
                F.substring(F.array_join(F.slice(F.try_element_at(own, F.lit(-1)), 1, 12), "\n"), 1, 1500).alias("excerpt"),
                said("end date:").alias("end_date"),
                said("restrictions:").alias("restriction"),
                F.substring(F.try_element_at(prizes, F.lit(-1)), 1, 400).alias("prize"),
            )

        return F.transform(cards, one)

    return let(F.struct(distinct(hits).alias("cards"), blocks.alias("blocks")), described).cast(CHILDREN)


def _contest_fields() -> Column:
    """A page of the site of cards: a listing, whose cards are candidates, leads to its other pages; no page is an offer itself."""
    c = F.col
    closed = F.contains(c("_path"), F.lit("/sweepstakes/"))
    listing = F.contains(c("_path"), F.lit("contests.pl")) | c("_path").rlike("/contests/*$") | c("_path").isin("", "/")
    onward = F.filter(c("_links"), lambda a: F.contains(a["href"], F.lit("contests.pl")) & a["text"].rlike(r"^(next( >>)?|\d+)$") & ~F.contains(a["href"], F.lit("/sweepstakes/")))
    said = _fields(skip=F.lit(True), follow=F.array_distinct(F.transform(onward, lambda a: a["href"])), children=contest_cards(c("url"), c("html")))
    return F.when(~closed & listing, said).otherwise(_fields(skip=F.lit(True)))


def _text_campaign_fields(site: Site) -> Column:
    """A page of the second platform: a campaign by its text, or a directory."""
    t = campaigns.text_campaign(F.col("html"), F.col("_body"))
    who = platform_identity(F.col("url"))
    said = _fields(skip=F.lit(False), title=t["title"], prize=t["prize"], end_date=t["end_date"], entry_url=who["entry_url"], restriction=t["geo"], excerpt=t["excerpt"], expired=t["finished"], parse_status=F.lit("ok"))
    return F.when(F.col("_path").rlike(site.detail), said).otherwise(_site_fields(site))


#: Sites whose pages are read by code of their own; all other rule sets are rows of :data:`SITES`.
OWN = {"gleam": _campaign_fields, "sweepwidget": lambda: _text_campaign_fields(SITES["sweepwidget"]), "contestgirl": _contest_fields}
ADAPTERS = (*SITES, "contestgirl")


@lru_cache(maxsize=4)
def _rules(context: int) -> Column:
    """All rule sets as one column over url, html, http_status, adapter and what :func:`extract_fields` adds; built once a Spark context, since that takes the driver seconds."""
    c = F.col
    plain = _fields(skip=F.lit(False), title=pages.page_title(c("html")), excerpt=main_text(c("html")), follow=F.transform("_links", lambda a: a["href"]))
    said = F.when(c("html").isNull(), _fields(skip=F.lit(True)))
    for key in ADAPTERS:
        said = said.when(c("adapter") == key, OWN[key]() if key in OWN else _site_fields(SITES[key]))
    return F.explode(F.array(said.otherwise(plain)))


def extract_fields(snapshots: DataFrame) -> DataFrame:
    """``snapshots(adapter, url, html, http_status, ..)`` with ``fields``: what the page says by its site's rules (:data:`ADAPTERS`).

    Pages of an adapter without rules have the page's title and main text, and follow all links.
    Null pages say nothing.
    """
    c = F.col
    rows = snapshots.withColumns({"_body": F.substring(text_lines(c("html")), 1, 8000), "_path": path_of(c("url")), "_links": anchors(c("url"), c("html"))})
    return rows.withColumn("fields", _rules(id(snapshots.sparkSession.sparkContext._jsc))).drop("_body", "_path", "_links")


def rss_links(feeds: DataFrame) -> DataFrame:
    """``(page_id, pos, href)``: the links of a feed's items, absolute, those of detail pages, each once and in order, of ``feeds(page_id, url, html)``."""
    items = F.regexp_extract_all("html", F.lit(r"(?is)<item\b[^>]*>.*?<link>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</link>.*?</item>"), F.lit(1))
    links = F.array_distinct(F.transform(items, lambda x: pages.absolute(F.col("url"), F.replace(x, F.lit("&amp;"), F.lit("&")))))
    kept = F.filter(links, lambda x: path_of(x).rlike(SITES["the_prize_finder"].detail))
    return feeds.where(F.col("html").rlike("(?is)^.{0,2000}<rss|<item>")).select("page_id", F.posexplode(kept).alias("pos", "href"))
