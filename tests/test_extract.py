"""Pages in, fields out: what the rule sets read, by pages written here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import campaigns, extract, urls

INIT = (
    '{"campaign":{"key":"AbCd1","name":"Win a {PS5}","starts_at":1700000000,"ends_at":1700000000000,"site_name":"Shop","terms_and_conditions":"<p>Open worldwide. No purchase is necessary &amp; more</p>","login_first":false,"finished":true},'
    '"incentive":{"actions_required":2,"description":"<b>Nice</b> one"},"entry_methods":[{"entry_type":"email_subscribe","mandatory":true,"requires_authentication":true},{"entry_type":"twitter_retweet","mandatory":false,"worth":3}]}'
)
PAGES = [
    ("concours_du_net", "https://www.concours-du-net.com/", '<div class="home-contest-card"><a href="/jeu-concours-velo">Vélo</a></div><a href="/contact">c</a>', dict(skip=True, follow=["https://www.concours-du-net.com/jeu-concours-velo"])),
    ("concours_du_net", "https://www.concours-du-net.com/jeu-concours-velo", '<h1>Gagnez un vélo</h1><div class="home-contest-prize">1 vélo</div><a href="/x">a</a><a href="/track.php?id=4">Participer</a>', dict(skip=False, title="Gagnez un vélo", prize="1 vélo", entry_url="https://www.concours-du-net.com/track.php?id=4")),
    ("concours_fr", "https://concours.fr/un-jeu/", '<h1 class="entry-title">Un jeu</h1><a href="/autre">Participer</a><a href="https://marque.example/jeu">Participer !</a>', dict(title="Un jeu", entry_url="https://marque.example/jeu")),
    ("echantillonsclub", "https://www.echantillonsclub.com/concours", '<div class="item-list iexpired"><h2><a href="/1-jeu-vieux.html">v</a></h2></div><div class="item-list"><h2><a href="/2-jeu-neuf.html">n</a></h2></div>', dict(skip=True, follow=["https://www.echantillonsclub.com/2-jeu-neuf.html"])),
    ("echantillonsclub", "https://www.echantillonsclub.com/2-jeu-neuf.html", '<h1>Neuf</h1><a href="/url/99">Je joue</a>', dict(skip=False, entry_url="https://www.echantillonsclub.com/url/99")),
    ("giveario", "https://giveario.com/en/giveaways/box", "<h1>Box</h1><dl><dt>Prize</dt><dd>A <b>box</b></dd><dt>Deadline</dt><dd>1 May</dd><dt>Open to</dt><dd>Worldwide</dd><dt>Purchase required</dt><dd>No</dd></dl><p>How to enter</p><p>Fill the form</p><a href='https://brand.example/rules'>Official rules</a><a href='https://brand.example/go'>Enter now</a>", dict(prize="A box", end_date="1 May", restriction="Worldwide", purchase="No", entry_url="https://brand.example/go", terms_url="https://brand.example/rules")),
    ("le_demon_du_jeu", "https://www.ledemondujeu.com/jeux-concours-tele.html", "<h1>Télé</h1><p>Concours ouvert à toute personne résidant en France</p><a href='/toconc.php?i=3'>Voir le concours</a>", dict(restriction="Le concours est ouvert à toute personne résidant en France", entry_url="https://www.ledemondujeu.com/toconc.php?i=3")),
    ("mes_echantillons_gratuits", "https://mesechantillonsgratuits.fr/jeux-concours/mode/", '<div class="col_item"><a href="/jeux-concours/sac-a-main/">Sac</a></div>', dict(skip=True, follow=["https://mesechantillonsgratuits.fr/jeux-concours/sac-a-main/"])),
    ("mes_echantillons_gratuits", "https://mesechantillonsgratuits.fr/jeux-concours/sac-a-main/", "<h1>Sac</h1><a href='https://m.example/'>J'en profite</a>", dict(skip=False, entry_url="https://m.example/")),
    ("online_competition", "https://onlinecompetition.co.uk/competitions/tv", "<h1>TV</h1><p>Promoted by Acme · today</p><h2>The prize</h2><p>A 50in TV</p><p>and a stand</p><h2>Closing date</h2><p>2 June</p><h2>Who can enter</h2><p>UK residents</p><h2>How to enter</h2><p>Answer it</p><h2>Entry limit</h2><p>One</p><p>This competition has closed</p><a href='https://acme.example/tv'>Go to the original competition</a>", dict(prize="A 50in TV and a stand", end_date="2 June", restriction="UK residents", method="Answer it", organizer="Acme", expired=True, free_hint=True, entry_url="https://acme.example/tv")),
    ("prize_runner", "https://prizerunner.co.uk/2026/05/mug/", "<h1>Mug</h1><p>Promoter</p><p>Cup Ltd</p><p>Entry Method</p><p>Website</p><p>Closing Date</p><p>3 July</p><a href='https://cup.example/'>Enter this competition</a>", dict(organizer="Cup Ltd", method="Website", end_date="3 July", free_hint=True, entry_url="https://cup.example/")),
    ("the_prize_finder", "https://www.theprizefinder.com/competitions/hamper", "<h1>Hamper</h1><p>Closing Date: 2026-08-01</p><p>Restriction</p><p>UK only</p><a href='/link-track/7'>View competition</a>", dict(skip=True, end_date="2026-08-01", restriction="UK only", entry_url="https://www.theprizefinder.com/link-track/7")),
    ("the_prize_finder", "https://www.theprizefinder.com/search?keys=worldwide", "<article>UK <a href='/competitions/a'>A</a></article><article>Worldwide <a href='/competitions/b'>B</a></article>", dict(skip=True, follow=["https://www.theprizefinder.com/competitions/b"])),
    ("giveaway_base", "https://giveawaybase.com/win-a-pc/", "<h1>PC</h1><p>GIVEAWAY PRIZE: A PC</p><p>GIVEAWAY END</p><p>9 Sept</p><p>OPEN TO</p><p>United States</p><a href='https://gleam.io/AbCd1/pc'>go</a>", dict(skip=True, prize="A PC", end_date="9 Sept", restriction="United States", entry_url="https://gleam.io/AbCd1/pc")),
    ("gleam", "https://gleam.io/AbCd1/win", f"<div ng-init='initCampaign({INIT})'></div>", dict(skip=False, title="Win a {PS5}", organizer="Shop", restriction="Worldwide", purchase="No", expired=True, free_hint=True, parse_status="ok", entry_url="https://gleam.io/AbCd1/win", method="actions_required=2; mandatory:email_subscribe; optional:twitter_retweet; login_required")),
    ("gleam", "https://gleam.io/AbCd1/win", "<script>var a = 1;\ninitCampaign({\n\"campaign\": {\"key\": \"k1\", \"name\": \"Two\nlines\"}\n", dict(parse_status="payload_missing", parse_reason="invalid JSON/payload")),
    ("gleam", "https://gleam.io/giveaways/AbCd1", '<title>T</title><i data-widget="https://gleam.io/AbCd1/slug"></i>', dict(skip=True, entry_url="https://gleam.io/AbCd1/slug", follow=["https://gleam.io/AbCd1/slug"])),
    ("gleam", "https://gleam.io/privacy", "<h1>p</h1>", dict(skip=True, parse_status=None)),
    ("gleam_giveaways", "https://gleamgiveaways.com/giveaways/cam", "<main><h1>Cam</h1><p>Eligible</p><p>Worldwide</p><p>Category: Gaming</p><p>End date</p><p>5 Oct</p><p>Win $1,000 – $2,000</p><a href='https://swee.ps/x'>Enter</a></main>", dict(restriction="Worldwide", category="Gaming", end_date="5 Oct", prize="$1,000 – $2,000", entry_url="https://swee.ps/x")),
    ("gleam_giveaways", "https://gleamgiveaways.com/giveaways/category/x/", '<div class="gg-card a">US Gaming <a href="/giveaways/one">1</a></div><div class="gg-card b">Worldwide Travel <a href="/giveaways/two">2</a></div><div class="gg-card c">Worldwide Gaming <a href="/giveaways/three">3</a></div>', dict(skip=True, follow=["https://gleamgiveaways.com/giveaways/three"])),
    ("gleam_finder", "https://gleamfinder.com/giveaway/Ab1/cam", "<h1>Cam</h1><p>by Studio</p><p>Ends: 4 Nov</p><p>Open to everyone</p><p>PRIZE</p><p>A cam</p><a href='https://gleam.io/AbCd1/c'>go</a>", dict(organizer="Studio", end_date="4 Nov", prize="A cam", entry_url="https://gleam.io/AbCd1/c")),
    ("sweepwidget", "https://sweepwidget.com/giveaways/101938-ew16zxym", "<h1>Big <i>win</i></h1><p>ENDED on May 3, 2026</p><p>Open worldwide</p><p>1,204 participants</p>", dict(title="Big win", end_date="May 3, 2026", restriction="Open worldwide", expired=True, entry_url="https://sweepwidget.com/giveaways/101938-ew16zxym")),
    ("world_free_prizes", "https://worldfreeprizes.com/giveaways/trip", "<h1>Trip</h1><p>Prize category: Travel</p><p>Ends: 1 Jan</p><a href='https://t.example/'>Visit official page</a>", dict(skip=True, category="Travel", end_date="1 Jan", entry_url="https://t.example/")),
    ("sweepstakes_bible", "https://sweepstakesbible.com/giveaways/cash", "<h1>Cash</h1><p>Prize Type: Cash</p><p>Entry Type: Daily</p><p>End Date: 2 Feb</p><p>Open worldwide</p><a href='https://c.example/'>Enter to win</a>", dict(skip=False, category="Cash", method="Daily", end_date="2 Feb", restriction="Worldwide", entry_url="https://c.example/")),
    ("contestgirl", "https://www.contestgirl.com/sweepstakes/x.pl", "<a href='countHits.pl?chi=1'>t</a>", dict(skip=True, children=None, follow=None)),
    ("contestgirl", "https://www.contestgirl.com/contests/contests.pl?f=s&s=_", "<a href='/contests/contests.pl?p=2'>Next &gt;&gt;</a><a href='/contests/contests.pl?p=3'>3</a><a href='/contests/contests.pl?p=9'>more</a><a href='/contests/contests.pl?p=2'>2</a>", dict(skip=True, children=[], follow=["https://www.contestgirl.com/contests/contests.pl?p=2", "https://www.contestgirl.com/contests/contests.pl?p=3"])),
    ("world_free_prizes", "https://worldfreeprizes.com/country/uk", "<article>Open worldwide. Gaming <a href='/giveaways/one'>1</a></article><article>Travel <a href='/giveaways/two'>2</a></article><a href='/giveaways/three'>3</a>", dict(skip=True, follow=["https://worldfreeprizes.com/giveaways/one"])),
    ("world_free_prizes", "https://worldfreeprizes.com/country/us", "<article>Travel <a href='/giveaways/two'>2</a></article>", dict(skip=True, follow=[])),
    ("world_free_prizes", "https://worldfreeprizes.com/giveaways/pc", "<h1>PC</h1><p>Open worldwide</p><p>Who Can Enter?</p><p>Residents of Malta</p><p>How to Enter</p><a href='https://gleam.io/AbCd1/x'>go</a><a href='https://t.example/'>Visit official page</a>", dict(restriction="Residents of Malta", entry_url="https://gleam.io/AbCd1/x", prize="PC")),
    ("gleam_giveaways", "https://gleamgiveaways.com/giveaways/", '<div class="gg-card"><div>Worldwide</div><div class="gg-card-title">Camera</div><a href="/giveaways/cam">1</a></div><div class="gg-card"><div>US</div><a href="/giveaways/us">1</a></div>', dict(follow=["https://gleamgiveaways.com/giveaways/cam"])),
    (None, "https://any.example/b", "<main>one<main>two</main>three</main><aside>x<aside>y</aside>z</aside>", dict(excerpt="one\ntwo\nthree")),
    (None, "https://any.example/a", "<title>Any</title><nav>menu</nav><main>Hello <b>you</b><script>x()</script></main><a href='/b'>b</a>", dict(skip=False, title="Any", excerpt="Hello\nyou", follow=["https://any.example/b"])),
    ("gleam", "https://gleam.io/AbCd1", None, dict(skip=True)),
]


def test_every_rule_set_reads_its_pages(spark):
    assert {a for a, *_ in PAGES if a} == set(extract.ADAPTERS)
    df = spark.createDataFrame([(i, a, u, h, 200) for i, (a, u, h, _) in enumerate(PAGES)], "page_id long, adapter string, url string, html string, http_status int")
    got = {r.page_id: r.fields for r in extract.extract_fields(df).collect()}
    for i, (adapter, url, _, want) in enumerate(PAGES):
        for name, value in want.items():
            have = got[i][name]
            have = have.replace("\n", " ") if name == "prize" and have else have
            assert have == value, (adapter, url, name, have)


def _one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("html", "title"),
    [
        (f"<div ng-init='initCampaign({INIT})'>", "Win a {PS5}"),
        (f"<script>\n  initCampaign({INIT});\n</script> }} }}", "Win a {PS5}"),
        ('<div ng-init="initCampaign(' + INIT.replace("&", "&amp;").replace('"', "&quot;") + ')">', "Win a {PS5}"),
        ("<p>no call</p>", None),
        ("initCampaign(none)", None),
        ("initCampaign({broken", None),
    ],
)
def test_payload_however_it_is_quoted(spark, html, title):
    assert _one(spark, lambda h: campaigns.described(campaigns.payload(h))["title"], html) == title


def test_failure_reasons(spark):
    url = "https://gleam.io/AbCd1/x"
    rows = [(200, url, None, "other"), (200, url, "  ", "other"), (301, url, "x", "HTTP status 301"), (404, url, "x", "HTTP status 404"), (200, "https://gleam.io/terms", "x", "missing campaign identity"), (200, "https://gleam.io/giveaways/AbCd1", "x", "unsupported directory detail shape"), (200, url, "<meta http-equiv=refresh>", "redirect"), (200, url, "<p>", "no initCampaign payload"), (200, url, "initCampaign({bad})", "invalid JSON/payload"), (200, url, f"initCampaign({INIT})", None)]
    df = spark.createDataFrame(rows, "s int, u string, h string, want string")
    assert [r.x for r in df.select(campaigns.failure_reason(F.col("h"), F.col("s"), F.col("u")).alias("x")).collect()] == [r[3] for r in rows]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://gleam.io/AbCd1/win-it", ("gleam", "AbCd1", "win-it", "https://gleam.io/AbCd1/win-it")),
        ("https://www.gleam.io/AbCd1", ("gleam", "AbCd1", None, "https://gleam.io/AbCd1")),
        ("https://gleam.io/giveaways/AbCd1", ("gleam", "AbCd1", None, "https://gleam.io/giveaways/AbCd1")),
        ("https://sweepwidget.com/c/101938-ew16zxym", ("sweepwidget", "101938", "ew16zxym", "https://sweepwidget.com/giveaways/101938-ew16zxym")),
        ("https://other.example/giveaways/7", ("sweepwidget", "7", None, "https://sweepwidget.com/giveaways/7")),
        *[(f"https://gleam.io/{k}", None) for k in ("privacy", "terms", "security", "guides", "auth", "by", "giveaways", "images", "faq")],
        ("https://example.com/AbCd1/x", None),
    ],
)
def test_platform_identity(spark, url, want):
    got = _one(spark, urls.platform_identity, url)
    assert (got and tuple(got)) == want


def test_directory_cards_and_pages(spark):
    tile = lambda i, t: f'<a class="x" href="/giveaways/{i}"><img src="https://i.example/{i}.png"><p class="preview-tile__title">{t}</p><span class="preview-tile__focusable-sponsor">by Shop &amp; Co</span>3 days left</a>'
    html = tile("aaaa1", "A mug") + tile("bbbb2", "Gaming PC") + tile("aaaa1", "again") + '<a href="/giveaways/cccc3"><img></a>'
    html += '<a href="/giveaways?s=f">ended</a><a href="/giveaways?p=2&amp;s=n">2</a><a href="/giveaways?s=n">n</a><a href="/giveaways">p</a><a href="/giveaways?s=n&p=2#x">2</a><a href="/giveaways?p=x">p</a>'
    df = spark.createDataFrame([(1, "https://gleam.io/giveaways", html)], "page_id long, url string, html string")
    cards = campaigns.directory_cards(df).orderBy("pos").collect()
    assert [(c.id, c.title, c.organizer, c.time_left, c.hinted) for c in cards] == [("bbbb2", "Gaming PC", "Shop & Co", "3 days left", True), ("aaaa1", "A mug", "Shop & Co", "3 days left", False)]
    assert [r.href for r in campaigns.directory_pages(df).orderBy("pos").collect()] == ["https://gleam.io/giveaways", "https://gleam.io/giveaways?s=n", "https://gleam.io/giveaways?s=n&p=2"]
    assert [r.href for r in campaigns.directory_pages(df, 1).collect()] == ["https://gleam.io/giveaways"]


def test_rss_links(spark):
    feed = "<?xml version='1.0'?><rss><channel><link>https://x.example/</link><item><title>a</title><link>/competitions/one</link></item><item><link><![CDATA[https://x.example/competitions/two]]></link></item><item><link>/blog/three</link></item><item><link>/competitions/one</link></item></channel></rss>"
    df = spark.createDataFrame([(1, "https://x.example/rss.xml", feed), (2, "https://x.example/", "<p>no feed</p>")], "page_id long, url string, html string")
    assert [r.href for r in extract.rss_links(df).orderBy("pos").collect()] == ["https://x.example/competitions/one", "https://x.example/competitions/two"]


@pytest.mark.parametrize(
    ("html", "mark", "want"),
    [
        ('<div class="a">x<div>y</div>z</div><div>no</div>', 'class="a"', ['<div class="a">x<div>y</div>z</div>']),
        ("<div id=1><div id=2>b</div></div>", "id", ["<div id=1><div id=2>b</div></div>", "<div id=2>b</div>"]),
        ("<div>open <div>in</div>", "", ["<div>open <div>in</div>", "<div>in</div>"]),
        ("<div/>none<DIV>x</DIV >", "", ["<DIV>x</DIV >"]),
        ("<divan>x</divan>", "", []),
    ],
)
def test_elements_close_where_they_do(spark, html, mark, want):
    got = _one(spark, lambda h: extract.elements(h, "div", mark), html)
    assert [x for x in got if not x.startswith("<div/>")] == want


def test_chrome_goes_with_what_it_nests(spark):
    assert _one(spark, lambda h: extract.without(h, ("nav", "aside")), "a<nav>b<aside>c</aside>d<nav>e</nav></nav>f").split() == ["a", "f"]
    assert _one(spark, lambda h: extract.without(h, ("nav",)), "a<nav>b") == "a<nav>b"


def test_main_text_is_cut_at_a_blank(spark):
    assert _one(spark, lambda h: extract.main_text(h, 12), "<body><header>no</header><article>alpha beta<p>gamma delta</p></article></body>") == "alpha…"
    assert _one(spark, lambda h: extract.main_text(h), "<div role='main'>x &amp; y</div>") == "x & y"


def test_a_page_is_cut_once_for_each_tag_of_its_main_text(spark):
    """A text that an expression reads twice would be made twice: one cut for each tag that may hold the main text, one for the site's own parts."""
    assert str(extract.main_text(F.col("html"))).count("regexp_extract_all") == len(extract.MAIN) + 1


def test_parts_of_tags_end_behind_a_tag_that_closes(spark):
    rows = ["", "a<b<nav c", "a<navx>b<nav\n>c</NAV >d<", "<nav a='<'>b", "x" * 50000 + "<b>" * 50000 + "<nav>y"]
    want = [[""], ["a<b<nav c", ""], ["a<navx>b<nav\n>", "c</NAV >", "d<", ""], ["<nav a='<'>", "b", ""], [rows[4][:-1], "y", ""]]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, h string").select(extract._tag_parts(F.col("h"), "nav|footer").alias("p"))
    assert [r.p for r in got.collect()] == want
