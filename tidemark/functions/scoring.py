"""Scoring texts by weighted vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with marks and their plain forms.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# The vocabulary, already in plain letters.
STRONG = [
    "jeu concours", "tirage au sort", "a gagner", "reglement du jeu", "sans obligation d'achat", "sans obligation d achat", "participez maintenant", "tentez votre chance",
    "enter now", "no purchase necessary", "official rules", "sweep stakes", "sweepstakes", "prize draw", "free entry",
    "concours", "gagner", "gagnez", "remportez", "remporter", "cadeau", "participez", "participer", "participation", "loterie",
    "giveaway", "giveaways", "sweepstake", "contest", "contests", "prize", "prizes", "competition", "competitions",
]
#: Terms that the list states twice once letters are plain, or in both of its halves, count twice.
TWICE = ["a gagner", "reglement du jeu", "sweepstakes"]
WEAK = ["win", "wins", "won", "enter"]
DEADLINE = ["date limite", "closes on", "closing date", "ends on", "end date", "expire", "expires", "jusqu'au", "jusqu au", "avant le", "valid until", "deadline"]
ENTRY = ["remplir le formulaire", "fill out the form", "fill in the form", "enter your email", "saisir votre email", "saisissez votre", "pour participer", "to enter", "how to enter", "comment participer", "inscription", "submit your entry"]
TERMS = ["reglement", "terms", "rules", "conditions", "official rules", "modalites"]
TERMS_IN_TEXT = ["reglement", "reglement du jeu", "official rules", "terms and conditions"]


def normalize_text(c: Column) -> Column:
    """Lower-case, without marks on Latin letters; null is empty."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), _MARKED, _PLAIN)


def edge_pattern(word: str) -> str:
    """A whole word; a hyphen glues it to its neighbour."""
    return f"(^|[^a-z0-9-]){word}($|[^a-z0-9-])"


def has_word(text: Column, word: str) -> Column:
    """Whether :func:`edge_pattern` is in the text. The pattern begins with the word itself, so the engine searches for it and looks at its edges only where it stands."""
    return text.rlike(f"{word}(?<![a-z0-9-]{word})(?![a-z0-9-])")


def has_phrase(text: Column, phrase: str) -> Column:
    """Phrases of several words anywhere, single words whole."""
    return F.contains(text, F.lit(phrase)) if " " in phrase or "'" in phrase else has_word(text, phrase)


def phrase_hits(text: Column, phrases: list[str], twice: list[str] = ()) -> Column:
    """How many of the phrases a normalised text has."""
    return sum((has_phrase(text, p).cast("int") * (2 if p in twice else 1) for p in phrases), F.lit(0))


def any_phrase(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | has_phrase(text, p)
    return out


def tag_patterns(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of the rules whose pattern a text matches, in the rules' order."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(label)) for pattern, label in rules]))


def words_of(text: Column) -> Column:
    """The distinct words of a normalised text; a hyphen glues."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9-]+"), F.lit(0)))


def found_terms(text: Column, words: Column, phrases: list[str]) -> Column:
    """The phrases that a text has, in the order of the list: single words by its set of words, others by substring."""
    glued = [p for p in phrases if " " in p or "'" in p]
    single = F.array_intersect(F.array(*[F.lit(p) for p in phrases if p not in glued]), words)
    return F.concat(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in glued]).cast("array<string>")), single)


def score_evidence(url: Column, title: Column, content: Column, anchor: Column, links: Column) -> Column:
    """What of a page is scored, of normalised texts: an evidence struct. Each text is split once."""
    split = lambda c: F.struct(c.alias("text"), words_of(c).alias("words"))
    one = F.transform(F.array(F.struct(*[split(c).alias(n) for n, c in (("url", url), ("title", title), ("content", content), ("anchor", anchor), ("links", links))])), _evidence)
    return F.get(one, F.lit(0))


def _evidence(t: Column) -> Column:
    terms = lambda part, phrases: found_terms(t[part]["text"], t[part]["words"], phrases)
    has = lambda part, phrases: F.size(terms(part, phrases)) > 0
    strong = terms("content", STRONG)
    twice = F.size(F.array_intersect(strong, F.array(*map(F.lit, TWICE))))
    in_title = terms("title", STRONG)
    return F.struct(
        has("url", STRONG).alias("in_url"),
        (F.size(in_title) > 0).alias("in_title"),
        has("anchor", STRONG).alias("in_anchor"),
        (has("links", TERMS) | has("content", TERMS_IN_TEXT)).alias("terms"),
        has("content", DEADLINE).alias("deadline"),
        has("content", ENTRY).alias("entry"),
        (F.size(strong) + twice).alias("strong"),
        F.size(terms("content", WEAK)).alias("weak"),
        F.slice(F.array_distinct(F.concat(in_title, strong)), 1, 20).alias("matched"),
    )


def score_of(e: Column) -> Column:
    """The weighted score of a page's evidence, from 0 to 1."""
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    strong, weak = e["strong"], e["weak"]
    body = F.when(strong >= 3, 0.26).when(strong == 2, 0.14).when(strong == 1, 0.06).otherwise(0.0)
    faint = F.when(weak == 0, 0.0).when(strong == 0, F.least(0.05 * weak, F.lit(0.08))).otherwise(F.least(0.02 * weak, F.lit(0.05)))
    total = points(e["in_url"], 0.30) + points(e["in_title"], 0.22) + points(e["in_anchor"], 0.10) + body + faint + points(e["terms"], 0.16) + points(e["deadline"], 0.14) + points(e["entry"], 0.14)
    return F.least(F.when(~(e["in_url"] | e["terms"] | e["deadline"] | e["entry"]) & (strong < 3), total * 0.85).otherwise(total), F.lit(1.0))


def score_candidates(rows: DataFrame, url: Column, title: Column, content: Column, anchor: Column, links: Column) -> DataFrame:
    """``rows`` with ``evidence`` and ``score``. The evidence is a generator's column, so it is made once a row however often it is read."""
    return rows.withColumn("evidence", F.explode(F.array(score_evidence(url, title, content, anchor, links)))).withColumn("score", score_of(F.col("evidence")))
