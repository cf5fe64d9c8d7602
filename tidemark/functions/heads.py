"""Which rules a text can match at all, by the beginnings of its words.

A list of rules tries each of its patterns at every letter of a text, though most texts have no word
that any match could begin with. So the beginnings are looked up in one pass over the text, and a
pattern is tried only where one of its own was seen. That never changes what matches: a rule whose
beginnings are not plain is always tried.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(pattern: str) -> list[str]:
    """The alternatives of a pattern, cut outside of groups and classes."""
    out, depth, inside = [""], 0, False
    for token in re.findall(r"\\.|.", pattern, re.S):
        inside = token == "[" or inside and token != "]"
        depth += not inside and (token == "(") - (token == ")")
        if token == "|" and not depth and not inside:
            out.append("")
        else:
            out[-1] += token
    return out


def _begins(part: str) -> list[str] | None:
    """Plain letters that a match of one alternative begins with, or None."""
    if part.startswith("(?:"):
        # The group ends where its brackets balance.
        end = next(i for i in range(4, len(part) + 1) if part[i - 1] == ")" and part[i - 2] != "\\" and len(_parts(f"{part[:i]}|")) == 2)
        found = [_begins(p) for p in _parts(part[3 : end - 1])]
        if part[end : end + 1] in ("?", "*", "{"):
            found.append(_begins(part[end + 1 :]) if part[end] != "{" else None)
        return None if None in found else [h for f in found for h in f]
    run = re.match(r"[a-z0-9]*", part)[0]
    if part[len(run) : len(run) + 1] in ("?", "*", "{") and part[len(run) :]:
        run = run[:-1]
    return [run] if len(run) > 1 else None


@cache
def heads(pattern: str) -> list[str] | None:
    """What every match of a pattern begins with, at the edge of a word: two letters or more each; None where the pattern does not say."""
    found = [_begins(p[2:] if p.startswith(r"\b") else p[1:]) if p.startswith((r"\b", "^")) else None for p in _parts(pattern)]
    return None if None in found else sorted({h for f in found for h in f})


@cache
def _least(patterns: tuple[str, ...]) -> list[str]:
    """The heads of all patterns, without those that begin with another."""
    every = sorted({h for p in patterns for h in heads(p) or []})
    return [h for h in every if not any(h != x and h.startswith(x) for x in every)]


def head_pattern(patterns: tuple[str, ...]) -> str:
    """A pattern for any head that begins a word."""
    words = _least(patterns)
    by_letter = "|".join(f"{x}(?:{'|'.join(w[1:] for w in words if w[0] == x)})" for x in sorted({w[0] for w in words}))
    return f"(?i)(?<![a-z0-9_])(?:{by_letter})"


def seen(text: Column, patterns: tuple[str, ...]) -> Column:
    """The heads of the patterns that begin a word of a text, in small letters, each once. Make it once (``let``, ``once``) and give it to :func:`holds` with the same patterns."""
    found = F.regexp_extract_all(text, F.lit(head_pattern(patterns)), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def holds(text: Column, pattern: str, begun: Column | None, patterns: tuple[str, ...], flags: str = "") -> Column:
    """Whether a text matches one of the patterns, whose heads were ``begun`` in it (None: not looked up)."""
    own, test = heads(pattern), text.rlike(flags + pattern)
    if begun is None or own is None:
        return test
    least = sorted({w for w in _least(patterns) for h in own if h.startswith(w)})
    return F.when(F.arrays_overlap(begun, F.array(*map(F.lit, least))), test).otherwise(F.lit(False))
