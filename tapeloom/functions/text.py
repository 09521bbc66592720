"""Text rules on headlines and filings, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def normalize_company(name: Column) -> Column:
    """Lower case without a closing limited or ltd, and without spaces and dots around."""
    x = F.trim(F.lower(name))
    for end in (r" limited$", r" ltd\.$", r" ltd$"):
        x = F.regexp_replace(x, end, "")
    return F.regexp_replace(x, r"^[ .]+|[ .]+$", "")


def ascii_only(t: Column) -> Column:
    return F.regexp_replace(t, r"[^\x00-\x7F]", "?")


def name_tokens(name: Column) -> Column:
    """Words of a name that tell it from others; all of them if there are none."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"([a-z0-9]+)"), F.lit(1))
    own = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(v.GENERIC))
    return F.when(F.size(own) > 0, own).otherwise(words)


def is_relevant(title: Column, name: Column) -> Column:
    """The whole name stands in the title, or two of its tokens begin words there (one, if it has one)."""
    t, tokens = F.lower(title), name_tokens(name)
    hits = F.size(F.filter(tokens, lambda w: F.regexp_like(t, F.concat(F.lit(r"\b"), w))))
    return t.contains(F.lower(F.trim(name))) | (hits >= F.least(F.size(tokens), F.lit(2))) & (F.size(tokens) > 0)


def is_trusted(source: Column) -> Column:
    return F.lower(source).rlike(any_of([re.escape(s) for s in v.TRUSTED]))


def is_roundup(title: Column) -> Column:
    return F.lower(title).rlike(any_of(v.ROUNDUP))


def word_pattern(word: str) -> str:
    return rf"\b{re.escape(word)}(?:s|es|ed|d|ing)?\b"


def word_hits(title: Column, words: list[str]) -> Column:
    """How many of the words stand in the title, inflected or not."""
    t = F.lower(title)
    return reduce(lambda a, b: a + b, [t.rlike(word_pattern(w)).cast("int") for w in words])


def sentiment(title: Column) -> Column:
    return F.when(is_roundup(title), 0).otherwise(F.signum(word_hits(title, v.UP) - word_hits(title, v.DOWN)).cast("int"))


def keyword_hits(text: Column, words: list[str]) -> Column:
    t = F.lower(text)
    return F.filter(F.array(*[F.when(t.contains(w.lower()), F.lit(w)) for w in words]), lambda x: x.isNotNull())


def classify(subject: Column, ladder=None, noise=None) -> Column:
    """struct(polarity, event) of a filing; null for noise and for what no rule knows. The first rule wins."""
    t = F.lower(subject)
    kind = lambda p, e: F.struct(F.lit(p).alias("polarity"), F.lit(e).alias("event"))
    out = F.when(t.rlike(any_of(noise or v.NOISE)), F.lit(None)).when(t.rlike(v.MERGER_APPROVAL), kind("pos", "M&A/JV"))
    for polarity, event, patterns in ladder or v.LADDER:
        out = out.when(t.rlike(any_of(patterns)), kind(polarity, event))
    return out


def catalyst(themes: Column, items: Column, days: Column) -> Column:
    """Score of a company's items: breadth of themes, how recent, how many; 0 without a theme."""
    score = 0.5 * F.least(themes / 3.0, F.lit(1.0)) + 0.3 * F.greatest(1 - days / 60.0, F.lit(0.0)) + 0.2 * F.least(items / 10.0, F.lit(1.0))
    return F.when(themes > 0, score).otherwise(0.0)


def strip_tags(html: Column) -> Column:
    """Text of HTML: tags become spaces, runs of white space one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def table_rows(html: Column) -> Column:
    """Array of rows, each an array of the cells' texts, of all tables in a page."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_tags))


def number(text: Column) -> Column:
    return F.regexp_replace(text, "[,%₹ ]", "").try_cast("double")
