"""Quality rules as a short-circuit cascade.

Each rule is a predicate on a document. What a rule costs and how much it rejects is measured on a sample: seconds after
a warm-up, less those of a query without a rule. The cascade asks the rules in the order of rejections per second, and
computes what a rule needs only for documents that no rule before has rejected. The order changes the cost, never the
verdict: a document is kept if no rule rejects it.

Native: DataFrame functions only. Defined results: null or empty texts have no words and are rejected by
`few_words`; texts of any length are taken whole; equal rows get equal verdicts; an empty table gives an empty result.
`judge` returns the id and its own columns alone, `keep_good` the columns of the table: no name can clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, cut, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[{SPACES}]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of that many words which the text has twice or more.

    Windows are 64-bit hashes. Where all differ, the answer is 0; else (hash, place) pairs are sorted, equal
    neighbours mark the places of repeats, and each place adds the words that the next one does not cover.
    """

    def hashed(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(
            pairs,
            lambda p: F.filter(F.transform(p, lambda x, i: F.when((F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()),
        )
        return let(F.sort_array(repeated), lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x))

    def counted(w: Column) -> Column:
        return let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    # let: the optimizer may put the words' own expression here, which is to run once a text, not once a window.
    return let(words, lambda w: F.when(F.size(w) <= window, 0).otherwise(counted(w))).cast("long")


class Values:
    """What rules ask of a text: expressions that are computed where they are asked for, or columns that are there."""

    def __init__(self, text: Column, known: dict[str, Column] | None = None):
        self.text, self.known = text, known or {}

    def _of(self, name: str, made: Callable[[], Column]) -> Column:
        return self.known[name] if name in self.known else made()

    @property
    def n_words(self) -> Column:
        return self._of("n_words", lambda: F.regexp_count(self.text, F.lit(WORD)).cast("long"))

    @property
    def word_chars(self) -> Column:
        return self._of("word_chars", lambda: word_chars(self.text))

    @property
    def n_symbols(self) -> Column:
        return self._of("n_symbols", lambda: n_symbols(self.text))

    @property
    def n_dup_lines(self) -> Column:
        return self._of("n_dup_lines", lambda: n_dup_lines(self.text))

    @property
    def n_repeat_words(self) -> Column:
        return self._of("n_repeat_words", lambda: n_repeat_words(words_of(self.text)))

    @property
    def n_lines(self) -> Column:
        return F.size(F.split(self.text, "\n", -1))

    def count_of(self, kind: str) -> Column:
        """Characters of a class."""
        return F.char_length(F.regexp_replace(self.text, f"[^{kind}]+", ""))


@dataclass(frozen=True)
class Rule:
    """rejects: whether a document goes, from the values of its text."""

    name: str
    rejects: Callable[[Values], Column]


#: The rules and their thresholds.
BASE = [
    Rule("few_words", lambda v: v.n_words < 10),
    Rule("repeats", lambda v: 100 * v.n_repeat_words > 20 * v.n_words),
]
RULES = [
    *BASE,
    Rule("symbols", lambda v: 10 * v.n_symbols > v.n_words),
    Rule("same_lines", lambda v: 100 * v.n_dup_lines > 30 * v.n_lines),
    Rule("word_length", lambda v: (v.word_chars > 25 * v.n_words) | (v.word_chars < v.n_words)),
    Rule("shouting", lambda v: 2 * v.count_of(r"\p{Lu}") > v.count_of(r"\p{L}")),
    Rule("exclamations", lambda v: 5 * (F.char_length(v.text) - F.char_length(F.translate(v.text, "!", ""))) > v.n_words),
]


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: int
    rows: int


def estimate(df: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = 2000, seed: int = 7, runs: int = 3) -> list[Estimate]:
    """Seconds and rejections of each rule on a sample of about sample_rows rows, written to the shared folder once.

    A rule is asked alone, `runs` times; the first run compiles and counts its rejections, the shortest of the others
    counts, less the shortest of a query that only reads the sample. Neither sample nor clock can change a verdict.
    """
    total = df.count()
    sample = cut(df.select(text_of(df, text_col).alias("t")).sample(min(1.0, sample_rows / max(total, 1)), seed))

    def timed(hit: Column) -> tuple[float, int, int]:
        best = float("inf")
        for run in range(runs):
            began = time.perf_counter()
            # A query of its own each time: one that is run again would reuse the stages of its first run.
            found = sample.select(F.count_if(hit).alias("n"), F.count("*").alias("rows")).first()
            if run:
                best = min(best, time.perf_counter() - began)
        return best, found["n"], found["rows"]

    idle = timed(F.octet_length("t") < 0)[0]
    out = []
    for rule in rules:
        seconds, n, rows = timed(F.coalesce(rule.rejects(Values(F.col("t"))), F.lit(False)))
        out.append(Estimate(rule.name, max(seconds - idle, 1e-4), n, rows))
    return out


def in_order(rules: Sequence[Rule], found: Sequence[Estimate]) -> list[Rule]:
    """The rules by rejections a second, most first; equals in the order given."""
    worth = {e.name: (e.rejected + 0.5) / max(e.rows, 1) / max(e.seconds, 1e-6) for e in found}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules: Sequence[Rule], values: Values) -> Column:
    """Name of the first rule that rejects, in the given order; null if none. CASE asks no rule after the first hit."""
    out = None
    for r in rules:
        hit = F.coalesce(r.rejects(values), F.lit(False))
        out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rejected_by, base_failed, kept): the values of
    every text, the first rule of the cascade that rejects it, whether one of the base rules does, and whether none does."""
    rules = list(rules or RULES)
    ordered = in_order(rules, estimate(df, rules, text_col, sample_rows))
    out = df.select(F.col(id_col), text_of(df, text_col).alias("__text"))
    v = Values(F.col("__text"))
    # The words are split for their windows anyway; their number comes from them.
    out = out.withColumn("__words", words_of(F.col("__text")))
    made = {n: getattr(v, n) for n in MEASURED} | {"n_words": F.size("__words").cast("long"), "n_repeat_words": n_repeat_words(F.col("__words"))}
    out = out.withColumns({f"__{n}": c for n, c in made.items()})
    known = Values(F.col("__text"), {n: F.col(f"__{n}") for n in MEASURED})
    failed = F.lit(False)
    for r in BASE:
        failed = failed | F.coalesce(r.rejects(known), F.lit(False))
    out = out.withColumns({"__by": cascade(ordered, known), "__failed": failed})
    return out.select(F.col(id_col), *[F.col(f"__{n}").alias(n) for n in MEASURED], F.col("__by").alias("rejected_by"), F.col("__failed").alias("base_failed"), (F.col("__by").isNull() & ~F.col("__failed")).alias("kept"))


def keep_good(df: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows that no rule rejects, with the columns of df. A rule's values are computed only for rows that it is asked."""
    rules = list(rules or RULES)
    ordered = in_order(rules, estimate(df, rules, text_col, sample_rows))
    return df.filter(cascade(ordered, Values(text_of(df, text_col))).isNull())
