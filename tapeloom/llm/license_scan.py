"""Licences in texts, by a positional index of rare words.

Templates are licence statements and whole licence texts. Of each, the words that are rarest in the scanned corpus (its
document frequencies are counted over all texts) are the ones worth looking up: their postings say in which templates they
stand and where. A text's occurrences of such words are intersected by relative position: each says where the template
would begin, and those that agree within a band vote for that place. The band is a fifth of the template, so that words
put in or left out on the way move later votes but do not lose them. A place with the votes of half of the rare words
is verified: one of the template's mandatory phrases must stand there, and the words it shares with the template in the same
order must carry most of the template's weight.

Besides, base phrases are counted wherever their words stand consecutively.

Words are runs of ASCII letters and digits, lower-cased, and of all characters beyond ASCII. Defined results: a null or
empty text has no words, no labels and score 0; texts of any length are taken whole; of words equally rare those of the
smaller hash are looked up; repeated rows get equal results; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import small_arrow_batches
from .license_texts import BASE, TEMPLATES

def hashed(text: str) -> np.ndarray:
    return ta.words([ta.lower(text)], ta.NOT_ALNUM).hash


@dataclass
class Index:
    """Postings of the rarest words of each template: word hash -> (template, place).

    Words that no text has are not looked up, and templates that lack too much of their weight by them are left out.
    """

    templates: list[tuple[str, np.ndarray, list[np.ndarray]]]
    weight: dict[int, float]
    unseen: set[int]
    least: float
    rare: int = 5
    every: int = 12
    words: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    template: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    weights: list[np.ndarray] = field(init=False)
    votes: np.ndarray = field(init=False)
    slack: np.ndarray = field(init=False)

    def __post_init__(self):
        rows, votes = [], []
        self.weights = [np.array([self.weight[w] for w in words.tolist()]) for _, words, _ in self.templates]
        self.slack = np.array([max(2, len(words) // 5) for _, words, _ in self.templates])
        for t, (_, words, _) in enumerate(self.templates):
            seen = np.array([w not in self.unseen for w in words.tolist()])
            able = self.weights[t][seen].sum() >= self.least * self.weights[t].sum()
            best = sorted(set(words[seen].tolist()), key=lambda w: (-self.weight[w], w))[: max(self.rare, len(words) // self.every)] if able else []
            rows += [(int(w), t, p) for p, w in enumerate(words) if int(w) in best]
            votes.append(max(1, (len(best) + 1) // 2))
        rows.sort()
        self.votes = np.array(votes)
        self.words, self.first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
        self.first = np.append(self.first, len(rows))
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)

    def matches(self, words: ta.Words) -> list[tuple[int, int, int, float]]:
        """(text, template, place in the text, share of the template's weight) of all verified places."""
        h = words.hash
        if not len(self.words):
            return []
        at = np.searchsorted(self.words, h)
        hit = np.flatnonzero(self.words[np.minimum(at, len(self.words) - 1)] == h)
        if not len(hit):
            return []
        n = (self.first[at[hit] + 1] - self.first[at[hit]]).astype(np.int64)
        posting = np.arange(int(n.sum())) + np.repeat(self.first[at[hit]] - (np.cumsum(n) - n), n)
        where = np.repeat(hit, n)
        doc, template = np.searchsorted(words.first, where, "right") - 1, self.template[posting]
        begin = where - self.place[posting]
        order = np.lexsort((begin, template, doc))
        doc, template, begin, word = doc[order], template[order], begin[order], h[where][order]
        # One ascending key: places of different (text, template) are further apart than any band.
        group = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(template) != 0)]))
        key = group * (len(h) + 2 * int(max(map(len, self.weights), default=0)) + int(self.slack.max()) + 2) + begin
        end = np.searchsorted(key, key + self.slack[template], "right")
        enough = (end - np.arange(len(key)) >= self.votes[template]) & np.concatenate([[True], np.diff(key) != 0])
        out, last, free = [], -1, 0
        for i in np.flatnonzero(enough).tolist():
            d, t, b, e = int(doc[i]), int(template[i]), int(begin[i]), int(end[i])
            if group[i] == last and b < free or len(np.unique(word[i:e])) < self.votes[t]:
                continue
            lo, hi = int(words.first[d]), int(words.first[d + 1])
            places, votes = np.unique(begin[i:e], return_counts=True)
            place = int(places[votes.argmax()])
            share = self._share(t, h[lo:hi], b - lo, place - lo)
            if share >= self.least:
                out.append((d, t, max(place - lo, 0), share))
                last, free = group[i], place + len(self.weights[t]) // 2 + 1
        return out

    def _share(self, t: int, text: np.ndarray, b: int, place: int) -> float:
        """Share of the template's weight that stands in its order in the band from b, 0 without a mandatory phrase."""
        _, need, phrases = self.templates[t]
        w = self.weights[t]
        if place >= 0 and np.array_equal(text[place : place + len(need)], need):
            return 1.0
        band = text[max(b, 0) : b + len(need) + int(self.slack[t])]
        if not any(len(starts(p, band)) for p in phrases) or w[np.isin(need, band)].sum() < self.least * w.sum():
            return 0.0
        best = np.zeros(len(band) + 1)
        for x, weight in zip(need, w, strict=True):  # the heaviest common subsequence, one word of the template a step
            best[1:] = np.maximum(best[1:], best[:-1] + weight * (band == x))
            best = np.maximum.accumulate(best)
        return float(min(best[-1] / w.sum(), 1.0))


def starts(phrase: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively."""
    at = np.flatnonzero(words[: max(len(words) - len(phrase) + 1, 0)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def _frequencies(vocabulary: np.ndarray, text_col: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(vocabulary), np.int64), 0
        for (texts,) in ta.chunks(batches, [text_col]):
            w = ta.words([ta.lower(t) for t in texts], ta.NOT_ALNUM)
            at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
            hit = vocabulary[at] == w.hash
            pairs = np.unique(w.doc()[hit] * len(vocabulary) + at[hit])
            np.add.at(counts, pairs % len(vocabulary), 1)
            n += len(texts)
        yield pa.RecordBatch.from_pydict({"word": pa.array([-1, *range(len(vocabulary))], pa.int64()), "n": pa.array([n, *counts], pa.int64())})

    return of


def build_index(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, least: float = 0.6) -> Index:
    """The index, with words weighed by their rarity among all texts: a count for each word of the templates."""
    parsed = [(label, hashed(text), [hashed(p) for p in phrases]) for label, text, phrases in templates]
    vocabulary = np.unique(np.concatenate([w for _, w, _ in parsed]))
    rows = docs.select(text_col).mapInArrow(_frequencies(vocabulary, text_col), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    total = n.get(-1, 0)
    weight = {int(w): float(np.log((total + 2) / (n.get(i, 0) + 1))) for i, w in enumerate(vocabulary)}
    return Index(parsed, weight, {int(w) for i, w in enumerate(vocabulary) if not n.get(i)}, least)


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,share:double>>"


def _scan(index, base: dict[str, str], id_col: str, text_col: str):
    phrases = [(hashed(p), label) for p, label in base.items()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index.value
        for ids, texts in ta.chunks(batches, [id_col, text_col]):
            w = ta.words([ta.lower(t) for t in texts], ta.NOT_ALNUM)
            base_at: list[list[tuple[int, str]]] = [[] for _ in texts]
            for need, label in phrases:
                places = starts(need, w.hash)
                doc = np.searchsorted(w.first, places, "right") - 1
                for d, p in zip(doc.tolist(), places.tolist(), strict=True):
                    if p + len(need) <= w.first[d + 1]:
                        base_at[d].append((p - int(w.first[d]), label))
            spans: list[list[dict]] = [[] for _ in texts]
            for d, t, p, share in idx.matches(w):
                spans[d].append({"label": idx.templates[t][0], "word": p, "share": share})
            rows = {n: [] for n in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for i, n, b, s in zip(ids, w.counts().tolist(), base_at, spans, strict=True):
                of_base = {x for _, x in b}
                score = max([x["share"] for x in s] + [0.5 if b else 0.0])
                for name, v in zip(rows, (i, n, len(b), min((p for p, _ in b), default=None), max((p for p, _ in b), default=None), ",".join(sorted(of_base)), ",".join(sorted(of_base | {x["label"] for x in s})), min(score, 1.0), s), strict=True):
                    rows[name].append(v)
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in rows.items()})

    return of


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row.

    spans: the verified places of templates, with the share of the template's weight that matches. score: the largest
    share; 0.5 at least where a base phrase stands.
    """
    small_arrow_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    index = df.sparkSession.sparkContext.broadcast(build_index(docs, text_col, templates, least))
    return docs.mapInArrow(_scan(index, dict(base), id_col, text_col), OUT).withColumnRenamed("doc_id", id_col)
