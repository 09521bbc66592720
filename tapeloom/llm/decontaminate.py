"""Training texts that hold benchmark items, by BM25 with block-max WAND.

Items are cut into segments of at most `segment` words; the index holds the segments' three-word terms with their BM25
impacts, as shares of the segment's own score, in postings of blocks with each block's largest impact. Every whole text
is a query, as verification takes the whole text, too: all segments at the threshold or above are retrieved, however
far apart their parts stand. A text whose terms' largest impacts sum to less cannot reach any; that bound is computed
for all texts of a chunk at once, and block-max WAND runs on the rest. What it retrieves is verified on the whole text: how much of the item's question
and of its answer (five-word shingles) stands there.

The index of one block of items (bounded bytes) is broadcast at a time; more items take more rounds over the texts. How
many segments there are, how long they are and how many have a term is counted over all items first, so that scores do
not depend on the blocks.

Defined results: null and empty texts and items match nothing; repeated rows each get their matches; an item with
fewer than three words counts as one term; items with equal texts are found alike, each with its own id; texts of any
length are one query; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import cut, small_arrow_batches

TERM, SHINGLE = 3, 5
K1, B = 1.2, 0.75
BLOCK = 64


def _hash(text: str) -> np.ndarray:
    return ta.words([ta.lower(text)], ta.NOT_ALNUM).hash


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of runs of k words; of fewer, the one of all."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    w = ta.Words(words, np.array([0, len(words)]))
    h, inside = w.runs(k)
    return np.unique(h[inside])


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer, what stands before is the question; a single sentence is both."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if re.search(r"\w", p)]
    return (text, text) if len(parts) < 2 else (" ".join(parts[:-1]), parts[-1])


@dataclass
class Part:
    """Distinct runs of a part of an item, and the number of words of a run."""

    runs: np.ndarray
    words: int


def part_of(text: str) -> Part:
    h = _hash(text)
    return Part(_runs(h, SHINGLE), max(1, min(SHINGLE, len(h))))


def segments_of(text: str | None, segment: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words a term, different terms, how often) of each segment of an item."""
    words, out = _hash(text or ""), []
    for s in range(0, len(words), segment):
        part = words[s : s + segment]
        if s and len(part) < TERM:
            continue
        k = min(TERM, len(part))
        h, inside = ta.Words(part, np.array([0, len(part)])).runs(k)
        out.append((k, *np.unique(h[inside], return_counts=True)))
    return out


@dataclass
class Statistics:
    """Over all items: segments, their mean number of terms, and in how many segments each of the terms stands."""

    segments: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


@dataclass
class Item:
    id: int
    parts: list[Part]  # the whole, the question, the answer


class Index:
    """Postings of segments by term, in blocks. impact: BM25 weight as a share of the segment's score for itself."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]], segment: int, counted: Statistics | None = None):
        """counted: what holds for all items, if these are some of them."""
        self.items, seg_item, seg_terms = [], [], []
        for i, text, answer in rows:
            parts = segments_of(text, segment)
            if not parts:
                continue
            q, a = question_and_answer(text) if answer is None else (text, answer)
            self.items.append(Item(i, [part_of(text), part_of(q), part_of(a)]))
            seg_item += [len(self.items) - 1] * len(parts)
            seg_terms += parts
        self.seg_item = np.array(seg_item, np.int64)
        self.lengths = sorted({k for k, _, _ in seg_terms})
        n = len(seg_terms)
        every, df = np.unique(np.concatenate([t for _, t, _ in seg_terms]) if n else np.zeros(0, np.uint64), return_counts=True)
        total, mean = n, np.mean([c.sum() for _, _, c in seg_terms]) if n else 1.0
        if counted is not None:
            total, mean, df = counted.segments, counted.mean, counted.df[np.searchsorted(counted.terms, every)]
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        seg, term, impact = [], [], []
        for s, (_, t, c) in enumerate(seg_terms):
            at = np.searchsorted(every, t)
            w = idf[at] * c * (K1 + 1) / (c + K1 * (1 - B + B * c.sum() / mean))
            seg.append(np.full(len(t), s))
            term.append(at)
            impact.append(w / w.sum())
        self.terms = every
        if n:
            seg, term, impact = np.concatenate(seg), np.concatenate(term), np.concatenate(impact)
            order = np.lexsort((seg, term))
            self.seg, self.impact = seg[order], impact[order]
            self.first = np.searchsorted(term[order], np.arange(len(every) + 1))
            self.most = np.maximum.reduceat(self.impact, self.first[:-1])
            self.block_most = [np.maximum.reduceat(self.impact[a:b], np.arange(0, b - a, BLOCK)) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]

    def retrieve(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Block-max WAND: all segments whose impacts for the terms sum to least or more."""
        lists = [(self.seg[a:b], self.impact[a:b], self.most[t], self.block_most[t]) for t in terms.tolist() for a, b in [(self.first[t], self.first[t + 1])]]
        at = [0] * len(lists)
        alive, out, slack = list(range(len(lists))), [], 1e-9
        while alive:
            alive.sort(key=lambda i: lists[i][0][at[i]])
            bound, pivot = 0.0, None
            for n, i in enumerate(alive):
                bound += lists[i][2]
                if bound >= least - slack:
                    pivot = n
                    break
            if pivot is None:
                return out
            doc = lists[alive[pivot]][0][at[alive[pivot]]]
            while pivot + 1 < len(alive) and lists[alive[pivot + 1]][0][at[alive[pivot + 1]]] == doc:
                pivot += 1
            ahead = alive[: pivot + 1]
            places = [int(np.searchsorted(lists[i][0], doc)) if lists[i][0][at[i]] < doc else at[i] for i in ahead]
            held = [(i, p) for i, p in zip(ahead, places, strict=True) if p < len(lists[i][0])]
            if sum(lists[i][3][p // BLOCK] for i, p in held) >= least - slack:
                score = sum(lists[i][1][p] for i, p in held if lists[i][0][p] == doc)
                if score >= least - slack:
                    out.append((int(doc), float(score)))
                nxt = doc + 1
            else:  # no segment up to the nearest block end can reach the threshold
                ends = [lists[i][0][min((p // BLOCK + 1) * BLOCK, len(lists[i][0])) - 1] for i, p in held]
                later = [lists[i][0][at[i]] for i in alive[pivot + 1 : pivot + 2]]
                nxt = max(doc + 1, min([*(e + 1 for e in ends), *later]))
            for i in ahead:
                at[i] = int(np.searchsorted(lists[i][0], nxt))
            alive = [i for i in alive if at[i] < len(lists[i][0])]
        return out


def _leaks(index, least: float, overlap: float, id_col: str, text_col: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx: Index = index.value
        for ids, texts in ta.chunks(batches, [id_col, text_col]):
            w = ta.words([ta.lower(t) for t in texts], ta.NOT_ALNUM)
            doc, term = [], []
            for k in idx.lengths:
                h, inside = w.runs(k)
                at = np.minimum(np.searchsorted(idx.terms, h), len(idx.terms) - 1)
                hit = np.flatnonzero(inside & (idx.terms[at] == h))
                doc, term = [*doc, np.searchsorted(w.first, hit, "right") - 1], [*term, at[hit]]
            doc, term = np.concatenate(doc), np.concatenate(term)
            if not len(doc):
                continue
            doc, term = np.unique(np.stack([doc, term]), axis=1)
            cuts = np.flatnonzero(np.diff(doc, prepend=-1))
            able = np.add.reduceat(idx.most[term], cuts) >= least - 1e-9
            ends = np.append(cuts[1:], len(doc))
            best: dict[tuple[int, int], float] = {}
            for a, b in zip(cuts[able].tolist(), ends[able].tolist(), strict=True):
                for s, score in idx.retrieve(term[a:b], least):
                    at = int(doc[a]), int(idx.seg_item[s])
                    best[at] = max(best.get(at, 0.0), score)
            out, last, grams = [], -1, {}
            for (d, i), score in sorted(best.items()):
                if d != last:
                    words, last, grams = w.hash[w.first[d] : w.first[d + 1]], d, {}
                item = idx.items[i]

                got = []
                for x in item.parts:
                    if x.words not in grams:
                        grams[x.words] = _runs(words, x.words)
                    got.append(float(np.isin(x.runs, grams[x.words]).mean()) if len(x.runs) else 1.0)
                if got[0] >= overlap and min(got[1:]) >= overlap / 2:
                    out.append((ids[d], item.id, min(score, 1.0), *got))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in enumerate(kinds)], names=[id_col, "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

    return of


def _terms(segment: int):
    """(block, term) once a segment, and a row without term for each segment's number of terms."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, texts in ta.chunks(batches, ["block", "t"]):
            block, term, size = [], [], []
            for b, t in zip(blocks, texts, strict=True):
                for _, terms, n in segments_of(t, segment):
                    block += [b] * (len(terms) + 1)
                    term += [*terms.view(np.int64).tolist(), None]
                    size += [*[None] * len(terms), int(n.sum())]
            yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "term": pa.array(term, pa.int64()), "size": pa.array(size, pa.int64())})

    return of


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, segment: int = 96, least: float = 0.5, overlap: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """(id, item_id, score, overlap, question_overlap, answer_overlap): which rows hold which items.

    least: BM25 score of retrieval, as a share of the segment's score for itself. overlap: share of the item's
    shingles that must stand in the text (half of it for the question and the answer each).
    """
    spark = df.sparkSession
    small_arrow_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"), answer.alias("a"))
    size = items.agg(F.sum(F.octet_length(F.coalesce("t", F.lit("")))).alias("n")).first()["n"] or 0
    blocks = int(size // block_bytes) + 1
    items = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    terms = cut(items.select("block", "t").mapInArrow(_terms(segment), "block long, term long, size long"))
    all_of = terms.agg(F.count("size").alias("n"), F.sum("size").alias("size")).first()
    found = terms.filter("term is not null").groupBy("term", "block").agg(F.count("*").alias("n"))
    df_of = cut(found.join(found.groupBy("term").agg(F.sum("n").alias("df")), "term").select("block", "term", "df"))
    out = spark.createDataFrame([], f"{id_col} long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
    for b in range(blocks):
        rows = items.filter(F.col("block") == b).select("i", "t", "a").collect()  # block_bytes or so
        mine = df_of.filter(F.col("block") == b).select("term", "df").toPandas()  # the terms of these items
        term = mine["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(term)
        counted = Statistics(all_of["n"], (all_of["size"] or 0) / max(all_of["n"], 1), term[order], mine["df"].to_numpy(np.int64)[order])
        index = Index(sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), segment, counted)
        if len(index.terms):
            out = out.unionByName(docs.mapInArrow(_leaks(spark.sparkContext.broadcast(index), least, overlap, id_col, text_col), out.schema))
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of df that hold no item, with the columns of df. Rows are told by their text (a 64-bit hash), not by id:
    ids may be missing or repeat, and rows of one text leak alike."""
    text = F.xxhash64(df[text_col].cast("string"))
    found = cut(leaks(df.select(text.alias("__text"), text_col), benchmark, "__text", text_col, **settings).select(F.col("__text").alias("__found")).distinct())
    return df.join(found, text == found["__found"], "left_anti").select(*df.columns)
