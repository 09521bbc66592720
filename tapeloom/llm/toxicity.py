"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, word pairs and pairs that skip a word, hashed into 2^bits places.
FTRL-proximal keeps a learning rate for every place and sets weights whose evidence stays below the L1 bound to 0, so
that what is left is a small table, which is broadcast and applied to every text.

The model is fitted on a bounded sample of labelled rows (`max_rows`, half of it at most of each label, chosen by a
hash of the id): one task reads the sample's features and makes the passes. Everything else covers all rows.

Defined results: null and empty texts have no features and get the score of the bias; rows without a label or with a
null one are not learnt from; of several labels of an id the largest counts; without any labelled row all scores are
0; extra columns are ignored; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import cut, small_arrow_batches


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1_share: float = 0.0015  # the L1 bound, as a share of the rows learnt from
    l2: float = 0.0
    passes: int = 12
    max_rows: int = 12_000


def features(words: ta.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of all texts, and the text of each, repeats included."""
    h, doc = words.hash, words.doc()
    out, of = [h], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            out.append(ta._mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
            of.append(doc[:-gap][same])
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


def fit(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias after passes over (distinct feature places, label) in the order given."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    bias, l1 = 1 << s.bits, s.l1_share * len(rows)

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        w[np.abs(zs) <= l1] = 0.0
        return w

    for _ in range(s.passes):
        for places, label in rows:
            at = np.append(places, bias)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(np.arange(bias + 1))
    kept = np.flatnonzero(w[:bias])
    return kept, w[kept], float(w[bias])


def _bag(bits: int, text_col: str):
    """(lot, label, places): distinct feature places of labelled texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lots, labels, texts in ta.chunks(batches, ["lot", "label", text_col]):
            place, doc = features(ta.words([ta.lower(t) for t in texts], ta.NOT_ALNUM), bits)
            both = np.unique(doc << bits | place)
            ends = np.searchsorted(both, np.arange(len(texts) + 1) << bits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(lots, pa.int64()), pa.array(labels, pa.int32()), pa.ListArray.from_arrays(ends, pa.array((both & ((1 << bits) - 1)).astype(np.int32)))], names=["lot", "label", "places"])

    return of


def _fit_all(s: Settings):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            lots, labels, places = b.column("lot").to_pylist(), b.column("label").to_pylist(), b.column("places")
            rows += [(lot, y, places[i].values.to_numpy()) for i, (lot, y) in enumerate(zip(lots, labels, strict=True))]
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        if rows:
            at, w, bias = fit([(p.astype(np.int64), y) for _, y, p in rows], s)
            yield pa.RecordBatch.from_pydict({"place": pa.array([-1, *at], pa.int64()), "weight": pa.array([bias, *w], pa.float64())})

    return of


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", eligible: Column | None = None) -> DataFrame:
    """(place, weight) of the fitted model; place -1 is the bias. eligible: which ids may be learnt from."""
    small_arrow_batches(docs.sparkSession)
    one = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    one = one.groupBy("id").agg(F.max("label").alias("label")).withColumn("lot", F.xxhash64("id"))
    if eligible is not None:
        one = one.filter(eligible)
    half = s.max_rows // 2
    picked = one.filter("label = 0").orderBy("lot", "id").limit(half).unionByName(one.filter("label <> 0").orderBy("lot", "id").limit(half))
    picked = F.broadcast(cut(picked))  # max_rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias(text_col)).join(picked, "id")
    bags = texts.select("lot", F.least("label", F.lit(1)).alias("label"), text_col).mapInArrow(_bag(s.bits, text_col), "lot long, label int, places array<int>")
    return bags.repartition(1).mapInArrow(_fit_all(s), "place long, weight double")


def _score(model, bits: int, id_col: str, text_col: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias = model.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = weight
        for ids, texts in ta.chunks(batches, [id_col, text_col]):
            place, doc = features(ta.words([ta.lower(t) for t in texts], ta.NOT_ALNUM), bits)
            hit = dense[place] != 0
            both = np.unique(doc[hit] << bits | place[hit])
            total = np.bincount(both >> bits, dense[both & ((1 << bits) - 1)].astype(np.float64), len(texts)) + bias
            yield pa.RecordBatch.from_pydict({id_col: pa.array(ids, pa.int64()), "score": pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))})

    return of


def score(docs: DataFrame, model: DataFrame, bits: int = Settings.bits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row. The model has 2^bits rows at most, most often a few thousand."""
    small_arrow_batches(docs.sparkSession)
    rows = model.collect()
    bias = next((r["weight"] for r in rows if r["place"] < 0), -35.0)
    found = sorted((r["place"], r["weight"]) for r in rows if r["place"] >= 0)
    sent = docs.sparkSession.sparkContext.broadcast((np.array([p for p, _ in found], np.int64), np.array([w for _, w in found]), bias))
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(_score(sent, bits, id_col, text_col), f"{id_col} long, score double")
