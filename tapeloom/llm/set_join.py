"""Exact self-join of word n-gram sets by Jaccard similarity, with skips from relations between sets.

Texts with the same words are one class; the join runs on classes. All shingles have one global order: rare ones
first, by a frequency sketch of fixed size that is summed over the whole corpus, then by hash. Two sets with enough
in common must share one of the first `size - need + 1` shingles, so only those go to inverted lists.

Skips of two kinds keep the lists from being paired out:
* by position: a list is sorted by size and position and cut into blocks, whose headers hold the sizes, the most that
  is left of a set after its place, and the component where there is but one. A probe reads the headers and skips
  blocks that cannot reach the overlap it needs;
* by answers: in each list the most typical set (most of it frequent) is joined first. What is found similar to it
  has its place in its component, derived from its answer; afterwards only sets that are still in different
  components are compared. In a group of near copies that leaves the few sets at the edge.

Candidates are verified exactly on whole sets (64-bit hashes of shingles; two different shingles share one with a
chance below 1e-3 in 10^8). Nothing is capped: every pair that could link two components is verified. The number of
links of each row, where asked for, comes from comparing all sets inside a component.

Defined results: a null or empty text has no shingles and links with nothing; rows
without id stand for no component and no link; repeated rows are copies of each other;
a text with fewer words than k is one shingle; texts of any length are taken whole; of sets equally typical that with
the smaller key is the pivot; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text_arrays as ta
from .common import cut, small_arrow_batches
from .graph import components

CELLS = 1 << 20
#: Up to this size, ids are broadcast to the texts.
BROADCAST_BYTES = 64 << 20
_SLICES = 64
#: Classes of a large component that a task compares with as many others, and shingles it takes at a time.
BLOCK, COLUMNS = 512, 8192
#: Sets of a list that a probe reads or skips together.
ENTRIES = 64


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the texts, in order of the texts, and where each text begins (one more for the end)."""
    w = ta.words(texts)
    h, inside = w.runs(k)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    for d in short:  # the whole sequence is the one shingle
        a, x = w.first[d], 0
        for y in w.hash[a : w.first[d + 1]].tolist():
            x = (x * int(ta._STEP) + y) & 0xFFFFFFFFFFFFFFFF
        h[a], inside[a] = ta._mix(np.array([x ^ int(counts[d])], np.uint64))[0], True
    upto = np.concatenate([[0], np.cumsum(inside)])
    return h[inside], upto[w.first]


def key_of(text: bytes) -> int:
    """Class of a text: equal for equal word sequences."""
    return int.from_bytes(hashlib.blake2b(b" ".join(text.split()), digest_size=8).digest(), "little", signed=True)


def parts_of(s: np.ndarray) -> bytes:
    """How many of a set's shingles lie in each of 64 parts of the hash space, up to 255: sets overlap by no more than
    the sum of the smaller counts."""
    return np.minimum(np.bincount((s & np.uint64(63)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def need(a, b, sim: Fraction):
    """Least overlap of sets of sizes a and b with at least that similarity."""
    p, q = sim.numerator, sim.denominator
    return -(-(a + b) * p // (p + q))


def _profile(k: int, id_col: str, text_col: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for ids, texts in ta.chunks(batches, [id_col, text_col]):
            raw = [ta.lower(t) for t in texts]
            h, first = shingles(raw, k)
            sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            for a in range(0, len(sets), 4096):
                np.add.at(cells, (np.concatenate(sets[a : a + 4096]) >> np.uint64(44)).astype(np.int64), 1)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "key": pa.array([key_of(t) for t in raw], pa.int64()), "parts": pa.array([parts_of(s) for s in sets], pa.binary()), "cell": pa.nulls(len(ids), pa.int32()), "counts": pa.nulls(len(ids), pa.binary())})
        step = CELLS // _SLICES
        if cells.any():
            yield pa.RecordBatch.from_pydict({"id": pa.nulls(_SLICES, pa.int64()), "n_shingles": pa.nulls(_SLICES, pa.int64()), "key": pa.nulls(_SLICES, pa.int64()), "parts": pa.nulls(_SLICES, pa.binary()), "cell": pa.array(range(_SLICES), pa.int32()), "counts": pa.array([ta.pack(cells[i * step : (i + 1) * step].astype(np.uint32)) for i in range(_SLICES)], pa.binary())})

    return of


def _sum_cells(t: pa.Table) -> pa.Table:
    total = sum(ta.unpack(b, np.uint32).astype(np.int64) for b in t.column("counts").to_pylist())
    return pa.table({"cell": pa.array([t.column("cell")[0].as_py()], pa.int32()), "counts": pa.array([ta.pack(total)], pa.binary())})


def frequency_levels(cell_rows: DataFrame) -> np.ndarray:
    """For each cell of the sketch, how far its count lies over the mean, in steps of a factor of sqrt(2), 0 to 255."""
    summed = cell_rows.groupBy("cell").applyInArrow(_sum_cells, "cell int, counts binary").collect()
    cells, step = np.zeros(CELLS, np.int64), CELLS // _SLICES
    for r in summed:  # a fixed number of rows
        cells[r["cell"] * step : (r["cell"] + 1) * step] = ta.unpack(bytes(r["counts"]), np.int64)
    over = np.maximum(cells / max(cells.mean(), 1.0), 1.0)
    return np.minimum(np.round(2 * np.log2(over)), 255).astype(np.uint8)


def ordered(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Distinct shingles in the global order, as numbers that sort alike: frequency level above, hash below."""
    level = levels[(h >> np.uint64(44)).astype(np.int64)].astype(np.uint64)
    return np.unique((level << np.uint64(56)) | (h >> np.uint64(8)))


def _prefixes(k: int, sim: Fraction, levels, groups: int, text_col: str):
    """Blobs (grp, sets, entries): the prefix shingles of a chunk of texts, dealt by shingle over the groups."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in ta.chunks(batches, [text_col]):
            raw = list({key_of(x): x for x in (ta.lower(t) for t in texts)}.items())
            h, first = shingles([x for _, x in raw], k)
            keys, sizes, types, tok, who, pos = [], [], [], [], [], []
            for (key, _), a, b in zip(raw, first[:-1], first[1:], strict=True):
                if a == b:
                    continue
                s = ordered(h[a:b], levels.value)
                n = len(s)
                head = s[: n - -(-n * sim.numerator // sim.denominator) + 1]
                tok.append(head)
                who.append(np.full(len(head), len(keys), np.uint32))
                pos.append(np.arange(len(head), dtype=np.uint32))
                keys.append(key)
                sizes.append(n)
                types.append(int((s >> np.uint64(56)).mean() * 16))
            if not keys:
                continue
            tok, who, pos = np.concatenate(tok), np.concatenate(who), np.concatenate(pos)
            grp = (ta._mix(tok) % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((tok, grp))
            tok, who, pos, grp = tok[order], who[order], pos[order], grp[order]
            cuts = np.flatnonzero(np.diff(grp, prepend=-1))
            keys, sizes, types = np.array(keys, np.int64), np.array(sizes, np.uint32), np.array(types, np.uint16)
            out = {"grp": [], "keys": [], "sizes": [], "types": [], "tok": [], "who": [], "pos": []}
            for a, b in zip(cuts, [*cuts[1:], len(grp)], strict=True):
                used, at = np.unique(who[a:b], return_inverse=True)
                for name, v in (("grp", int(grp[a])), ("keys", ta.pack(keys[used])), ("sizes", ta.pack(sizes[used])), ("types", ta.pack(types[used])), ("tok", ta.pack_sorted(tok[a:b])), ("who", ta.pack(at.astype(np.uint32))), ("pos", ta.pack(pos[a:b]))):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64() if n == "grp" else pa.binary()) for n, v in out.items()})

    return of


BLOB = "grp long, keys binary, sizes binary, types binary, tok binary, who binary, pos binary"
LISTS = "list long, pivot long, keys array<long>, sizes array<long>, reach array<long>, near array<boolean>"


def _lists(sim: Fraction):
    """Of a group's inverted lists with two sets or more: the sets that positions leave, and the list's pivot."""

    def of(t: pa.Table) -> pa.Table:
        tok, key, size, typ, pos = [], [], [], [], []
        for r in t.to_pylist():
            who = ta.unpack(r["who"], np.uint32)
            tok.append(ta.unpack_sorted(r["tok"], np.uint64))
            key.append(ta.unpack(r["keys"], np.int64)[who])
            size.append(ta.unpack(r["sizes"], np.uint32)[who].astype(np.int64))
            typ.append(ta.unpack(r["types"], np.uint16)[who])
            pos.append(ta.unpack(r["pos"], np.uint32).astype(np.int64))
        tok, key, size, typ, pos = (np.concatenate(x) for x in (tok, key, size, typ, pos))
        order = np.lexsort((key, pos, size, tok))
        tok, key, size, typ, pos = tok[order], key[order], size[order], typ[order], pos[order]
        fresh = np.ones(len(tok), bool)
        fresh[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])  # the same class from several chunks
        tok, key, size, typ, pos = tok[fresh], key[fresh], size[fresh], typ[fresh], pos[fresh]
        cuts = np.flatnonzero(np.diff(tok, prepend=~tok[:1]))
        ends = np.append(cuts[1:], len(tok))
        found: dict[int, tuple] = {}
        p, q = sim.numerator, sim.denominator
        for a, b in zip(cuts[ends - cuts > 1], ends[ends - cuts > 1], strict=True):
            # Blocks of sizes that may be similar: a run ends where the next set is too large for the one before it.
            gaps = np.flatnonzero(size[a + 1 : b] * p > size[a : b - 1] * q) + 1
            for c, d in zip(np.append(0, gaps) + a, np.append(gaps, b - a) + a, strict=True):
                if d - c < 2:
                    continue
                # A set is skipped if its place leaves too little for even the smallest set here that it may match.
                smallest = np.maximum(size[c], -(-size[c:d] * p // q))
                able = np.flatnonzero(size[c:d] - pos[c:d] >= need(smallest, size[c:d], sim)) + c
                if len(able) < 2:
                    continue
                pivot = able[np.lexsort((key[able], -typ[able].astype(np.int64)))[0]]
                left = np.minimum(size[able] - pos[able], size[pivot] - pos[pivot])
                near = (left >= need(size[able], size[pivot], sim)) & (able != pivot)
                order = np.argsort(key[able])
                ks, reach, near = key[able][order], (size[able] - pos[able])[order], near[order]
                name = int.from_bytes(hashlib.blake2b(ks.tobytes(), digest_size=8).digest(), "little", signed=True)
                if name in found:  # the same sets share another shingle: what either place allows holds
                    reach, near = np.maximum(reach, found[name][3]), near | found[name][4]
                found[name] = int(key[pivot]), ks, size[able][order], reach, near
        kinds = {"list": pa.int64(), "pivot": pa.int64(), "keys": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "reach": pa.list_(pa.int64()), "near": pa.list_(pa.bool_())}
        columns = [list(found), *zip(*found.values(), strict=True)] if found else [[]] * 6
        return pa.table({n: pa.array([x if np.isscalar(x) else list(x) for x in c], k) for (n, k), c in zip(kinds.items(), columns, strict=True)})

    return of


class Blocks:
    """A list by size and position, in blocks that a probe skips by their headers."""

    def __init__(self, size: np.ndarray, reach: np.ndarray, comp: np.ndarray, sim: Fraction):
        self.sim, self.order = sim, np.lexsort((-reach, size))
        size, reach, comp = size[self.order], reach[self.order], comp[self.order]
        cuts = np.arange(0, len(size), ENTRIES)
        self.smallest, self.largest = np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts)
        self.reach, self.comp = np.maximum.reduceat(reach, cuts), comp[cuts]
        self.alone = np.minimum.reduceat(comp, cuts) == np.maximum.reduceat(comp, cuts)

    def read(self, size: int, reach: int, comp: int) -> np.ndarray:
        """Entries of the blocks that may hold a set of another component similar to a set of that size and reach."""
        p, q = self.sim.numerator, self.sim.denominator
        least = np.maximum(self.smallest, -(-size * p // q))  # of the sets in a block that are large enough
        able = (self.largest >= least) & (self.smallest * p <= size * q) & (np.minimum(self.reach, reach) >= need(least, size, self.sim))
        kept = np.flatnonzero(able & ~(self.alone & (self.comp == comp)))
        entries = (kept[:, None] * ENTRIES + np.arange(ENTRIES)).ravel()
        return self.order[entries[entries < len(self.order)]]


def _across(sim: Fraction):
    """Pairs of a list's sets that are in different components and whose sizes and places allow the similarity."""
    p, q = sim.numerator, sim.denominator

    def of(t: pa.Table) -> pa.Table:
        key, size, reach, comp, shared = (t.column(c).to_numpy() for c in ("key", "size", "reach", "component", "shared"))
        kinds, at, n = np.unique(comp, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(at != np.argmax(n))
        blocks = Blocks(size, reach, comp, sim)
        a_out, b_out = [], []
        place = np.zeros(len(key), np.int64)
        place[rest] = np.arange(len(rest)) + 1
        for r in rest.tolist():
            e = blocks.read(int(size[r]), int(reach[r]), int(comp[r]))
            ok = (comp[e] != comp[r]) & ((place[e] == 0) | (place[e] > place[r])) & (size[e] * q >= size[r] * p) & (size[e] * p <= size[r] * q)
            most = np.minimum(reach[e], reach[r])
            # Answers derived from the pivot's: two sets share at most what both share with it and what both have beyond it.
            by_pivot = np.minimum(shared[e], shared[r]) + np.minimum(size[e] - shared[e], size[r] - shared[r])
            most = np.where((shared[e] >= 0) & (shared[r] >= 0), np.minimum(most, by_pivot), most)
            ok &= most >= need(size[e], size[r], sim)
            b = key[e[ok]]
            b_out.append(b)
            a_out.append(np.full(len(b), key[r]))
        a = np.concatenate(a_out) if a_out else np.zeros(0, np.int64)
        b = np.concatenate(b_out) if b_out else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return of


def fine_parts(s: np.ndarray) -> bytes:
    """As parts_of, with about as many parts as shingles (a power of two, at least 64): a byte for each, not eight."""
    n = 1 << max(6, int(len(s) - 1).bit_length())
    return np.minimum(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def most_shared(p: bytes, q: bytes) -> int:
    """What two sets can share at most, by their fine parts; the finer counts are added up to the coarser ones."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (p, q))
    if (x == 255).any() or (y == 255).any():
        return 1 << 60
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(axis=0), y.reshape(-1, n).sum(axis=0)).sum())


def _sets(k: int, text_col: str, whole: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in ta.chunks(batches, [text_col]):
            raw = [ta.lower(t) for t in texts]
            h, first = shingles(raw, k)
            sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            keys = pa.array([key_of(t) for t in raw], pa.int64())
            if whole:
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offs, pa.array(np.concatenate(sets).view(np.int64)))], names=["key", "grams"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array([fine_parts(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["key", "parts", "n"])

    return of


def texts_of(docs: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The text of the first document of every class in the pairs.

    The ids go to the texts where they are few enough to broadcast (their count is known); else both are shuffled.
    """
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = cut(keys.join(classes, "key").select(F.col("id").alias("__id")))
    if wanted.count() * 16 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs[id_col] == wanted["__id"], "left_semi").select(text_col)


def _may_share(sim: Fraction):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            p, q, m, n = (t.column(c).to_pylist() for c in ("p", "q", "m", "n"))
            able = [most_shared(*x[:2]) >= need(x[2], x[3], sim) for x in zip(p, q, m, n, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(able, pa.bool_()))

    return of


def compared(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, sim: Fraction, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) with the overlap of their whole sets and whether that links them; without those that the fine
    part counts rule out, which spares most of the sets that do not link."""
    small = cut(texts_of(docs, pairs, classes, id_col, text_col).mapInArrow(_sets(k, text_col, False), "key long, parts binary, n long"))
    x, y = (small.select(F.col("key").alias(c), F.col("n").alias(d), F.col("parts").alias(e)) for c, d, e in (("a", "m", "p"), ("b", "n", "q")))
    left = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "m", "n", "p", "q").mapInArrow(_may_share(sim), "a long, b long").distinct())
    sets = cut(texts_of(docs, left, classes, id_col, text_col).mapInArrow(_sets(k, text_col, True), "key long, grams array<long>"))
    return verify(left, sets, sim)


def _may_reach(sim: Fraction):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, 64) for c in ("p", "q"))
                both = np.minimum(x, y)
                m, n = (t.column(c).to_numpy() for c in ("m", "n"))
                able = (both.sum(axis=1, dtype=np.int64) >= need(m, n, sim)) | (both == 255).any(axis=1)
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(able))

    return of


def plausible(pairs: DataFrame, classes: DataFrame, sim: Fraction) -> DataFrame:
    """The pairs (a, b) whose part counts allow enough overlap: all that have it, and few others."""
    x = classes.select(F.col("key").alias("a"), F.col("n_shingles").alias("m"), F.col("parts").alias("p"))
    y = classes.select(F.col("key").alias("b"), F.col("n_shingles").alias("n"), F.col("parts").alias("q"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "m", "n", "p", "q").mapInArrow(_may_reach(sim), "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, sim: Fraction) -> DataFrame:
    """The pairs (a, b) with the overlap of their whole sets, and whether that links them."""
    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a")
    two = one.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
    seen = two.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("overlap"))
    linked = sim.denominator * F.col("overlap") >= sim.numerator * (F.col("m") + F.col("n") - F.col("overlap"))
    return seen.select("a", "b", F.col("overlap").cast("long"), linked.alias("linked")).distinct()


def _members(k: int):
    """The sets of classes, from the texts of their first documents; a text of another class with that id is left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for comp, blocks, n, key, texts in ta.chunks(batches, ["component", "blocks", "docs", "key", "text"]):
            raw = [ta.lower(t) for t in texts]
            own = [i for i, t in enumerate(raw) if key_of(t) == key[i]]
            h, first = shingles([raw[i] for i in own], k)
            grams = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            longs = [pa.array([c[i] for i in own], pa.int64()) for c in (comp, blocks, n, key)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(grams, pa.binary())], names=["component", "blocks", "docs", "key", "grams"])

    return of


def linked_docs(rows: list[np.ndarray], columns: list[np.ndarray], docs: np.ndarray, sim: Fraction) -> np.ndarray:
    """Which sets of rows are linked with which of columns, as sums of docs (of the columns) for each row."""
    m, sizes = len(rows), np.array([len(s) for s in (*rows, *columns)], np.int64)
    _, at, n = np.unique(np.concatenate([*rows, *columns]), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sizes)), sizes)
    often = n[at] > 1  # what only one set has adds to no overlap
    number = np.cumsum(n > 1) - 1
    who, at = who[often], number[at[often]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    overlap = np.zeros((m, len(columns)), np.int64)
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        b, c = np.searchsorted(at, [a, a + COLUMNS])
        x = np.zeros((len(sizes), min(COLUMNS, int(at[-1]) + 1 - a)), np.float32)
        x[who[b:c], at[b:c] - a] = 1
        overlap += (x[:m] @ x[m:].T).astype(np.int64)
    both = sizes[:m, None] + sizes[None, m:] - overlap
    return (sim.denominator * overlap >= sim.numerator * both).astype(np.int64) @ docs


def _count(sim: Fraction):
    """For the sets of whole components, or of two blocks of one, the documents of other sets that each is linked with."""

    def of(t: pa.Table) -> pa.Table:
        comp, lo, hi, block, key, docs = (t.column(c).to_numpy() for c in ("component", "lo", "hi", "block", "key", "docs"))
        grams = t.column("grams").to_pylist()
        order = np.lexsort((key, block, hi, lo, comp))
        fresh = np.ones(len(order), bool)  # repeated rows of the first document
        fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (comp, lo, hi, key)], axis=0)
        order = order[fresh]
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (comp, lo, hi)], axis=0)
        keys, sums = [], []
        for g in np.split(order, np.flatnonzero(new)[1:]):
            sets = [np.frombuffer(grams[i], np.uint64) for i in g]
            m = int((block[g] == lo[g]).sum())
            if lo[g[0]] == hi[g[0]]:
                found = linked_docs(sets, sets, docs[g], sim) - docs[g]
            elif 0 < m < len(g):
                found = np.append(linked_docs(sets[:m], sets[m:], docs[g[m:]], sim), linked_docs(sets[m:], sets[:m], docs[g[:m]], sim))
            else:
                continue
            keys.append(key[g])
            sums.append(found)
        keys, sums = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, sums))
        return pa.table({"key": pa.array(keys, pa.int64()), "n": pa.array(sums, pa.int64())})

    return of


def link_counts(docs: DataFrame, placed: DataFrame, k: int, sim: Fraction, id_col: str, text_col: str) -> DataFrame:
    """(key, n): documents in other classes that a class is linked with. placed: (key, id, docs, n_shingles, component).

    All links lie inside components, so each component's sets are compared with each other, whole and exactly: small
    components together, large ones as pairs of blocks, each in its own task. No pair becomes a row.
    """
    sizes = placed.groupBy("component").agg(F.count("*").alias("classes")).filter("classes > 1")
    inside = cut(placed.join(sizes, "component").select("component", "key", F.col("id").alias("__id"), "docs", "n_shingles", F.ceil(F.col("classes") / BLOCK).cast("long").alias("blocks")))
    seen = inside.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).first()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, (seen["shingles"] or 0) // 1_000_000 + 1)
    wanted = inside.drop("n_shingles")
    if seen["n"] * 40 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(wanted, "__id").select("component", "blocks", "docs", "key", "text")
    sets = texts.mapInArrow(_members(k), "component long, blocks long, docs long, key long, grams binary")
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", "lo", "hi"))
    return dealt.withColumn("task", task).drop("blocks", "other").groupBy("task").applyInArrow(_count(sim), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def link(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row: size of its set, and the least id that links can reach from it.

    With links also n_links: the other rows with an id that the row is linked with.
    """
    spark = df.sparkSession
    small_arrow_batches(spark)
    sim = Fraction(percent, 100)
    docs = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    rows = cut(docs.mapInArrow(_profile(k, id_col, text_col), "id long, n_shingles long, key long, parts binary, cell int, counts binary"))
    levels = spark.sparkContext.broadcast(frequency_levels(rows.filter("cell is not null").select("cell", "counts")))
    narrow = rows.filter("cell is null").select("id", "n_shingles", "key", "parts")
    total = narrow.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    groups = max(spark.sparkContext.defaultParallelism, int(total * (100 - percent) / 100) // 400_000 + 1)

    blobs = docs.select(text_col).mapInArrow(_prefixes(k, sim, levels, groups, text_col), BLOB)
    found = blobs.groupBy("grp").applyInArrow(_lists(sim), LISTS)
    lists = cut(found)  # the same list may come from several groups
    tied = lists.select("pivot", F.explode(F.arrays_zip("keys", "near")).alias("m")).filter("m.near").select("pivot", F.col("m.keys").alias("key"))
    stars = tied.select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b")).distinct()
    classes = cut(narrow.filter("n_shingles > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("parts").alias("parts")))
    stars = cut(plausible(stars, classes, sim))
    judged = cut(compared(docs, stars, classes, k, sim, id_col, text_col))
    first = judged.filter("linked").select("a", "b")
    near = components(first).withColumnRenamed("node", "key")
    each = lists.select("list", "pivot", F.explode(F.arrays_zip("keys", "sizes", "reach")).alias("m")).select("list", "pivot", F.col("m.keys").alias("key"), F.col("m.sizes").alias("size"), F.col("m.reach").alias("reach"))
    members = each.groupBy("list", "key").agg(F.max("size").alias("size"), F.max("reach").alias("reach"), F.min("pivot").alias("pivot"))
    with_pivot = judged.select(F.col("a").alias("pivot"), F.col("b").alias("key"), "overlap").unionByName(judged.select(F.col("b").alias("pivot"), F.col("a").alias("key"), "overlap"))
    placed = members.join(near, "key", "left").withColumn("component", F.coalesce("component", "key"))
    split = placed.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("list")
    seen = placed.join(split, "list").join(with_pivot, ["pivot", "key"], "left")
    shared = F.when(F.col("key") == F.col("pivot"), F.col("size")).otherwise(F.coalesce("overlap", F.lit(-1)))
    more = seen.select("list", "key", "size", "reach", "component", shared.alias("shared")).groupBy("list").applyInArrow(_across(sim), "a long, b long").distinct()
    more = cut(plausible(more.join(stars, ["a", "b"], "left_anti"), classes, sim))
    second = compared(docs, more, classes, k, sim, id_col, text_col).filter("linked").select("a", "b")

    # From classes to documents: a class's least id stands for it.
    joined = cut(first.unionByName(second))
    small = classes.select(F.col("key"), F.col("id").alias("least_id"))
    edges = joined.join(small.select(F.col("key").alias("a"), F.col("least_id").alias("x")), "a").join(small.select(F.col("key").alias("b"), F.col("least_id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    comp = components(edges)
    of_class = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    told = [F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")]
    if not links:
        return narrow.drop("parts").join(of_class, "key", "left").select(*told)
    copies = narrow.filter("n_shingles > 0 and id is not null").groupBy("key").agg(F.count("*").alias("docs"))
    of_class = cut(of_class.join(copies, "key", "left"))
    placed = classes.drop("parts").join(of_class.filter("component_id is not null").withColumnRenamed("component_id", "component"), "key")
    of_class = of_class.join(link_counts(docs, placed, k, sim, id_col, text_col), "key", "left")
    n_links = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("docs") - 1 + F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    return narrow.drop("parts").join(of_class, "key", "left").select(*told, n_links.cast("long").alias("n_links"))


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df of which one document stays for each component: that with the least id, once.

    Rows without text or id stay.
    """
    linked = link(df, k, percent, id_col, text_col)
    keep = linked.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = df.filter(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi").select(*df.columns)
    again = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(text_col)  # the join's partitioning serves it
    once = kept.withColumn("__again", F.row_number().over(again)).filter("__again = 1").select(*df.columns)
    return once.unionByName(df.filter(F.col(id_col).isNull()))
