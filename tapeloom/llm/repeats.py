"""Removal of repeated word runs by prefix-partitioned suffix trees.

Suffixes are split by variable-length prefixes into groups that fit into memory: those whose first word is rare enough
share a group by that word; where a first word (or a cell of them) has too many, its suffixes are told apart by two,
four or all words of a window. The lengths follow from counts over the whole corpus. A group's subtree is built from its
suffixes sorted by their words and the common-prefix lengths of neighbours; its inner nodes of `window` words or more
that have different words before them are the maximal repeats. A word is covered where a maximal repeat also starts in
a document with a smaller id: any window that two documents share extends to such a node, to the left and to the right.

Only suffixes that can be leaves below a maximal repeat get into a tree; two sieves find them, chunk of texts by chunk:
* fingerprints of windows (as many bits as the number of all windows needs) tell which windows may repeat. Beyond the
  windows that do, no repeat goes on: a suffix ends where its run of repeated windows ends;
* of those, 64-bit labels and the word before tell which have different words before them. If all occurrences follow
  the same word, the repeat begins further left, and the whole subtree is left out.

A chunk sends each fingerprint and label once, a bundle of chunks each different suffix, sorted and front-coded; a passage that is
common to all texts is an entry a bundle in its tree. Suffixes are compared by 40 bits a word below equal labels.

Defined results: null texts have no words; a null id counts as later than all others; rows with equal ids do not take
words from each other; texts shorter than the window stay whole; one very long text is a chunk of its own and its runs
are cut nowhere; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import discard, release, small_arrow_batches, stored

#: First-word cells of the prefix statistics, finer cells below each, and prefix lengths tried, in words.
CELLS, FINE = 512, 32
LENGTHS = (1, 2, 4)
#: Fingerprints have so many bits beyond the logarithm of the number of windows.
SPARE_BITS = 8
#: Bytes of a word's hash in a suffix.
WORD_BYTES = 5
#: Words of repeated runs that are taken together when leaves are found, and for one tree.
BUNDLE, TREE = 2 << 20, 1 << 19
#: What stands before a window: different words, the beginning of one text, or else 32 bits of the word's hash.
MANY, START = 0, 1
_LAST = np.iinfo(np.int64).max


def _raw(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _statistics(window: int, text_col: str):
    """Counts of windows by (prefix length, first-word cell, finer cell); place -1: bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros((len(LENGTHS), CELLS, FINE), np.int64), 0
        for (texts,) in ta.chunks(batches, [text_col]):
            raw = _raw(texts)
            size += sum(map(len, raw)) + len(raw)
            w = ta.words(raw)
            inside = w.runs(window)[1]
            first = (w.hash[inside] % np.uint64(CELLS)).astype(np.int64)
            for i, n in enumerate(LENGTHS):
                fine = (w.runs(n)[0][inside] >> np.uint64(32)).astype(np.int64) % FINE
                counts[i] += np.bincount(first * FINE + fine, minlength=CELLS * FINE).reshape(CELLS, FINE)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"place": pa.array([-1, *at], pa.int64()), "n": pa.array([size, *counts.reshape(-1)[at]], pa.int64())})

    return of


class Plan:
    """Which prefix tells a window's group: for each first-word cell its length, its first group and how many it has."""

    def __init__(self, counts: np.ndarray, limit: int):
        cell = counts[0].sum(axis=1)
        self.length = np.full(CELLS, len(LENGTHS))
        for i in range(len(LENGTHS) - 1, -1, -1):
            self.length[counts[i].max(axis=1) <= limit] = i
        self.length[cell <= limit] = 0
        self.parts = np.where(cell <= limit, 1, -(-cell // max(limit // 2, 1)))
        small = self.parts == 1
        packed = np.cumsum(np.where(small, cell, 0)) // max(limit, 1)
        self.base = np.where(small, packed, 0)
        next_free = int(packed.max()) + 1
        wide = np.flatnonzero(~small)
        ends = next_free + np.cumsum(self.parts[wide])
        self.base[wide] = ends - self.parts[wide]
        self.groups = int(ends[-1]) if len(wide) else next_free
        self.shift = np.uint64(max(0, 64 - SPARE_BITS - int(cell.sum()).bit_length()))

    def group(self, w: ta.Words, window: int) -> np.ndarray:
        cell = (w.hash % np.uint64(CELLS)).astype(np.int64)
        prefix = np.stack([w.runs(n)[0] for n in (*LENGTHS, window)])[self.length[cell], np.arange(len(cell))]
        return self.base[cell] + ((prefix >> np.uint64(20)) % self.parts[cell].astype(np.uint64)).astype(np.int64)


def _distinct(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (group, value), where each different pair begins in it, and the number of each row's pair."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), entry


def _by_group(group: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    return [(int(group[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _bits(rows: list[dict], group: np.ndarray) -> np.ndarray:
    """Bits of a chunk's entries (sorted by group), put together from the answers of the groups."""
    out = np.zeros(len(group), bool)
    for r in rows:
        a, z = np.searchsorted(group, r["grp"]), np.searchsorted(group, r["grp"], "right")
        out[a:z] = np.unpackbits(ta.unpack(r["data"], np.uint8), count=z - a)
    return out


def _answers(t: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    bits = [ta.pack(np.packbits(b)) for b in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.table({"grp": t.column("grp"), "chunk": t.column("chunk"), "data": pa.array(bits, pa.binary())})


ANSWER = "grp long, chunk long, data binary"


class Chunk:
    """A chunk of texts in order of (id, text), and its windows."""

    def __init__(self, ids, texts, window: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.raw = _raw(texts[i] for i in order)
        self.words = ta.words(self.raw)
        self.label, inside = self.words.runs(window)
        self.places = np.flatnonzero(inside)
        self.number = np.array([_LAST if i is None else i for i in self.ids], np.int64)


# --- which windows may repeat ---------------------------------------------------------------------------------------


def _prints(c: Chunk, window: int, plan: Plan):
    """Groups and fingerprints of the different windows, the number of each place's, and how often each is there."""
    group, mark = plan.group(c.words, window)[c.places], c.label[c.places] >> plan.shift
    order, first, entry = _distinct(group, mark)
    return group[order][first], mark[order][first], entry, np.bincount(entry, minlength=len(first))


def _send(window: int, plan, id_col: str, text_col: str):
    def of(t: pa.Table) -> pa.Table:
        c = Chunk(t.column(id_col).to_pylist(), t.column(text_col).to_pylist(), window)
        group, mark, _, _ = _prints(c, window, plan.value)
        parts = _by_group(group)
        return pa.table({"grp": pa.array([g for g, _, _ in parts], pa.int64()), "chunk": pa.array([t.column("chunk")[0].as_py()] * len(parts), pa.int64()), "data": pa.array([ta.pack_sorted(mark[a:b]) for _, a, b in parts], pa.binary())})

    return of


def _seen(t: pa.Table) -> pa.Table:
    """Of a group's fingerprints: which several chunks have."""
    marks = [ta.unpack_sorted(b, np.uint64) for b in t.column("data").to_pylist()]
    x = np.concatenate(marks)
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    flags = np.zeros(len(x), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return _answers(t, flags, [len(m) for m in marks])


# --- which of them have different words before them -------------------------------------------------------------------


class Runs:
    """Runs of repeated windows of a chunk: hashes of their words, and the text, place and predecessor of each run."""

    KINDS = {"doc": np.uint32, "id": np.int64, "start": np.uint32, "before": np.uint32, "size": np.uint32, "hash": np.uint64}

    def __init__(self, **arrays: np.ndarray):
        self.doc, self.id, self.start, self.before, self.size, self.hash = (arrays[k] for k in self.KINDS)

    @classmethod
    def of(cls, c: Chunk, window: int, often: np.ndarray) -> Runs:
        p = c.places[often]
        doc = np.searchsorted(c.words.first, p, "right") - 1
        new = np.ones(len(p), bool)
        new[1:] = (np.diff(p) != 1) | (doc[1:] != doc[:-1])
        a = np.flatnonzero(new)
        begin, size, doc = p[a], np.diff(np.append(a, len(p))) + window - 1, doc[a]
        start = begin - c.words.first[doc]
        before = np.where(start == 0, START, np.maximum(c.words.hash[np.maximum(begin - 1, 0)] >> np.uint64(32), 2))
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return cls(doc=doc, id=c.number[doc], start=start, before=before, size=size, hash=c.words.hash[at])

    def pack(self) -> list[bytes]:
        return [ta.pack(getattr(self, n).astype(k)) for n, k in self.KINDS.items()]

    @classmethod
    def unpack(cls, r: dict) -> Runs:
        return cls(**{n: ta.unpack(r[n], k) for n, k in cls.KINDS.items()})

    def windows(self, window: int, plan: Plan):
        """Of all windows: run, place of the first word, group, label and what stands before."""
        first = np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)])
        w = ta.Words(self.hash, first)
        label, inside = w.runs(window)
        at = np.flatnonzero(inside)
        run = np.searchsorted(first, at, "right") - 1
        before = np.where(at == first[run], self.before[run], np.maximum(self.hash[np.maximum(at - 1, 0)] >> np.uint64(32), 2)).astype(np.uint32)
        return first, run, at, plan.group(w, window)[at], label[at], before


def _joined(code: np.ndarray, first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """What stands before each of several windows together."""
    if not len(first):
        return np.zeros(0, np.uint32)
    c = code[order]
    lo, hi, n = np.minimum.reduceat(c, first), np.maximum.reduceat(c, first), np.diff(np.append(first, len(c)))
    return np.where((n == 1) | ((lo == hi) & (lo > START)), lo, MANY).astype(np.uint32)


RUNS = "grp long, chunk long, n_words long, labels binary, codes binary, doc binary, id binary, start binary, before binary, size binary, hash binary"
_RUN_NAMES = [x.split()[0] for x in RUNS.split(", ")]


def _contexts(window: int, plan, id_col: str, text_col: str):
    """Rows of labels and of what stands before them, for each group; and one with the runs (no group)."""

    def of(docs: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            chunk = docs.column("chunk")[0].as_py()
            c = Chunk(docs.column(id_col).to_pylist(), docs.column(text_col).to_pylist(), window)
            group, _, entry, n = _prints(c, window, plan.value)
            often = (_bits(found.to_pylist(), group) | (n > 1))[entry]
            if often.any():
                runs = Runs.of(c, window, often)
                _, _, _, group, label, before = runs.windows(window, plan.value)
                order, first, _ = _distinct(group, label)
                code, group, label = _joined(before, first, order), group[order][first], label[order][first]
                out = [(g, chunk, None, ta.pack_sorted(label[a:b]), ta.pack(code[a:b]), *[None] * 6) for g, a, b in _by_group(group)]
                out.append((None, chunk, len(runs.hash), None, None, *runs.pack()))
        kinds = [*[pa.int64()] * 3, *[pa.binary()] * 8]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=_RUN_NAMES)

    return of


def _diverse(t: pa.Table) -> pa.Table:
    """Of a group's labels: which repeat after different words."""
    labels = [ta.unpack_sorted(b, np.uint64) for b in t.column("labels").to_pylist()]
    code = np.concatenate([ta.unpack(b, np.uint32) for b in t.column("codes").to_pylist()])
    x = np.concatenate(labels)
    order, first, entry = _distinct(np.zeros(len(x), np.int64), x)
    return _answers(t, (_joined(code, first, order) == MANY)[entry], [len(a) for a in labels])


# --- trees ------------------------------------------------------------------------------------------------------------


def shared(a: bytes, b: bytes) -> int:
    """Words that two suffixes begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WORD_BYTES
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // WORD_BYTES


SUFFIXES = {"lcp": np.uint32, "size": np.uint32, "code": np.uint32, "owner": np.int64, "times": np.uint32, "chunk": np.int64, "doc": np.uint32, "id": np.int64, "start": np.uint32}
SENT = "grp long, words binary, " + ", ".join(f"{n} binary" for n in SUFFIXES)


def _suffixes(window: int, plan, groups: int):
    """The leaves of a bundle of chunks for each group: different suffixes, sorted and front-coded, with all places of each."""

    def leaves(r: dict, answers: list[dict], base: int) -> dict[str, np.ndarray]:
        runs = Runs.unpack(r)
        first, run, at, group, label, before = runs.windows(window, plan.value)
        order, begin, entry = _distinct(group, label)
        k = np.flatnonzero(_bits(answers, group[order][begin])[entry])
        which = run[k]
        got = {"from": base + at[k], "to": base + first[which + 1], "group": group[k] * groups // plan.value.groups, "code": before[k], "chunk": np.full(len(k), r["chunk"])}
        return got | {"doc": runs.doc[which], "id": runs.id[which], "start": runs.start[which] + (at[k] - first[which])}

    def of(runs: pa.Table, found: pa.Table) -> pa.Table:
        out, answers, base, parts, bufs = [], {}, 0, [], []
        for r in found.to_pylist():
            answers.setdefault(r["chunk"], []).append(r)
        for r in sorted(runs.to_pylist(), key=lambda r: r["chunk"]):
            parts.append(leaves(r, answers.get(r["chunk"], []), base))
            h = ta.unpack(r["hash"], np.uint64)
            bufs.append(np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes())
            base += len(h)
        if parts:
            buf = b"".join(bufs)
            x = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
            by = np.argsort(x["group"], kind="stable")
            x = {n: v[by] for n, v in x.items()}
            squeeze = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, window_log=24))
            for g, a, b in _by_group(x["group"]):
                text = [buf[i:j] for i, j in zip((x["from"][a:b] * WORD_BYTES).tolist(), (x["to"][a:b] * WORD_BYTES).tolist(), strict=True)]
                rank = sorted(range(len(text)), key=text.__getitem__)
                new = [n for n, i in enumerate(rank) if not n or text[i] != text[rank[n - 1]]]
                heads = [text[rank[n]] for n in new]
                lcp = [0, *(shared(i, j) for i, j in zip(heads[:-1], heads[1:], strict=True))]
                cuts, rank = np.array(new), np.array(rank) + a
                got = {n: x[n][rank] for n in ("chunk", "doc", "id", "start")} | {
                    "lcp": np.array(lcp), "size": np.array([len(h) // WORD_BYTES for h in heads]), "code": _joined(x["code"][rank], cuts, np.arange(b - a)), "owner": np.minimum.reduceat(x["id"][rank], cuts), "times": np.diff(np.append(cuts, b - a)),
                }
                rest = squeeze.compress(b"".join(h[n * WORD_BYTES :] for h, n in zip(heads, lcp, strict=True)))
                out.append((g, rest, *(ta.pack(got[n].astype(k)) for n, k in SUFFIXES.items())))
        names = [n.split()[0] for n in SENT.split(", ")]
        return pa.table([pa.array([r[i] for r in out], pa.binary() if i else pa.int64()) for i in range(len(names))], names=names)

    return of


class Tree:
    """The subtree over suffixes: inner nodes with their number of words, least owner and whether words before differ."""

    def __init__(self, suffixes: list[bytes], code: np.ndarray, owner: np.ndarray, times: np.ndarray, window: int):
        rank = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        self.depth, self.owner, self.many, self.parent, self.times = [], [], [], [], []
        self.leaf = np.zeros(len(suffixes), np.int64)  # the node that each suffix ends in
        stack: list[list] = []  # open nodes from the root down: [depth, owner, code, times, children]

        def close() -> int:
            depth, low, before, n, children = stack.pop()
            self.depth.append(depth)
            self.owner.append(low)
            self.many.append(before == MANY and n > 1)
            self.times.append(n)
            self.parent.append(-1)
            me = len(self.depth) - 1
            for kind, child in children:
                if kind:
                    self.leaf[child] = me
                else:
                    self.parent[child] = me
            return me

        def add(top: list, low: int, before: int, n: int, child: tuple[int, int]) -> None:
            top[1] = min(top[1], low)
            top[2] = before if not top[3] else top[2] if top[2] == before and before > START else MANY
            top[3] += n
            top[4].append(child)

        last = b""
        for i in rank:
            s = suffixes[i]
            keep = shared(last, s) if stack else 0
            while stack and stack[-1][0] > keep:
                _, low, before, n, _ = stack[-1]
                above = stack[-2][0] if len(stack) > 1 else 0
                node = close()
                if keep > above:
                    stack.append([keep, _LAST, MANY, 0, []])
                if stack:
                    add(stack[-1], low, before, n, (0, node))
            if not stack or stack[-1][0] < len(s) // WORD_BYTES:
                stack.append([len(s) // WORD_BYTES, _LAST, MANY, 0, []])
            add(stack[-1], int(owner[i]), int(code[i]), int(times[i]), (1, i))
            last = s
        while stack:
            _, low, before, n, _ = stack[-1]
            node = close()
            if stack:
                add(stack[-1], low, before, n, (0, node))
        self.window = window

    def steps(self, suffix: int) -> list[tuple[int, int]]:
        """(words, least owner) of the maximal repeats that a suffix begins with, the longest of each owner, longest first."""
        out, node = [], int(self.leaf[suffix])
        while node >= 0:
            if self.many[node] and self.depth[node] >= self.window and (not out or self.owner[node] < out[-1][1]):
                out.append((self.depth[node], self.owner[node]))
            node = self.parent[node]
        return out


FOUND = {"doc": np.uint32, "start": np.uint32, "length": np.uint32, "owner": np.int64}
REPEATS = "chunk long, " + ", ".join(f"{n} binary" for n in FOUND)


def _trees(window: int):
    """Of a group's suffixes: the maximal repeats of an earlier owner at each of their places."""

    def of(t: pa.Table) -> pa.Table:
        text, parts, out = [], [], []
        for r in t.to_pylist():
            got = {n: ta.unpack(r[n], k) for n, k in SUFFIXES.items()}
            words, last, place = zstandard.ZstdDecompressor().decompress(r["words"]), b"", 0
            for lcp, size in zip((got["lcp"] * WORD_BYTES).tolist(), (got["size"] * WORD_BYTES).tolist(), strict=True):
                last = last[:lcp] + words[place : place + size - lcp]
                place += size - lcp
                text.append(last)
            del words
            parts.append({n: got[n] for n in ("code", "owner", "times", "chunk", "doc", "id", "start", "lcp")})
        tree = Tree(text, *(np.concatenate([p[n] for p in parts]) for n in ("code", "owner", "times")), window)
        base, every = 0, []
        for p in parts:
            steps = [tree.steps(base + i) for i in range(len(p["lcp"]))]
            base += len(steps)
            n = np.array([len(s) for s in steps])
            flat = np.array([x for s in steps for x in s], np.int64).reshape(-1, 2)
            entry = np.repeat(np.arange(len(steps)), p["times"])
            many = n[entry]
            place = np.repeat(np.arange(len(entry)), many)
            step = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + (np.cumsum(n) - n)[entry[place]]
            earlier = flat[step, 1] < p["id"][place]
            place, step = place[earlier], step[earlier]
            every.append({"chunk": p["chunk"][place], "doc": p["doc"][place], "start": p["start"][place], "length": flat[step, 0], "owner": flat[step, 1]})
        got = {n: np.concatenate([e[n] for e in every]) for n in every[0]}
        by = np.argsort(got["chunk"], kind="stable")
        got = {n: v[by] for n, v in got.items()}
        for chunk, a, b in _by_group(got["chunk"]):
            out.append((chunk, *(ta.pack(got[m][a:b].astype(k)) for m, k in FOUND.items())))
        return pa.table([pa.array([x[i] for x in out], pa.binary() if i else pa.int64()) for i in range(1 + len(FOUND))], names=[x.split()[0] for x in REPEATS.split(", ")])

    return of


def _spans(found: pa.Table) -> dict[str, np.ndarray]:
    rows = found.to_pylist()
    return {n: np.concatenate([ta.unpack(r[n], k) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64) for n, k in FOUND.items()}


def _take(window: int, id_col: str, text_col: str):
    def of(docs: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts, total, removed = [], [], [], []
        if docs.num_rows:
            c, s = Chunk(docs.column(id_col).to_pylist(), docs.column(text_col).to_pylist(), window), _spans(found)
            first, edge = c.words.first, np.zeros(len(c.words.hash) + 1, np.int64)
            begin = first[s["doc"]] + s["start"]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + s["length"], -1)
            kept, ids, total = np.cumsum(edge)[:-1] <= 0, c.ids, c.words.counts()
            for i, raw in enumerate(c.raw):
                mask = kept[first[i] : first[i + 1]]
                removed.append(int(len(mask) - mask.sum()))
                texts.append(b" ".join(compress(raw.split(), mask.tolist()) if removed[-1] else raw.split()))
        return pa.table({id_col: pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    return of


def _list(window: int, id_col: str, text_col: str):
    def of(docs: pa.Table, found: pa.Table) -> pa.Table:
        s = _spans(found)
        c = Chunk(docs.column(id_col).to_pylist(), docs.column(text_col).to_pylist(), window) if docs.num_rows else None
        ids = [c.ids[i] for i in s["doc"].tolist()] if c else []
        return pa.table({id_col: pa.array(ids, pa.int64()), **{n: pa.array(s[n] if c else [], pa.int64()) for n in ("start", "length", "owner")}})

    return of


class Found:
    """Documents by chunk, and the maximal repeats in each."""

    def __init__(self, df: DataFrame, window: int, id_col: str, text_col: str, chunk_bytes: int, group_windows: int):
        spark = df.sparkSession
        small_arrow_batches(spark)
        docs = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
        stats = docs.select(text_col).mapInArrow(_statistics(window, text_col), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # a fixed number of cells
        counts, size = np.zeros(len(LENGTHS) * CELLS * FINE, np.int64), 0
        for r in stats:
            if r["place"] < 0:
                size = r["n"]
            else:
                counts[r["place"]] = r["n"]
        counts = counts.reshape(len(LENGTHS), CELLS, FINE)
        cores = spark.sparkContext.defaultParallelism
        plan = spark.sparkContext.broadcast(Plan(counts, int(min(group_windows, max(counts[0].sum() // (3 * cores), 1000)))))
        chunks = max(cores, int(size // chunk_bytes) + 1)
        self.docs = docs.withColumn("chunk", F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)))
        self.repeats = self._repeats(plan, window, id_col, text_col)

    def _repeats(self, plan, window: int, id_col: str, text_col: str) -> DataFrame:
        spark = self.docs.sparkSession
        sent = self.docs.groupBy("chunk").applyInArrow(_send(window, plan, id_col, text_col), ANSWER)
        seen = sent.groupBy("grp").applyInArrow(_seen, ANSWER)
        runs, folder = stored(self.docs.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(_contexts(window, plan, id_col, text_col), RUNS), "runs")
        del sent, seen
        release(spark)  # the shuffled texts and fingerprints
        # Leaves are fewer than windows: neighbouring groups share a tree, and chunks are taken together in bundles.
        words, cores = runs.agg(F.sum("n_words").alias("n")).first()["n"] or 0, spark.sparkContext.defaultParallelism
        bundles, groups = max(cores, words // BUNDLE + 1), min(plan.value.groups, max(2 * cores, words // TREE + 1))
        bundle = F.pmod("chunk", F.lit(bundles)).alias("bundle")
        diverse = runs.filter("grp is not null").select("grp", "chunk", "labels", "codes").groupBy("grp").applyInArrow(_diverse, ANSWER)
        own = runs.filter("grp is null").select(bundle, "chunk", *Runs.KINDS)
        leaves = own.groupBy("bundle").cogroup(diverse.select(bundle, "grp", "chunk", "data").groupBy("bundle")).applyInArrow(_suffixes(window, plan, groups), SENT)
        found, self.folder = stored(leaves.groupBy("grp").applyInArrow(_trees(window), REPEATS), "repeats")
        del diverse, own, leaves, runs
        discard(spark, folder)
        release(spark)
        return found

    def with_docs(self, function, schema: str) -> DataFrame:
        return self.docs.groupBy("chunk").cogroup(self.repeats.groupBy("chunk")).applyInArrow(function, schema)


def drop_repeats(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, group_windows: int = 1 << 20) -> DataFrame:
    """(id, text, n_words, n_removed): the kept words joined by one space, after removing every word in a window of
    that many words which a document with a smaller id has, too. chunk_bytes and group_windows bound a task's memory."""
    return Found(df, window, id_col, text_col, chunk_bytes, group_windows).with_docs(_take(window, id_col, text_col), f"{id_col} long, text string, n_words long, n_removed long")


def maximal_repeats(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, group_windows: int = 1 << 20) -> DataFrame:
    """(id, start, length, owner): where in a document maximal repeats of `window` words or more begin that a document
    with a smaller id has, too; owner is the least id. Of the repeats that begin at a place, the longest of each owner."""
    return Found(df, window, id_col, text_col, chunk_bytes, group_windows).with_docs(_list(window, id_col, text_col), f"{id_col} long, start long, length long, owner long")
