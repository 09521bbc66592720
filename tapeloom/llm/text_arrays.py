"""Words of many texts as NumPy arrays: 64-bit word hashes, and hashes of runs of words.

Works on the UTF-8 bytes of a batch at once, in slices of bounded size, so that one very long text costs no more
memory a byte than many short ones. Hashes come from a fixed rule, and so are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import zstandard

_SLICE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)


def delimiters(chars: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes that separate words.
SPACE = delimiters([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = delimiters([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Words:
    """hash: of each word of the batch in order; first[i]: where text i begins in it, with one more entry for the end."""

    def __init__(self, hash_: np.ndarray, first: np.ndarray):
        self.hash, self.first = hash_, first

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each place, and whether all of them lie in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        h = np.zeros(n, np.uint64)
        m = n - k + 1
        for j in range(k):
            h[:m] = h[:m] * _STEP + self.hash[j : j + m]
        doc = self.doc()
        inside = np.zeros(n, bool)
        inside[:m] = doc[:m] == doc[k - 1 :]
        return _mix(h), inside


def _hash_slice(buf: np.ndarray, delim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a slice that cuts none."""
    word = ~delim[buf]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lens.max()), _BASE, np.uint64)]))
    h = np.add.reduceat(_BYTE[buf[word]] * power[place], at)
    return starts, _mix(h + lens.astype(np.uint64))


def words(texts: list[bytes], delim: np.ndarray = SPACE) -> Words:
    joined = b"\n".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    starts, hashes, a = [], [], 0
    while a < len(buf):
        b = min(a + _SLICE, len(buf))
        while b < len(buf) and not delim[buf[b]]:  # to the end of the word that the slice would cut
            more = np.flatnonzero(delim[buf[b : b + _SLICE]])
            b = b + int(more[0]) if len(more) else min(b + _SLICE, len(buf))
            if len(more):
                break
        s, h = _hash_slice(buf[a:b], delim)
        starts.append(s + a)
        hashes.append(h)
        a = b
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(where, begin))


def lower(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; other letters stay."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def chunks(batches: Iterator, columns: list[str], size: int = 4 << 20) -> Iterator[list[list]]:
    """Lists of column values from Arrow batches, in chunks of about that many bytes; the last column has the texts."""
    held: list[list] = [[] for _ in columns]
    n = 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in columns]
        for row in zip(*cols, strict=True):
            for h, v in zip(held, row, strict=True):
                h.append(v)
            n += 4 * len(row[-1] or "") // 3
            if n >= size:
                yield held
                held, n = [[] for _ in columns], 0
    if held[0]:
        yield held


def pack(a: np.ndarray) -> bytes:
    """An integer array, compressed byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)
