"""Token ids of documents in sorted-string-table shards.

A shard holds documents in ascending id order: blocks of entries whose keys are prefix-compressed, a sparse index with
each block's last key, a Bloom filter of all keys, and a footer that says where these are. One document is found by
the footer, the filter, a binary search of the index and one block.

    block   zstd of: entry count u32, then per entry: shared u8, rest u8, value length u32, rest of the key, value
    index   per block: key length u8, last key, offset u64, length u32
    filter  bits of a Bloom filter with 7 probes
    footer  index offset u64, index length u32, filter offset u64, filter length u32, entries u64, tokens u64,
            bytes a token u8, magic 8 bytes

Keys are 9 bytes: 0 and the id, big-endian with the sign bit flipped; 1 and zeros for a null id, which comes last.
Values are token ids, little-endian, 2 or 4 bytes each.

Defined results: a null text is empty and has the end id alone; repeated rows are entries of their own, in the order
of their values; texts without id come after all others, in an order of their own; a text of any length is one entry;
extra columns are ignored; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import files
from . import text_arrays as ta
from .common import cut, new_folder, small_arrow_batches

MAGIC = b"TLSSTBL1"
FOOTER = struct.Struct("<QIQIQQB8s")
BLOCK_BYTES = 64 << 10
PROBES = 7


# --- tokens ---------------------------------------------------------------------------------------------------------

#: A single space between two characters that are no white space: no token of the byte-level pattern spans the place
#: before it, so that a text may be encoded in the pieces that begin there. What counts as white space.
_BLANK = "\\s\x85\u180e\u200b\ufeff"
_CUT = re.compile(f"(?<=[^{_BLANK}]) (?=[^{_BLANK}])")
_ODD = re.compile(f"[{_BLANK}][{_BLANK}]|^[{_BLANK}]|[{_BLANK}]$")
#: The same for RE2: texts with white space at an end, next to white space, or beyond ASCII.
_RARE = r"\s\s|^\s|\s$|[\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_ENDS = frozenset(",.!?;:")


def _alphabet() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible characters as they are, the others from 256 upwards in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The tokenizers library's ids of texts, with a bounded store of the pieces that it has encoded.

    With a byte-level pattern tokenizer, texts are encoded in pieces, each distinct one of a batch once; with any other,
    whole.
    """

    def __init__(self, path: str, store: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        pre = self.tok.pre_tokenizer
        self.pieces = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tok.normalizer is None
        self.model, self.alphabet = self.tok.model, _alphabet()
        self.store, self.spaced, self.bare = store, {}, {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _ids(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, spaced: bool) -> bytes:
        """Ids of a word of letters, which is one pre-token, straight from the library's model."""
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.model.tokenize("\u0120" + raw if spaced else raw)])

    def piece(self, p: str, spaced: bool) -> bytes:
        """Ids of p, after a space if spaced. Between a letter and a mark, and around a lone line end, tokens part."""
        held = self.spaced if spaced else self.bare
        got = held.get(p)
        if got is not None:
            return got
        if p.isalpha():
            if len(held) > self.store:
                held.clear()
            got = held[p] = self._word(p, spaced)
            return got
        if p[-1:] in _ENDS and p[:-1].isalpha():
            return self.piece(p[:-1], spaced) + self.piece(p[-1], False)
        a, nl, b = p.partition("\n")
        if nl and a and b and not a[-1].isspace() and not b[0].isspace() and not _ODD.search(p):
            return self.piece(a, spaced) + self.piece("\n", False) + self.piece(b, False)
        if len(held) > self.store:
            held.clear()
        got = held[p] = self._ids(" " + p if spaced else p)
        return got

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.pieces:
            return [np.array(e.ids, self.kind) for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        rare = np.flatnonzero(pc.match_substring_regex(texts, _RARE).to_numpy(zero_copy_only=False))
        if not len(rare):
            return self._split(pc.split_pattern(texts, " "))
        lists = pc.split_pattern(texts, " ").to_pylist()
        for i in rare.tolist():
            lists[i] = _CUT.split(texts[i].as_py())
        return self._split(pa.array(lists, pa.list_(pa.string())))

    def _split(self, lists: pa.ListArray) -> list[np.ndarray]:
        first, values = lists.offsets.to_numpy(), lists.values
        coded = values.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        piece = self.piece
        table = [piece(p, True) for p in coded.dictionary.to_pylist()]
        heads = [piece(p, False) if p else b"" for p in values.take(pa.array(first[:-1])).to_pylist()]
        at[first[:-1]] = len(table) + np.arange(len(heads))
        table += heads
        lens = np.fromiter(map(len, table), np.int64, len(table)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(table), self.kind)
        begin, n = (np.cumsum(lens) - lens)[at], lens[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(begin - upto[:-1], n)
        place += np.arange(upto[-1])
        return np.split(flat[place], upto[first[1:-1]]) if len(heads) else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- shards ---------------------------------------------------------------------------------------------------------


def key_of(i: int | None) -> bytes:
    return b"\x01" + bytes(8) if i is None else b"\x00" + ((i + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] else int.from_bytes(key[1:], "big") - (1 << 63)


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    x = np.array([int.from_bytes(k[1:], "big") ^ (k[0] << 62) for k in keys], np.uint64)
    a, b = ta._mix(x), ta._mix(x ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def build(entries: list[tuple[bytes, bytes]], width: int) -> bytes:
    """A shard's bytes from (key, value) pairs in ascending order."""
    pack, out, index = zstandard.ZstdCompressor(level=3), [], []
    offset, held, size, last = 0, [], 0, b""

    def close() -> None:
        nonlocal offset, held, size, last
        data = pack.compress(struct.pack("<I", len(held)) + b"".join(held))
        index.append(struct.pack("<B", len(last)) + last + struct.pack("<QI", offset, len(data)))
        out.append(data)
        offset, held, size, last = offset + len(data), [], 0, b""

    for key, value in entries:
        shared = 0
        while shared < min(len(last), len(key)) and last[shared] == key[shared]:
            shared += 1
        held.append(struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value)
        size, last = size + len(held[-1]), key
        if size >= BLOCK_BYTES:
            close()
    if held:
        close()
    bits = max(64, 10 * len(entries) // 64 * 64 + 64)
    bloom = np.zeros(bits, bool)
    if entries:
        bloom[_probes([k for k, _ in entries], bits)] = True
    idx, flt = b"".join(index), np.packbits(bloom).tobytes()
    tokens = sum(len(v) for _, v in entries) // width
    return b"".join([*out, idx, flt, FOOTER.pack(offset, len(idx), offset + len(idx), len(flt), len(entries), tokens, width, MAGIC)])


class Shard:
    """Reads a shard by ranges."""

    def __init__(self, ranges: files.Ranges):
        self.ranges = ranges
        at, n, self.bloom_at, self.bloom_n, self.entries, self.tokens, self.width, magic = FOOTER.unpack(ranges.read(ranges.size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no shard of this format")
        raw, p, self.last, self.where = ranges.read(at, n), 0, [], []
        while p < len(raw):
            k = raw[p]
            self.last.append(raw[p + 1 : p + 1 + k])
            self.where.append(struct.unpack_from("<QI", raw, p + 1 + k))
            p += 13 + k
        self.kind = np.dtype(f"<u{self.width}")

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw = zstandard.ZstdDecompressor().decompress(self.ranges.read(*self.where[i]))
        p, key = 4, b""
        for _ in range(struct.unpack_from("<I", raw)[0]):
            shared, rest, size = struct.unpack_from("<BBI", raw, p)
            p += 6
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, np.frombuffer(raw, self.kind, size // self.width, p)
            p += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.where)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        bits = np.unpackbits(np.frombuffer(self.ranges.read(self.bloom_at, self.bloom_n), np.uint8))
        return bool(bits[_probes([key], len(bits))].all())

    def find(self, key: bytes) -> list[np.ndarray]:
        """Values of the key, most often one: filter, binary search of the index, then the blocks that may hold it."""
        from bisect import bisect_left

        if not self.may_hold(key):
            return []
        out, i = [], bisect_left(self.last, key)
        while i < len(self.where):
            got = list(self.block(i))
            out += [v for k, v in got if k == key]
            if got[-1][0] > key:
                break
            i += 1
        return out


# --- tables ---------------------------------------------------------------------------------------------------------


def _encode(path: str, end_id: int | None, bounds, loose: int, id_col: str, text_col: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(path), zstandard.ZstdCompressor(level=3)
        tail = np.array([] if end_id is None else [end_id], enc.kind)
        for batch in batches:
            ids = batch.column(id_col).to_pylist()
            got = [pack.compress(np.concatenate([x, tail]).tobytes()) for x in enc.encode(batch.column(text_col))]
            part = [len(bounds.value) + 1 + zlib.crc32(x) % loose if i is None else int(np.searchsorted(bounds.value, i, "right")) for i, x in zip(ids, got, strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int64()), "id": pa.array(ids, pa.int64()), "ids": pa.array(got, pa.binary())})

    return of


def _write(path: str, folder: str):
    def of(t: pa.Table) -> pa.Table:
        width, un = encoder_width(path), zstandard.ZstdDecompressor()
        part = t.column("part")[0].as_py()
        entries = sorted((key_of(i), un.decompress(b)) for i, b in zip(t.column("id").to_pylist(), t.column("ids").to_pylist(), strict=True))
        name = f"{folder}/shard-{part:09d}.sst"
        files.put(name, build(entries, width))
        return pa.table({"part": [part], "path": [name], "entries": [len(entries)], "tokens": [sum(len(v) for _, v in entries) // width], "first_id": pa.array([id_of(entries[0][0])], pa.int64()), "last_id": pa.array([id_of(entries[-1][0])], pa.int64())})

    return of


@lru_cache(maxsize=2)
def encoder_width(path: str) -> int:
    return encoder(path).kind.itemsize


def write(df: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 12 << 20) -> DataFrame:
    """Writes the shards, and returns their list: (part, path, entries, tokens, first_id, last_id, base), where base is
    the number of ids in all shards before. Shards hold texts of about shard_bytes, which bounds a task's memory."""
    spark = df.sparkSession
    small_arrow_batches(spark)
    folder = folder or new_folder(spark, "tokens")
    docs = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    bytes_ = F.octet_length(text_col)
    seen = docs.agg(F.sum(bytes_).alias("n"), F.sum(F.when(F.col(id_col).isNull(), bytes_)).alias("loose")).first()
    size, loose = seen["n"] or 0, (seen["loose"] or 0) // shard_bytes + 1  # texts without id take shards of their own, dealt by hash
    parts = max(spark.sparkContext.defaultParallelism, size // shard_bytes + 1)
    low = docs.select(id_col).filter(F.col(id_col).isNotNull()).repartitionByRange(parts, id_col).groupBy(F.spark_partition_id().alias("p")).agg(F.min(id_col).alias("low"))
    bounds = spark.sparkContext.broadcast(np.array(sorted(r["low"] for r in low.collect())[1:], np.int64))  # 8 bytes a shard
    coded = docs.mapInArrow(_encode(tokenizer, end_id, bounds, loose, id_col, text_col), "part long, id long, ids binary")
    listed = cut(coded.groupBy("part").applyInArrow(_write(tokenizer, folder), "part long, path string, entries long, tokens long, first_id long, last_id long"))
    # Sums up to each shard, of thousands of shards first.
    run = Window.rowsBetween(Window.unboundedPreceding, -1)
    some = listed.withColumn("some", F.floor(F.col("part") / 4096))
    upto = some.groupBy("some").agg(F.sum("tokens").alias("n")).withColumn("upto", F.coalesce(F.sum("n").over(run.orderBy("some")), F.lit(0))).drop("n")
    within = F.coalesce(F.sum("tokens").over(run.partitionBy("some").orderBy("part")), F.lit(0))
    return some.withColumn("within", within).join(upto, "some").withColumn("base", (F.col("within") + F.col("upto")).cast("long")).drop("some", "within", "upto")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "tokens": pa.binary()}
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            with files.Ranges(path) as ranges:
                shard, rows, size = Shard(ranges), [], 0
                for key, ids in shard:
                    rows.append((id_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})


def read(listed: DataFrame) -> DataFrame:
    """(id, start, n_tokens, tokens) of all documents of the listed shards; tokens: ids as little-endian u32."""
    dealt = listed.select("part", "path", "base").repartition(max(listed.sparkSession.sparkContext.defaultParallelism, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    return dealt.mapInArrow(_read, "id long, start long, n_tokens long, tokens binary")


def lookup(listed: DataFrame, ids: list[int]) -> dict[int, list[list[int]]]:
    """Token ids of single documents, by the list of shards, the filter and the index. For a few ids at a time."""
    out: dict[int, list[list[int]]] = {i: [] for i in ids}
    for i in ids:
        for r in listed.filter((F.col("first_id") <= i) & ((F.col("last_id") >= i) | F.col("last_id").isNull())).select("path").collect():
            with files.Ranges(r["path"]) as ranges:
                out[i] += [v.tolist() for v in Shard(ranges).find(key_of(i))]
    return out

