"""WARC archives of web pages, with a two-level capture index.

Archives are files of WARC/1.1 records, each a gzip member of its own. Of pages with equal payloads of at least
`revisit_bytes` that with the largest id is a response record, and the others are revisits that refer to it.

The index has a line for each capture: the URL with its host reversed (com,example)/path, the page id, and where the
record lies. Lines are sorted by URL key over all files, and cut into gzip blocks; the block directory holds each
block's first key, file and place. To find a URL, the directory is searched for its block (binary search), one block
is read and searched, and the record is read by its range. Reading everything back goes the same way: all blocks give
the captures, which are sorted by archive and place, and each record is read by its range.

Defined results: a null page is empty; a null URL has the key "-"; a record without id revisits the largest id of its
payload, too, and is a response if no record with that payload has one; of repeated rows of the largest id the first
by URL is the response, and the others revisit it; pages of any length are one record; extra columns are ignored; an
empty table gives no archive and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import cut, new_folder, small_arrow_batches

DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; lower-case host, no scheme, port or www."""
    if not url:
        return "-"
    try:
        s = urlsplit(url if "//" in url else "//" + url)
        host = (s.hostname or "").removeprefix("www.")
    except ValueError:
        return "-" + url.replace("\n", " ")
    return ",".join(reversed(host.split("."))) + ")" + (s.path or "/") + ("?" + s.query if s.query else "")


# --- records --------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", " ").replace("\n", " ")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Refers-To-Target-URI", (refers_url or "").replace("\r", " ").replace("\n", " "))]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 4, mtime=0)


@dataclass
class Record:
    page_id: int | None
    kind: str
    url: str
    payload: bytes | None  # None: a revisit
    payload_bytes: int
    digest: str
    refers_to: int | None


def parse(member: bytes) -> Record:
    """The record in a gzip member; a response's length and digest come from its payload itself."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    number = lambda v: int(v) if v else None
    page = number(fields["WARC-Record-ID"][len("<urn:page:") : -1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return Record(page, "revisit", fields["WARC-Target-URI"], None, said, digest, number(fields["WARC-Refers-To"][len("<urn:page:") : -1]))
    if len(payload) != said or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record of page {page}")
    return Record(page, "response", fields["WARC-Target-URI"], payload, said, digest, None)


# --- writing --------------------------------------------------------------------------------------------------------

CAPTURES = "key string, page_id long, path string, offset long, length long"


def _archive(folder: str):
    def of(t: pa.Table, aimed: pa.Table) -> pa.Table:
        target = {(r["page_id"], r["same"]): (r["refers_to"], r["refers_url"]) for r in aimed.to_pylist()}
        first: set[tuple] = set()  # the largest ids whose response is written
        rows = sorted(t.select(["page_id", "url", "html", "digest", "same"]).to_pylist(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["digest"], r["url"] or ""))
        if not rows:
            return pa.table({"key": pa.array([], pa.string()), "page_id": pa.array([], pa.int64()), "path": pa.array([], pa.string()), "offset": pa.array([], pa.int64()), "length": pa.array([], pa.int64())})
        name, out, offset = f"{folder}/archive-{t.column('archive')[0].as_py():08d}.warc.gz", [], 0
        found = {"key": [], "page_id": [], "path": [], "offset": [], "length": []}
        for r in rows:
            aim = target.get((r["page_id"], r["same"]), (None, None))
            if aim[0] is not None and aim[0] == r["page_id"] and (r["page_id"], r["same"]) not in first:
                first.add((r["page_id"], r["same"]))
                aim = None, None
            data = record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["digest"], *aim)
            for n, v in zip(found, (url_key(r["url"]), r["page_id"], name, offset, len(data)), strict=True):
                found[n].append(v)
            out.append(data)
            offset += len(data)
        files.put(name, b"".join(out))
        kinds = {"key": pa.string(), "path": pa.string()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in found.items()})

    return of


def _blocks(folder: str, lines: int):
    """Writes a range of sorted captures as blocks of a file; gives the directory's lines."""

    def of(t: pa.Table) -> pa.Table:
        part = t.column("range")[0].as_py()
        rows = sorted(t.drop_columns(["range"]).to_pylist(), key=lambda r: (r["key"], r["page_id"] is None, r["page_id"] or 0, r["path"], r["offset"]))
        name, out, offset = f"{folder}/index-{part:08d}.cdx.gz", [], 0
        found = {"first_key": [], "path": [], "offset": [], "length": [], "captures": []}
        for a in range(0, len(rows), lines):
            block = rows[a : a + lines]
            data = gzip.compress("".join(json.dumps([r[c] for c in ("key", "page_id", "path", "offset", "length")]) + "\n" for r in block).encode(), 6, mtime=0)
            for n, v in zip(found, (block[0]["key"], name, offset, len(data), len(block)), strict=True):
                found[n].append(v)
            out.append(data)
            offset += len(data)
        files.put(name, b"".join(out))
        kinds = {"first_key": pa.string(), "path": pa.string()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in found.items()})

    return of


def targets(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(digest256, n, refers_to, refers_url): the response that other pages with this payload revisit."""
    big = pages.filter(F.col("n") >= revisit_bytes)
    with_id = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    best = big.groupBy("same", "n").agg(F.max(with_id).alias("last"), F.count("*").alias("copies"))
    return best.filter("copies > 1 and last is not null").select("same", "n", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url"))


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, archive_bytes: int = 16 << 20, block_lines: int = 1000) -> DataFrame:
    """Writes archives and index; returns the block directory: (first_key, path, offset, length, captures)."""
    spark = df.sparkSession
    small_arrow_batches(spark)
    folder = folder or new_folder(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    raw = F.encode("html", "UTF-8")
    pages = pages.withColumns({"n": F.octet_length("html").cast("long"), "same": F.sha2(raw, 256), "digest": F.sha1(raw)})
    narrow = cut(pages.select("page_id", "url", "n", "same"))
    size = narrow.agg(F.sum("n").alias("n")).first()["n"] or 0
    archives = max(spark.sparkContext.defaultParallelism, int(size // archive_bytes) + 1)

    # Records without id are dealt by their URL, too, for there may be many.
    own = F.when(F.col("page_id").isNull(), F.col("url"))
    # Each page's target by its payload; hot payloads are few rows on the right, and Spark splits their left side.
    aimed = narrow.join(targets(narrow, revisit_bytes), ["same", "n"]).select("page_id", "same", "refers_to", "refers_url", own.alias("own")).distinct()
    archive = F.pmod(F.xxhash64("page_id", "same", own), F.lit(archives))
    dealt = pages.select("page_id", "url", "html", "digest", "same", archive.alias("archive"))
    # One shuffle of the pages: what refers to what is dealt by the same rule, and meets them at the archive.
    captures = cut(dealt.groupBy("archive").cogroup(aimed.withColumn("archive", F.pmod(F.xxhash64("page_id", "same", "own"), F.lit(archives))).drop("own").groupBy("archive")).applyInArrow(_archive(folder), CAPTURES))
    total = captures.count()
    ranges = max(1, total // (50 * block_lines))
    ranged = captures.repartitionByRange(ranges, "key", "page_id").withColumn("range", F.spark_partition_id())
    return cut(ranged.groupBy("range").applyInArrow(_blocks(folder, block_lines), "first_key string, path string, offset long, length long, captures long"))


# --- reading --------------------------------------------------------------------------------------------------------


def _lines(path: str, offset: int, length: int) -> list[list]:
    with files.Ranges(path) as f:
        return [json.loads(x) for x in zlib.decompress(f.read(offset, length), 31).splitlines()]


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p, o, n in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
            cols = [list(x) for x in zip(*_lines(p, o, n), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "path", "offset", "length"])


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def _records(keep_html: bool):
    def of(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("offset").to_pylist(), t.column("length").to_pylist(), strict=True))
        out = []
        with files.Ranges(t.column("path")[0].as_py()) as f:
            for o, n in rows:
                r = parse(f.read(o, n))
                html = r.payload.decode("utf-8", "surrogatepass") if keep_html and r.payload is not None else None
                out.append((r.page_id, r.url, r.payload_bytes, r.digest, r.kind, r.refers_to, html))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    return of


def captures(directory: DataFrame) -> DataFrame:
    """(key, page_id, path, offset, length) of all captures, from the index's blocks."""
    spark = directory.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return directory.repartition(parts, "path", "offset").mapInArrow(_captures, CAPTURES)


def read(directory: DataFrame, keep_html: bool = False) -> DataFrame:
    """All records: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, html).

    Each archive's captures are read by range in the order of their places.
    """
    return captures(directory).groupBy("path").applyInArrow(_records(keep_html), READ)


def lookup(directory: DataFrame, url: str) -> list[Record]:
    """The records of a URL: directory, one block or the few that its key spans, then range reads."""
    key, out = url_key(url), []
    before = directory.filter(F.col("first_key") < key).agg(F.max("first_key").alias("k")).first()["k"]
    near = directory.filter(F.col("first_key") <= key)
    if before is not None:
        near = near.filter(F.col("first_key") >= before)
    for block in near.select("path", "offset", "length").orderBy("first_key", "path", "offset").collect():  # one, or those that the key spans
        lines = _lines(*block)
        keys = [x[0] for x in lines]
        for _, _, path, offset, length in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
            with files.Ranges(path) as f:
                out.append(parse(f.read(offset, length)))
    return out
