"""Operator 10: WARC archives, written and read back with boundary-chain verification.

Writing is native: digests (base32 of SHA-1) and records are column expressions, and Spark's text writer puts them into
files, one gzip stream each, of so many records that FILE_BYTES hold them on average. Reading has two steps. A task streams
through a file and emits an edge for every place where the record magic stands after a record end: from there to where its
length says the next record begins (if a record end is there). Payloads may hold the magic, even whole records; only what can
be reached from the start of the file is a record. The edges of a file are brought together, and pointer jumping finds that:
each round follows the jumps from the places reached so far and doubles the jumps, so n edges take log2 n rounds. Offsets are
those of the text inside the gzip stream.

Scale: pages are shuffled once, by payload digest and salt; a payload that many pages share is not brought together. A task
holds a compressed file and about a megabyte of its text, whatever its records are; edges are narrow rows. Payloads are
hashed as they stream by, only where the chain of the records so far says that one begins, so each byte is hashed once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, cut, ensure_checkpoint_dir, table

MAGIC = "WARC/1.0"
DATE = "2024-01-01T00:00:00Z"
FILE_RECORDS = 2000
FILE_BYTES = 64 << 20
HEADER_BYTES = 600  # of a record, about
MOST_HEADER = 1 << 20
CHUNK = 1 << 20
_START, _END = b"WARC/1.0\r\n", b"\r\n\r\n"


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1 of a text in UTF-8, as a column: five hex digits are four base32 digits."""
    h = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_url.

    Of pages with equal payloads of at least `least_bytes` bytes the one with the smallest page_id is the response (rows
    that share that id all are) and the others revisit it; smaller payloads are all responses. Null html is an empty
    payload; a page without an id is a response only among pages without one.
    """
    p = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    p = attach_by_key(p, ["payload_digest", "payload_bytes"], ["page_id"], {"first": least}, {"first": F.min("first")})
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return p.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_url"),
    )


def _record(c):
    """A whole record but for the last line end, which the text writer adds."""
    id_text = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    revisit = F.col("record_type") == "revisit"
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    some = lambda name, value, when=F.lit(True): F.when(when & value.isNotNull(), header(name, value)).otherwise("")
    uri = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7F]", "%20")
    # Rows that repeat a page are records of their own.
    uid = F.md5(F.concat_ws("|", id_text, F.col("payload_digest"), F.monotonically_increasing_id()).cast("binary"))
    uid = F.concat_ws("-", *[F.substring(uid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit(f"{MAGIC}\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uid, F.lit(">"))),
        some("WARC-Target-URI", uri("url")),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        some("X-Page-Id", F.col("page_id").cast("string")),
        some("X-Refers-To-Page", F.col("refers_to").cast("string")),
        some("WARC-Refers-To-Target-URI", uri("refers_to_url")),
        some("WARC-Refers-To-Date", F.lit(DATE), revisit),
        some("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), revisit),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        F.lit("\r\n"),
    )


def records_a_file(pages: DataFrame, most: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> int:
    """So many records that a file has about `file_bytes` bytes, by the mean size of all pages; `most` at most."""
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length("html").cast("long"))).first()
    return int(max(1, min(most, file_bytes // ((size or 0) // max(1, n) + HEADER_BYTES))))


def write_archives(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Archives under a path that all executors share."""
    out = records.select(_record(records).alias("value"))
    out.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def text_of(content: bytes, size: int = CHUNK):
    """The text of a file in parts of `size` bytes at most: of its gzip streams, or as it stands."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[a : a + size] for a in range(0, len(content), size))
        return
    view, at, rest, stream = memoryview(content), 0, b"", zlib.decompressobj(31)
    while rest or at < len(view):
        data = rest
        if not data:
            data = bytes(view[at : at + 65536])
            at += len(data)
        out = stream.decompress(data, size)
        rest = stream.unconsumed_tail
        if out:
            yield out
        if stream.eof:
            at, rest = at - len(stream.unused_data), b""
            stream = zlib.decompressobj(31)


def _header(lines: bytes):
    """(kind, length, payload length, digest, page id, page referred to) that headers name; None without a length."""
    h = {}
    for line in lines.split(b"\r\n"):
        name, _, value = line.partition(b":")
        h[name.strip().lower()] = value.strip()
    length = _number(h.get(b"content-length"))
    if length is None or length < 0:
        return None
    text = lambda name: h.get(name, b"").decode("utf-8", "replace")
    kind, said = text(b"warc-type"), text(b"warc-payload-digest").removeprefix("sha1:")
    return kind, length, _number(h.get(b"x-payload-length")), said, _number(h.get(b"x-page-id")), _number(h.get(b"x-refers-to-page"))


def candidates(parts):
    """Edges of a file that comes in parts: (at, following, page_id, payload_bytes, payload_digest, record_type, refers_to,
    digest_ok) for every place that looks like a record: magic at the start or after a record end, headers that end, a length, and a
    record end where the payload ends. The digest is that of the payload where the chain of records so far leads to the
    place, and null elsewhere; a revisit, which has no payload here, has size and digest of the full one from its headers.
    """
    text, base, look = bytearray(), 0, 0  # text[0] stands at base; magic is looked for from `look` on
    waiting: list[tuple] = []  # candidates by where their payload ends
    digests: dict[int, str] = {}
    chain, hashed = 0, None  # where the next record of the chain begins; [sha, upto, end, at] of the one that streams by

    def hash_on():
        nonlocal hashed
        if hashed:
            sha, upto, end, at = hashed
            to = min(end, base + len(text))
            sha.update(memoryview(text)[upto - base : to - base])
            hashed[1] = to
            if to == end:
                digests[at] = base64.b32encode(sha.digest()).decode()
                hashed = None

    for part in itertools.chain(parts, [None]):
        text += part or b""
        hash_on()
        while True:
            p = text.find(_START, look - base)
            if p < 0:
                look = max(look, base + len(text) - len(_START) + 1)
                break
            at, look = base + p, base + p + 1
            if at and (p < 4 or not text.startswith(_END, p - 4)):
                continue
            stop = text.find(_END, p, p + MOST_HEADER)
            if stop < 0:
                if part is not None and len(text) - p < MOST_HEADER:
                    look = at  # the headers may go on
                    break
                continue
            fields = _header(bytes(text[p + len(_START) : stop]))
            if not fields:
                continue
            begin = base + stop + 4
            heapq.heappush(waiting, (begin + fields[1], at, fields))
            if at == chain:
                chain = begin + fields[1] + 4
                if fields[0] != "revisit":
                    hashed = [hashlib.sha1(), begin, begin + fields[1], at]
                    hash_on()
        while waiting and waiting[0][0] + 4 <= base + len(text):
            end, at, (kind, length, size, said, page_id, refers_to) = heapq.heappop(waiting)
            digest = digests.pop(at, None)
            if text.startswith(_END, end - base):
                if kind == "revisit":
                    yield at, end + 4, page_id, size, said, kind, refers_to, True
                else:
                    yield at, end + 4, page_id, length, digest, kind, refers_to, digest == said
        keep = min(look, base + len(text)) - 4 - base
        if keep > 0:
            del text[:keep]
            base += keep


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the ascending places are reached from place 0 over the edges at -> following, by pointer jumping."""
    n = len(at)
    reached = np.zeros(n + 1, bool)  # the last one stands for the end of the file and for nowhere
    if not n or at[0] != 0:
        return reached[:n]
    place = np.minimum(np.searchsorted(at, following), n - 1)
    jump = np.append(np.where(at[place] == following, place, n), n)
    reached[0] = True
    while True:
        new = reached.copy()
        new[jump[reached]] = True
        if (new == reached).all():
            return reached[:n]
        reached, jump = new, jump[jump]


def _number(x):
    """The bigint that a header's value names; None for anything else."""
    n = int(x) if x is not None and re.fullmatch(rb"-?[0-9]{1,19}", x) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, digest_ok boolean"
EDGE = f"file bigint, at bigint, following bigint, {RECORD}"
EDGE_ROWS = 8192


def records_of(data: bytes) -> list[tuple]:
    """The records of an archive, as rows of RECORD."""
    found = sorted(candidates(text_of(data)))
    keep = reachable(np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64))
    return [f[2:] for f, ok in zip(found, keep) if ok]


def _edges(batches):
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in EDGE.split(", ")]
    for b in batches:
        for file, content in zip(b.column(0).to_pylist(), b.column(1)):
            found = ((file, *f) for f in candidates(text_of(content.as_py())))
            while rows := list(itertools.islice(found, EDGE_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _reached(key, t):
    t = t.take(np.argsort(t.column("at").to_numpy(), kind="stable"))
    ok = reachable(t.column("at").to_numpy(), t.column("following").to_numpy())
    return t.filter(pa.array(ok)).select([x.split()[0] for x in RECORD.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok of the records under a path."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content")
    return files.mapInArrow(_edges, EDGE).groupBy("file").applyInArrow(_reached, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0, file_records: int | None = None) -> DataFrame:
    """Writes a record for each page to the shared folder, reads the archives back and removes them. Columns of other names
    are ignored; an empty table gives an empty result."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(pages, least_bytes), path, file_records or records_a_file(pages))
    out = cut(read_archives(spark, path))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def op10_warc_boundary_chain(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


#: What the archives must give back. DuckDB has no base32; five hex digits are four base32 digits.
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_ok
FROM f
"""
