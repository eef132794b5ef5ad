"""WARC archives of pages: written with an index, read back by sorted byte ranges.

Writing tasks put each record into a gzip member of its own and hand back the index: file,
offset, length, URL and digest of the record.  Readers choose records in the index, sort
them by file and offset over all tasks, and fetch neighbouring ranges with one read.  A file
belongs to one attempt of one task and only files named in the index count, so a task that is
run again leaves nothing wrong behind.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import files
from .common import shared_dir, table, tasks_for, written

MIN_REVISIT = 1000
#: Up to this many digests of repeated payloads (some 100 bytes each) are sent to every executor.
BROADCAST_COPIES = 200_000
#: Beyond, payloads meet them by digest and one of so many parts, so a popular page isn't one task's.
SALTS = 32
#: Bytes of archives that one task reads.
READ_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


#: A header of our own: the URL had line ends, so these and its percent signs are escaped.
ESCAPED = "X-Target-URI-Escaped: true"


def _escaped(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC 1.1 record, as a gzip member; a revisit (refers_to is set) has no payload, but its length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head += [f"WARC-Target-URI: {_escaped(url)}", ESCAPED] if "\r" in url or "\n" in url else [f"WARC-Target-URI: {url}"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """What a record holds; the digest of a response is taken from its payload and must be the one it names."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": _unescaped(fields["WARC-Target-URI"]) if ESCAPED.partition(":")[0] in fields else fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT, most: int = 1 << 30) -> DataFrame:
    """Write a record per row of pages (page_id, url, html; other columns are ignored) and return the index.

    Equal payloads of at least min_revisit bytes: those with the largest page_id are responses (all
    rows that repeat that id), the others revisit it; if all their ids are null, all are responses.
    A null html is an empty payload; a null URL is left out of the record.  An empty table has
    an empty index.  Repeated rows have a record each.  Only digests are shuffled while those of repeated
    payloads can be broadcast; beyond BROADCAST_COPIES payloads are too, by digest and part.
    """
    folder = folder or shared_dir(ship(pages.sparkSession))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_revisit)
    copies = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1")
    copies = written(copies.select("digest", "first"), "copies")
    first = F.when((F.octet_length("payload") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    if copies.count() <= BROADCAST_COPIES:
        rows = rows.join(F.broadcast(copies), "digest", "left")
    else:
        part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", part).join(copies, ["digest", "salt"], "left")
    rows = rows.select("page_id", "url", "payload", "digest", first.alias("refers_to"))

    def archive(batches):
        out, uri, at = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    (uri, out), at = files.create(folder, f"part-{TaskContext.get().partitionId():05d}", ".warc.gz"), 0
                member = record(page_id, url, payload, digest, refers_to)
                out.write(member)
                index.append((page_id, url, uri, at, len(member), digest, len(payload), "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], [f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return written(rows.mapInArrow(lambda b: archive(x for x in b if x.num_rows), INDEX), "index")


def read(index: DataFrame, each: int = READ_BYTES) -> DataFrame:
    """The records that rows of an index name, from their archives.

    Sorted by file and offset, they are dealt to tasks by the bytes to read, about `each` in one, not by the index's own size.
    A record that is named twice is read twice; an empty index gives an empty result.
    """

    def fetch(batches):
        def places():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)

        names, types = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        pack = lambda found: pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)], list(names))
        found, size = [], 0
        for member in files.read_ranges(places()):
            found.append(parse(member))
            size += found[-1]["payload_bytes"]
            if len(found) >= 2000 or size >= 16 << 20:
                yield pack(found)
                found, size = [], 0
        if found:
            yield pack(found)

    size = index.agg(F.sum("length")).first()[0] or 0
    return index.select("file", "offset", "length").repartitionByRange(tasks_for(index.sparkSession, size, each), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetch, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back: a row per page."""
    return read(write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}

ORACLES = {
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p),
t AS (SELECT *, n >= 1000 AND page_id IS DISTINCT FROM first AND first IS NOT NULL AS again FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM t"""
}
