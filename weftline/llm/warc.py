"""WARC archives of pages: write them, read them back, put segmented records together.

Writing: a page whose payload of ``DEDUP_BYTES`` or more is equal (by SHA-1) to that of
a page with a larger page_id becomes a revisit of the largest; all others are responses.
A response's block is an HTTP response in chunked transfer framing. A block of more than
``SEGMENT`` bytes is cut: the first part stands in the response record, the others in
continuation records. Spark's text writer makes the archives, with the end of a record
as its separator; files hold at most ``RECORDS`` records, so a file's size is bounded.
Every row has a record id of its own, whatever its page_id. The one that revisits refer
to is made of page_id and digest; where rows equal in both repeat, their ids are made of
row numbers and the reference names only what they have in common.

Reading: a task parses one archive at a time, record by record. Whole records are
decoded at once; parts are grouped by origin identifier, ordered by segment number,
and the parts' count and total length are verified before the chunked framing is
decoded. Payload lengths and digests are verified against the headers.

Defined results: a null html is an empty payload; a null or odd url is percent-encoded
or left out; equal payloads of one page_id are each a response; a null page_id is a
response that nothing refers to; a damaged record (lost parts, wrong length, wrong
digest, broken framing) is reported with ``valid`` false; an empty table gives empty
archives; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import by_size, observed, scratch, written

DEDUP_BYTES = 1000
SEGMENT = 32 << 10
CHUNK = 4 << 10
RECORDS = 1000
#: Digests that are broadcast, at most; each takes some 100 bytes.
MOST_BROADCAST = 100_000
END = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"

RECORD = "record_id string, type string, page_id bigint, refers_to bigint, origin string, segment int, total bigint, digest string, block binary"
PAYLOAD = "record_id string, type string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, valid boolean"


def _chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload in chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _head(kind: str, record_id: str, fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + END).encode()


def _referred(page_id: int, digest: str) -> str:
    """The record id of the response that revisits refer to."""
    return f"urn:page:{page_id}:sha1:{digest}"


def _records(row_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end them."""
    target = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else None
    common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", None if page_id is None else str(page_id))]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: {len(payload)}{END}".encode()
        yield _head("revisit", row_id, [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_referred(refers_to, digest)}>"), ("Content-Type", "application/http; msgtype=response")], len(block)) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    first = [*common, ("Content-Type", "application/http; msgtype=response")]
    yield _head("response", row_id, first + [("WARC-Segment-Number", "1")] * (len(parts) > 1), len(parts[0])) + parts[0]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Origin-ID", f"<{row_id}>"), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", str(len(block)) if n == len(parts) else None)]
        yield _head("continuation", f"{row_id}:{n}", more, len(part)) + part


def planned(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, refers_to, sole, row): refers_to is null for responses.

    ``sole`` is true for the only row of the page that revisits refer to, and ``row`` differs in all rows.

    Digests are grouped first, within each task and then over all, and those that occur
    more than once are written and counted. Up to ``MOST_BROADCAST`` they are broadcast, and
    no payload moves. Of more, the payloads of ``DEDUP_BYTES`` and up are dealt out once, by
    digest; where many have one digest, Spark splits them over tasks. Smaller payloads stay
    where they were read in any case.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    large = F.octet_length("html") >= DEDUP_BYTES
    keyed = rows.where(large).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    each = keyed.groupBy(F.col("digest").alias("_digest"), "page_id").agg(F.count("*").alias("n"))
    most = each.groupBy("_digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1 AND top.page_id IS NOT NULL")
    most = most.select("_digest", F.col("top.page_id").alias("last"), F.col("top.n").alias("times"))
    most, seen, _ = observed(most, "warc-digests", n=F.count(F.lit(1)))
    most = F.broadcast(most) if (seen["n"] or 0) <= MOST_BROADCAST else most
    twice = keyed.join(most, F.col("digest") == F.col("_digest"), "left")
    sole = F.coalesce((F.col("page_id") == F.col("last")) & (F.col("times") == 1), F.lit(False))
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    both = twice.select("page_id", "url", "html", refers.alias("refers_to"), sole.alias("sole"))
    small = rows.where(~large).select("page_id", "url", "html", F.lit(None).cast("bigint").alias("refers_to"), F.lit(False).alias("sole"))
    return both.union(small).withColumn("row", F.monotonically_increasing_id())


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a WARC record or more for every row of ``pages`` (page_id, url, html)."""
    schema = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "html"):
                out = []
                for page, url, html, refers, sole, row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "sole", "row")), strict=True):
                    payload = html.encode("utf-8", "replace")
                    digest = hashlib.sha1(payload).hexdigest()
                    row_id = _referred(page, digest) if sole else f"urn:page:{'' if page is None else page}:row:{row}"
                    out += _records(row_id, page, url, payload, digest, refers)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)

    records = planned(pages).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def _parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = dict(re.findall(r"^([^:\r\n]+):[ \t]*([^\r\n]*)", data[at:end].decode("utf-8", "replace"), re.M))
        headers = {k.lower(): v for k, v in headers.items()}
        length = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path, as Spark's file source finds them."""
    number = re.compile(r"\d+")

    def of_page(urn: str) -> int | None:
        found = re.match(r"<urn:page:(-?\d+)[:>]", urn)
        return int(found[1]) if found else None

    def row(headers: dict[str, str], block: bytes) -> tuple:
        page, segment, total = (headers.get(k) for k in ("x-page-id", "warc-segment-number", "warc-segment-total-length"))
        digest = headers.get("warc-payload-digest")
        return (
            headers.get("warc-record-id", "").strip("<>"), headers.get("warc-type"), int(page) if page and re.fullmatch(r"-?\d+", page) else None, of_page(headers.get("warc-refers-to", "")),
            headers["warc-segment-origin-id"].strip("<>") if "warc-segment-origin-id" in headers else None,
            int(segment) if segment and number.fullmatch(segment) else None, int(total) if total and number.fullmatch(total) else None, digest.removeprefix("sha1:") if digest else None, block,
        )

    types = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in _parsed(content.as_py()):
                    rows.append(row(headers, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in rows], schema=types)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in rows], schema=types)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def _judged(kind: str, block: bytes, digest: str | None) -> tuple[int | None, str | None, bool]:
    """Length and digest of a record's payload, and whether they can be trusted."""
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            length = re.search(rb"X-Payload-Length:\s*(\d+)", head, re.I)
            return (int(length[1]) if length else None), digest, digest is not None
        payload = dechunked(body) if re.search(rb"^transfer-encoding:\s*chunked", head, re.I | re.M) else body
        found = hashlib.sha1(payload).hexdigest()
        return len(payload), found, digest is None or digest == found
    except ValueError:
        return None, None, False


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """A row for every response and revisit of the archives, its payload's length and digest verified."""
    records = written(read_records(spark, path).where("type IN ('response', 'revisit', 'continuation')"), "warc-records")
    whole = records.where("segment IS NULL").select("record_id", "type", "page_id", "refers_to", "digest", "block", F.lit(True).alias("valid"))

    # parts of one record: as many rows as it has segments
    parts = records.where("segment IS NOT NULL").withColumn("key", F.coalesce("origin", "record_id"))
    own = F.col("segment") == 1
    grouped = parts.groupBy("key").agg(
        F.max(F.when(own, F.col("page_id"))).alias("page_id"), F.max(F.when(own, F.col("refers_to"))).alias("refers_to"), F.max(F.when(own, F.col("digest"))).alias("digest"),
        F.max("total").alias("total"), F.max(F.when(own, F.col("type"))).alias("type"), F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
    )
    size = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + F.octet_length(p["block"]))
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = grouped.select(
        F.col("key").alias("record_id"), F.coalesce("type", F.lit("response")).alias("type"), "page_id", "refers_to", "digest",
        F.transform("parts", lambda p: p["block"]).alias("blocks"), F.coalesce(in_order & (size == F.col("total")), F.lit(False)).alias("valid"),
    )
    every = whole.withColumn("blocks", F.array("block")).drop("block").unionByName(joined)

    types = pa.schema([
        ("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("valid", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for kind, blocks, digest, valid in zip(*(batch.column(c) for c in ("type", "blocks", "digest", "valid")), strict=True):
                block = b"".join(b.as_py() for b in blocks.values) if valid.as_py() else b""
                found.append(_judged(kind.as_py(), block, digest.as_py()) if valid.as_py() else (None, None, False))
            columns = [batch.column(c) for c in ("record_id", "type", "page_id", "refers_to")] + [pa.array([f[i] for f in found], types.field(4 + i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    return every.mapInArrow(run, PAYLOAD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives in the shared folder, and what reading these gives."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    out = read_payloads(pages.sparkSession, path)
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "valid")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {DEDUP_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to, true AS valid FROM m"""
