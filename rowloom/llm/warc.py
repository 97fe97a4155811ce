"""WARC archives: writing records (revisits, segments, chunked payloads) and reading them back."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.workspace import Workspace

#: A record block larger than this is split into continuation records.
SEGMENT_BYTES = 32 * 1024
#: Size of the transfer chunks of a payload.
CHUNK = 4096
#: Pages in one archive file, at most.
FILE_RECORDS = 2000
#: Payloads shorter than this are stored again rather than referred to.
LEAST_REVISIT = 100

_END = b"\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    """The payload in HTTP chunked transfer framing."""
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """Undo :func:`chunked`; chunk extensions and trailers are skipped, broken framing raises."""
    parts, at = [], 0
    while True:
        stop = framed.index(b"\r\n", at)
        size = int(framed[at:stop].split(b";")[0].strip(), 16)
        at = stop + 2
        if not size:
            return b"".join(parts)
        parts.append(framed[at : at + size])
        if len(parts[-1]) != size or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its stated size")
        at += size + 2


def _record(kind: str, rid: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{rid}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def _line(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "")


def _record_id(page, row: int) -> str:
    """Unique to a row, however often its page_id occurs and whether it has one."""
    return f"{'' if page is None else page}:{row}"


def _records(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        names = ("row", "page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to", "refers_row")
        for row, page, url, html, size, digest, origin, origin_row in zip(*(batch[c].to_pylist() for c in names), strict=True):
            rid = _record_id(page, row)
            about = [("WARC-Payload-Digest", f"sha256:{digest}")]
            if url is not None:
                about.append(("WARC-Target-URI", _line(url)))
            if page is not None:
                about.append(("X-Page-ID", page))
            if origin is not None:
                about += [("WARC-Refers-To", f"<urn:page:{_record_id(origin, origin_row)}>"), ("X-Refers-To-Page-ID", origin), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", size)]
                out.append(_record("revisit", rid, about, b""))
                continue
            body = (html or "").encode()
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
            kind = [("Content-Type", "application/http; msgtype=response")]
            if len(block) <= segment:
                out.append(_record("response", rid, about + kind, block))
                continue
            parts = [block[i : i + segment] for i in range(0, len(block), segment)]
            for n, part in enumerate(parts, 1):
                if n == 1:
                    out.append(_record("response", rid, [*about, *kind, ("WARC-Segment-Number", 1)], part))
                else:
                    last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
                    out.append(_record("continuation", f"{rid}:{n}", [("WARC-Segment-Origin-ID", f"<urn:page:{rid}>"), ("WARC-Segment-Number", n), *last], part))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write ``pages(row, page_id, url, html, payload_bytes, payload_digest, refers_to, refers_row)``
    as gzipped WARC files below path: one response or revisit record a row, large blocks in
    segments. A record's id is made of page_id and ``row``, a number of its own for every row;
    the page_id itself stands in a field of its own.

    Spark's own writer makes the files, so any store it knows will do, and a task that is lost
    is written again.
    """
    records = pages.mapInArrow(partial(_records, segment=segment), "record binary")
    # Records may hold half a character at a segment's edge: the cast keeps bytes as they are.
    records.select(F.expr("cast(record as string)").alias("value")).write.option("lineSep", _END.decode()).option(
        "maxRecordsPerFile", FILE_RECORDS
    ).option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of one archive; blocks are cut
    by Content-Length alone, so they may hold anything."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        stop = data.index(_END, at)
        fields = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        begin = stop + 4
        size = int(fields["content-length"])
        if begin + size > len(data):
            raise ValueError("block shorter than its stated length")
        yield fields, data[begin : begin + size]
        at = begin + size + 4


_FIELDS = "record_id string, record_type string, page_id string, refers_to_page string, origin string, segment int, total long, url string, digest string, refers_to string, size long, block binary"


def _urn(value: str | None) -> str | None:
    return value[len("<urn:page:") : -1] if value else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for data in batch["content"]:
            rows, held = [], 0
            for f, block in parse_warc(data.as_py()):
                rid = _urn(f["warc-record-id"])
                number = f.get("warc-segment-number")
                rows.append((
                    rid, f["warc-type"], f.get("x-page-id"), f.get("x-refers-to-page-id"), _urn(f.get("warc-segment-origin-id")) or rid, int(number) if number else None,
                    int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f.get("warc-target-uri"),
                    f.get("warc-payload-digest", "").removeprefix("sha256:") or None, _urn(f.get("warc-refers-to")),
                    int(f["x-payload-length"]) if "x-payload-length" in f else None, block,
                ))
                held += len(block)
                if held >= 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for kind, block in zip(batch["record_type"].to_pylist(), batch["block"].to_pylist(), strict=True):
            head, _, body = block.partition(_END)
            out.append(None if kind == "revisit" else unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body)
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in batch.schema.names if c != "block"), pa.array(out, pa.binary())],
            names=[*(c for c in batch.schema.names if c != "block"), "payload"],
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, refers_to_page, url, digest, refers_to, size, payload)
    of the responses and revisits in the archives below path.

    Continuation records are grouped by their origin, put in order of segment number, and
    joined; a gap in the numbers or a total length that differs raises an error. One group
    holds one record's segments. Only segmented records are shuffled.
    """
    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, _FIELDS)
    whole = raw.where("segment is null").select("record_id", "record_type", "page_id", "refers_to_page", "url", "digest", "refers_to", "size", "block")
    parts = raw.where("segment is not null").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max("segment").alias("last"), F.first("page_id", ignorenulls=True).alias("page_id"), F.first("url", ignorenulls=True).alias("url"), F.first("digest", ignorenulls=True).alias("digest"),
    )
    block = F.aggregate("parts.block", F.lit(b"").cast("binary"), lambda acc, b: F.concat(acc, b))
    joined = parts.withColumn("block", block).select(
        F.col("origin").alias("record_id"), F.lit("response").alias("record_type"), "page_id", F.lit(None).cast("string").alias("refers_to_page"), "url", "digest",
        F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("long").alias("size"),
        F.when((F.size("parts") == F.col("last")) & (F.octet_length("block") == F.col("total")), F.col("block"))
        .otherwise(F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are missing or of another length"))).cast("binary")).alias("block"),
    )
    return whole.unionByName(joined).mapInArrow(
        _payloads, "record_id string, record_type string, page_id string, refers_to_page string, url string, digest string, refers_to string, size long, payload binary"
    )


def with_revisits(pages: DataFrame, ws: Workspace) -> DataFrame:
    """Pages with row (a number of its own), payload_bytes, payload_digest, refers_to and refers_row:
    of equal payloads of at least LEAST_REVISIT bytes that with the smallest page_id is stored,
    the others refer to it (where its page_id is repeated, to the first of its rows)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    # Written before use: the numbers must be the same for a record and for those that refer to it.
    all_pages = ws.save(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
            F.col("html").cast("string").alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"),
        ),
        "pages",
    )
    firsts = ws.save(
        all_pages.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("payload_digest", F.col("first.page_id").alias("origin"), F.col("first.row").alias("origin_row")),
        "firsts",
    )
    other = F.col("page_id") != F.col("origin")
    return all_pages.join(firsts, "payload_digest", "left").select(
        "row", "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(other, F.col("origin")).alias("refers_to"), F.when(other, F.col("origin_row")).alias("refers_row"),
    )


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write one WARC record a page and read the archives back.

    Result, all from what was read: page_id, payload_bytes, payload_digest (bare hex SHA-256),
    record_type, refers_to. The digest of a response is taken of the decoded payload and must
    equal the one in its header. Null or empty html: an empty payload. Payloads under
    LEAST_REVISIT bytes are always responses. Repeated rows of one page_id with equal html stay
    responses both, at any size; so do rows of one page_id that differ in html. A null page_id keeps its row with a null id. Extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    path = f"{ws.base}/archives"
    write_warc(with_revisits(pages, ws), path)
    ws.drop("pages", "firsts")
    read = read_warc(spark, path)
    digest = F.sha2("payload", 256)
    return read.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("size")).alias("payload_bytes"),
        F.when(F.col("payload").isNull(), F.col("digest"))
        .when(digest == F.col("digest"), digest)
        .otherwise(F.raise_error(F.concat(F.lit("payload of record "), "record_id", F.lit(" differs from its digest")))).alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )
