"""Web archives: legacy ARC records converted to WARC, written and read back.

An ARC record is a header line of space-separated fields, whose order the version block at the file's start declares
(version 1: URL, IP, date, type, length; version 2 adds result code, checksum, location, offset and file name before
the length), and a body of the declared length. The converter keeps the body as the WARC block and makes what ARC
lacks: a record id from the record's own facts, an ISO timestamp, a type, payload and block digests.

Archives are written by Spark's text writer with the WARC record end as line separator, gzipped, so they lie in
whatever store the shared folder is in; the reader takes whole files of bounded record number.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import workspace

ARC_V1 = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 100
#: Most payload bytes of a size class, and how many of its records go into one file, so that a file stays under about 256 MB unless one
#: record is longer. Only classes that occur are written.
SIZE_CLASSES = ((128 << 10, 2000), (4 << 20, 64), (1 << 62, 1))
ARC_DATE = "20240101000000"
_END = b"\r\n\r\n"
_HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    body: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes


def _field(value: str | None) -> str:
    """An ARC field: no blanks, never empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value or "") or "-"


def arc_version_block(version: int, name: str = "pages", date: str = ARC_DATE) -> bytes:
    text = f"{version} 0 lexiloom\n{ARC_V1 if version == 1 else ARC_V2}\n".encode()
    rest = f"{len(text)}" if version == 1 else f"200 - - 0 {name}.arc {len(text)}"
    return f"filedesc://{name}.arc 0.0.0.0 {date} text/plain {rest}\n".encode() + text + b"\n"


def arc_record(version: int, url: str | None, body: bytes, date: str = ARC_DATE, ip: str = "0.0.0.0", kind: str = "text/html") -> bytes:
    rest = f"{len(body)}" if version == 1 else f"200 - - 0 pages.arc {len(body)}"
    return f"{_field(url)} {ip} {date} {kind} {rest}\n".encode() + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records behind the version block of an ARC file, by declared lengths."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line without end at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1
            continue
        values = line.split(" ")
        if fields is None and not line.startswith("filedesc:"):
            raise ValueError("ARC file without version block")
        try:
            length = int(values[-1])
        except ValueError:
            raise ValueError(f"ARC header line without length at byte {at}: {line[:80]!r}") from None
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"ARC record of {length} bytes is cut at byte {at}")
        at = end + 1 + length
        if line.startswith("filedesc:"):
            fields = body.decode("utf-8", "replace").split("\n")[1].strip().split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError(f"ARC header line has {len(values)} fields, its version {len(fields)}")
        named = dict(zip(fields, values, strict=True))
        yield ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], body)


def _payload(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload of a body; bodies without an HTTP head are all payload."""
    if block.startswith(b"HTTP/"):
        head, sep, rest = block.partition(_END)
        if sep:
            return head + sep, rest
    return b"", block


def _warc_date(arc_date: str) -> str:
    d = (arc_date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record_id(url: str, date: str, body_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {body_digest}')}>"


def convert(record: ArcRecord) -> WarcRecord:
    """The WARC response (or resource, without an HTTP head) that says what an ARC record says."""
    head, payload = _payload(record.body)
    headers = {
        "WARC-Type": "response" if head else "resource",
        "WARC-Record-ID": _record_id(record.url, record.date, hashlib.sha256(record.body).hexdigest()),
        "WARC-Date": _warc_date(record.date),
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type": "application/http;msgtype=response" if head else record.kind,
    }
    return WarcRecord(headers, record.body)


def revisit(record: WarcRecord, first_page: int, first_url: str | None, first_body_digest: str) -> WarcRecord:
    """The same record without its payload, pointing at the record that has it. The page id of that record is a field of our own,
    which other readers pass over."""
    head, _ = _payload(record.block)
    url = _field(first_url)
    first = {
        "WARC-Refers-To": _record_id(url, ARC_DATE, first_body_digest),
        "WARC-Refers-To-Target-URI": url,
        "WARC-Refers-To-Date": _warc_date(ARC_DATE),
        "WARC-Refers-To-Page": str(first_page),
    }
    return WarcRecord(record.headers | {"WARC-Type": "revisit", "WARC-Profile": _PROFILE} | first, head)


def write_record(record: WarcRecord) -> bytes:
    """The record without its closing CRLF CRLF."""
    headers = record.headers | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(record.block).hexdigest()}", "Content-Length": str(len(record.block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + record.block


def _unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    z = zlib.decompressobj(31)
    for i in range(0, len(data), step):
        chunk = data[i : i + step]
        while chunk:
            out = z.decompress(chunk)
            if out:
                yield out
            if not z.eof:
                break
            chunk, z = z.unused_data, zlib.decompressobj(31)


def read_warc(chunks: Iterator[bytes]) -> Iterator[WarcRecord]:
    """Records of an unzipped WARC stream, by their declared lengths."""
    buf = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        got = next(chunks, None)
        if got:
            buf.extend(got)
        return got is not None

    while True:
        while (end := buf.find(_END)) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("WARC stream ends inside a header")
                return
        lines = bytes(buf[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        length = int(headers["Content-Length"])
        total = end + 4 + length + 4
        while len(buf) < total:
            if not more():
                raise ValueError("WARC stream ends inside a record")
        block = bytes(buf[end + 4 : end + 4 + length])
        del buf[:total]
        yield WarcRecord(headers, block)


def _http(page_id: int | None, payload: bytes) -> bytes:
    name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"{_HTTP_HEAD}{name}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _http_headers(block: bytes) -> dict[str, str]:
    head, _ = _payload(block)
    return dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)


def _payload_bytes(html: Column) -> Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "utf-8")


def payload_digests(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, n, digest, body_digest (of the HTTP message that is written) of the pages with payloads of ``least`` bytes, as a table."""
    body, page = _payload_bytes(F.col("html")), F.col("page_id").cast("long")
    head = F.concat(F.lit(_HTTP_HEAD), F.coalesce(F.concat(F.lit("X-Page-Id: "), page.cast("string"), F.lit("\r\n")), F.lit("")), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    message = F.sha2(F.concat(F.encode(head, "utf-8"), body), 256)
    rows = pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest"), message.alias("body_digest"))
    return workspace.materialize(rows.filter(F.col("n") >= least), "digests")


def first_pages(digests: DataFrame) -> DataFrame:
    """page_id, digest, refers_to, first_url and first_body of the pages whose payload an earlier page (by id) has."""
    first = digests.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "body_digest"))).alias("f"), F.count(F.lit(1)).alias("copies"))
    first = first.filter("copies > 1 and f is not null").select("digest", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("first_url"), F.col("f.body_digest").alias("first_body"))
    return digests.select("page_id", "digest").join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to", "first_url", "first_body").distinct()


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped WARC files of all of ``pages(page_id, url, html, ...)`` in folders under ``path``, one for each size class: each batch becomes an
    ARC file, versions in turn, and is converted. Null html is an empty payload, a null url is written as ``-``, null ids are left out."""
    workspace.ship(pages.sparkSession)
    digests = payload_digests(pages)
    body = _payload_bytes(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    e = first_pages(digests).withColumnRenamed("page_id", "eid").withColumnRenamed("digest", "edigest")
    columns = ["page_id", "url", "html", "refers_to", "first_url", "first_body"]

    def run(batches):
        version = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64).to_pylist()
                version = version % 2 + 1
                arc = b"".join([arc_version_block(version), *[arc_record(version, r["url"], _http(r["page_id"], (r["html"] or "").encode())) for r in part]])
                out = []
                for r, found in zip(part, read_arc(arc), strict=True):
                    record = convert(found)
                    out.append(write_record(record if r["refers_to"] is None else revisit(record, r["refers_to"], r["first_url"], r["first_body"])))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    above = [0, *[top for top, _ in SIZE_CLASSES]]
    sized = [F.count_if((F.col("n") > low) & (F.col("n") <= top)).alias(f"c{k}") for k, (low, (top, _)) in enumerate(zip(above, SIZE_CLASSES, strict=False))]
    found = digests.agg(*sized).first()
    present = [k for k, n in enumerate(found) if n or k == 0]
    for k in present:
        top, records = SIZE_CLASSES[k]
        mine = rows if present == [0] else rows.filter((F.octet_length(body) <= top) if k == 0 else (F.octet_length(body) > above[k]) & (F.octet_length(body) <= top))
        joined = mine.join(e, (F.col("page_id") == F.col("eid")) & (F.sha2(body, 256) == F.col("edigest")), "left").select(*columns)
        written = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
        written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/size-{k}")
    workspace.drop(digests)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, url, warc_date, record_id, payload_bytes, payload_digest, record_type, refers_to of every record under ``path``.
    The digest and size of a response are those of the payload that was read; a header that says otherwise is an error."""
    workspace.ship(spark)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in read_warc(_unzipped(content.as_py())):
                    h, http = record.headers, _http_headers(record.block)
                    said = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(http["Content-Length"])
                    if h["WARC-Type"] != "revisit":
                        _, payload = _payload(record.block)
                        if (hashlib.sha256(payload).hexdigest(), len(payload)) != (said, size):
                            raise ValueError(f"{h['WARC-Record-ID']}: payload does not match its digest or length")
                    page, first = http.get("X-Page-Id"), h.get("WARC-Refers-To-Page")
                    rows.append((page and int(page), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Record-ID"], size, said, h["WARC-Type"], first and int(first)))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "url", "warc_date", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = "page_id long, url string, warc_date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html, ...)`` as WARC into the shared folder and read it back: one row per page.

    Of pages with equal payloads of 100 bytes or more, those with the smallest page_id are responses (all of them, should rows repeat)
    and the others revisit it. A null page_id is written and read as null, as a response. An empty table gives no rows; other columns are
    ignored. Very long pages are whole: one record each.
    """
    spark = pages.sparkSession
    path = workspace.new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
