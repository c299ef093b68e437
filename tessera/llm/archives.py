"""Legacy ARC archives converted to WARC, written and read back.

``parse_arc`` walks an ARC file by its version-specific header lines and declared lengths;
``warc_record`` synthesises the WARC identifiers, dates, types and digests that the old
format lacks. Archives are written and read by Spark, so any store it knows will do.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# The header fields of the two ARC versions, and the end of a WARC record
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"],
}
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: payloads of fewer bytes are always stored whole
LEAST_REVISIT_BYTES = 100
#: records of one written archive file
RECORDS_PER_FILE = 4000


class ArcError(ValueError):
    """An ARC header line or declared length that cannot be right."""


class ArcRecord(NamedTuple):
    fields: dict
    body: bytes
    offset: int


def arc_archive(name: str, records: list, version: int = 1, date: str = "20000101000000") -> bytes:
    """An ARC file of ``records`` (url, ip, date, content type, body) in the given version."""
    titles = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    about = f"{version} 0 archive\n{titles[version]}\n".encode()

    def line(url, ip, when, kind, size, offset, status="200"):
        if version == 1:
            return f"{url} {ip} {when} {kind} {size}\n".encode()
        return f"{url} {ip} {when} {kind} {status} - - {offset} {name} {size}\n".encode()

    out = [line(f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(about), 0), about, b"\n"]
    at = sum(map(len, out))
    for url, ip, when, kind, body in records:
        out += [line(url, ip, when, kind, len(body), at), body, b"\n"]
        at += len(out[-3]) + len(body) + 1
    return b"".join(out)


def _header(line: bytes, version: int, at: int) -> dict:
    names = ARC_FIELDS[version]
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)  # only the URL may hold spaces
    if len(parts) != len(names) or not parts[-1].isdigit() or not parts[2].isdigit():
        raise ArcError(f"bad version {version} header line at byte {at}")
    fields = dict(zip(names, parts))
    fields["length"] = int(fields["length"])
    return fields


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file (plain or gzip members), the version block first.

    The version block says which header line the other records have. A body is taken by its
    declared length, whatever it holds; blank lines between records are skipped.
    """
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_inflated(data))
    at, version = 0, None
    while True:
        while data[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        start, end = at, data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"header line without end at byte {at}")
        line = data[at:end].rstrip(b"\r")
        if version is None:
            if not line.startswith(b"filedesc://"):
                raise ArcError("no version block")
            # both versions end in the length; the block's own first line names the version
            tail = line.rsplit(b" ", 1)[-1]
            about = data[end + 1:end + 1 + int(tail)] if tail.isdigit() else b""
            number = about.split(b" ", 1)[0]
            version = int(number) if number.isdigit() else 0
            if version not in ARC_FIELDS:
                raise ArcError("unknown version")
            fields = _header(line, version if line.count(b" ") >= 9 else 1, at)
        else:
            fields = _header(line, version, at)
        body = data[end + 1:end + 1 + fields["length"]]
        if len(body) < fields["length"]:
            raise ArcError(f"record at byte {start} is cut short")
        at = end + 1 + fields["length"]
        yield ArcRecord(fields, body, start)


def _inflated(data: bytes) -> Iterator[bytes]:
    """Plain bytes of gzip members, a piece at a time."""
    while data:
        member = zlib.decompressobj(31)
        piece = member.decompress(data, 1 << 20)
        while piece or not member.eof:
            yield piece
            if not member.unconsumed_tail and not member.eof and not piece:
                raise ArcError("compressed member is cut short")
            piece = member.decompress(member.unconsumed_tail, 1 << 20)
        data = member.unused_data


def warc_date(arc_date: str) -> str:
    """``YYYYMMDDhhmmss`` (or its first 4 to 12 digits) as a WARC date."""
    d = arc_date[:14] + "00000101000000"[len(arc_date[:14]):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(body: bytes) -> tuple:
    """(HTTP header with its blank line, payload); no header: all is payload."""
    if body.startswith(b"HTTP/"):
        end = body.find(b"\r\n\r\n")
        if end >= 0:
            return body[:end + 4], body[end + 4:]
    return b"", body


def record_id(name: str, record: ArcRecord) -> str:
    """A record id that only hangs on the old record's place and name: rerun, same id."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{record.offset}#{record.fields['url']}#{record.fields['date']}')}"


def warc_record(name: str, record: ArcRecord, extra: dict | None = None, refers_to: dict | None = None) -> bytes:
    """One WARC record (without its closing blank lines) for an ARC record.

    The version block becomes ``warcinfo``, HTTP bodies ``response``, anything else
    ``resource``; with ``refers_to`` the record is a ``revisit`` that keeps the HTTP header.
    """
    http, payload = split_http(record.body)
    f = record.fields
    kind = "warcinfo" if f["url"].startswith("filedesc://") else "response" if http else "resource"
    block = record.body
    if refers_to is not None:
        kind, block = "revisit", http
    mime = {"warcinfo": "text/plain", "resource": f["content_type"]}.get(kind, "application/http;msgtype=response")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id(name, record)}>", "WARC-Date": warc_date(f["date"]),
            "Content-Type": mime, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    if kind == "warcinfo":
        head["WARC-Filename"] = name
    else:
        head |= {"WARC-Target-URI": f["url"], "WARC-IP-Address": f["ip"],
                 "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}"}
    if kind == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE} | refers_to
    head |= (extra or {}) | {"Content-Length": str(len(block))}
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """``(header, block)`` of every record in a stream of bytes, checked against its lengths
    and block digest; holds one record at a time."""
    buffer = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while len(buffer) < 4 and more():
            pass
        while buffer[:2] == b"\r\n":
            del buffer[:2]
            while len(buffer) < 4 and more():
                pass
        if not buffer:
            return
        seen = 0
        while (end := buffer.find(END, seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not more():
                raise ValueError("WARC header without end")
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size, start = int(head["Content-Length"]), end + 4
        while len(buffer) < start + size:
            if not more():
                raise ValueError("WARC record is cut short")
        block = bytes(buffer[start:start + size])
        if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError("WARC block does not match its digest")
        del buffer[:start + size]
        yield head, block


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def convert_arc(archives: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """``(name, offset, record, problem)``: WARC records of ARC files (``binaryFile`` rows).

    A null or empty file has no records. A file that breaks off or has a bad line gives its
    records up to there and one row with ``problem`` set and a null record.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("record", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, name = [], name or ""
                try:
                    for r in parse_arc(data.as_py() or b""):
                        rows.append((name, r.offset, warc_record(name, r), None))
                        if len(rows) >= 256:
                            yield _batch(rows, schema)
                            rows = []
                except ArcError as e:
                    rows.append((name, None, None, str(e)))
                if rows:
                    yield _batch(rows, schema)

    return archives.select(F.col(name_col).cast("string"), F.col(content_col)).mapInArrow(run, "name string, offset long, record binary, problem string")


def _as_arc(name: str, rows: list, version: int) -> bytes:
    """Pages as an ARC file: each body is an HTTP response with the page as its payload."""
    def clean(url):
        return "".join((url or "about:blank").split()) or "about:blank"

    return arc_archive(name, [(clean(url), "0.0.0.0", "20000101000000", "text/html",
                               b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html)
                              for url, html in rows], version)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(record)``: WARC records of a page table, converted from ARC files of its rows.

    Rows are grouped into ARC files of both versions as they come; of equal payloads of at
    least ``LEAST_REVISIT_BYTES`` bytes the row with the smallest id is the response. The
    digests of all payloads are compared as narrow rows; page texts move once, by their
    unique id. Null pages have an empty payload; a null id is never referred to.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        html.cast("binary").alias("html"), F.sha2(html, 256).alias("digest"))
    sums = rows.where(F.octet_length("html") >= LEAST_REVISIT_BYTES).where("id is not null").select("id", "digest")
    first = sums.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = (sums.join(first, "digest").where("id > first").select("id", "digest", "first").distinct())
    typed = rows.join(again, ["id", "digest"], "left").select("id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, pages_, firsts = (batch.column(i).to_pylist() for i in range(4))
            for lo in range(0, len(ids), 64):
                hi = min(lo + 64, len(ids))
                version = 1 + (lo // 64) % 2
                name = f"pages-{ids[lo]}-{hi - lo}.arc"
                out = []
                for k, r in enumerate(parse_arc(_as_arc(name, list(zip(urls[lo:hi], pages_[lo:hi])), version))):
                    extra, refers = {}, None
                    if k:
                        extra = {"X-Source-Id": "" if ids[lo + k - 1] is None else ids[lo + k - 1]}
                        if firsts[lo + k - 1] is not None:
                            refers = {"WARC-Refers-To-Target-URI": r.fields["url"], "X-Refers-To-Source-Id": firsts[lo + k - 1]}
                    out.append(warc_record(name, r, extra, refers))
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    return typed.mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzip-compressed WARC files in the folder ``path``: the text writer ends each
    record with the two blank lines that the format asks for."""
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode())
     .option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def read_warc(spark, path: str) -> DataFrame:
    """One row per record of the WARC files in ``path``: type, source ids, payload facts.

    ``payload_bytes`` and ``payload_digest`` are computed from the stored payload; a revisit
    stores none, so they come from its header fields.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_id", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])
        for batch in batches:
            for data in batch.column(0):
                raw, rows = data.as_py() or b"", []
                pieces = _inflated(raw) if raw[:2] == b"\x1f\x8b" else iter([raw])
                for head, block in parse_warc(pieces):
                    http, payload = split_http(block)
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    stated = head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    if head["WARC-Type"] == "revisit":
                        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if x)
                        size, digest = int(fields["Content-Length"]), stated
                    elif stated and stated != digest:
                        raise ValueError("WARC payload does not match its digest")
                    rows.append((head.get("X-Source-Id"), head["WARC-Type"], head["WARC-Record-ID"].strip("<>"), head.get("WARC-Target-URI"),
                                 size, digest, head.get("X-Refers-To-Source-Id")))
                if rows:
                    yield _batch(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "source_id string, record_type string, record_id string, url string, payload_bytes long, "
                                 "payload_digest string, refers_to string")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages written as WARC archives in the shared checkpoint folder and read back:
    ``(id, payload_bytes, payload_digest, record_type, refers_to, record_id, url)`` per row.

    Empty tables give an empty result; repeated rows give a record each; other columns are
    ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(page_records(pages, id_col, url_col, html_col), path)
    back = read_warc(spark, path).where("record_type <> 'warcinfo'")
    return back.select(F.expr("cast(nullif(source_id, '') as long)").alias("id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"), "record_id", "url")
