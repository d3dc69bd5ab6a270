"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

``read_records`` parses WARC files (plain, or gzip with any number of members) into rows of headers, ids, digests and
block; ``responses`` writes the response records of a page table. Each response gives two records that refer to it by
its record id: ``metadata`` (application/warc-fields: what its HTTP headers said, its charset, title and digests) and
``conversion`` (text/plain: the page's text). Ids follow from the source's id, place and content, so a task that runs
again writes the same records. One narrow pass; records are read and written one by one.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, in_chunks
from millrace.llm.html_text import blocks

VERSION = "WARC/1.1"
#: A fixed namespace for ids made here (a random public-domain UUID).
_NAMESPACE = uuid.UUID("5d1f4c1e-7f0c-4e3a-9a53-0e1f3f1b6c11")
#: Lengths as the formats write them: ASCII digits only, without signs.
_DECIMAL, _HEX = re.compile(r"[0-9]{1,18}"), re.compile(rb"[0-9A-Fa-f]{1,15}")
_PIECE = 1 << 14
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(parts))}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version line, headers, blank line, block, two blank lines. Line ends in values become spaces."""
    clean = lambda v: " ".join(v.split("\r")).replace("\n", " ")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Named fields in order, folded lines joined, names as written."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def named(fields: list[tuple[str, str]]) -> dict[str, str]:
    """Values by lower-case name; those of a repeated field are joined by a comma."""
    out: dict[str, str] = {}
    for name, value in fields:
        out[name.lower()] = f"{out[name.lower()]}, {value}" if name.lower() in out else value
    return out


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names as written, repeated ones joined by a comma) and block of a record made by any writer of the format."""
    fields, block, _ = next(records_of(record), (None, b"", 0))
    if fields is None:
        raise ValueError("not a WARC record")
    by, out = named(fields), {}
    for name, _ in fields:
        out.setdefault(name, by[name.lower()])
    return out, block


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members' contents piece by piece, in time linear in the data however many there are; damage ends it."""
    view, at = memoryview(data), 0
    while data[at : at + 2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        while at < len(data) and not stream.eof:
            piece = view[at : at + _PIECE]
            try:
                yield stream.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(stream.unused_data)


def unpacked(data: bytes) -> bytes:
    """The data, with all gzip members undone where it begins with one, up to the first damage; unread as it is if nothing is."""
    return b"".join(_members(data)) or data


def records_of(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, int]]:
    """Fields, block and place of every record of a plain WARC file; what follows damage is passed over to the next record.

    A record whose length is not a plain decimal number is passed over, too.
    """
    at, end = 0, -1
    while (at := data.find(b"WARC/", at)) >= 0:
        if at and data[at - 1 : at] != b"\n":
            at += 5
            continue
        if end < at:
            end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        again = data.find(b"\nWARC/", at, end)
        if again >= 0:  # a head that was cut off before another one began
            at = again + 1
            continue
        fields = _fields(data[at:end])
        size = named(fields).get("content-length", "")
        if not _DECIMAL.fullmatch(size):
            at += 5
            continue
        start = end + 4
        yield fields, data[start : start + int(size)], at
        at = start + int(size)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and payload with transfer and content coding undone."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, _, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line]
    said = named(fields)
    if "chunked" in said.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while (line := body.find(b"\r\n", at)) >= 0:
            said_size = _HEX.fullmatch(body[at:line].split(b";")[0].strip(b" \t"))
            size = int(said_size[0], 16) if said_size else 0
            if not size:
                break
            parts.append(body[line + 2 : line + 2 + size])
            at = line + 4 + size
        body = b"".join(parts)
    for coding in reversed(said.get("content-encoding", "").lower().replace(" ", "").split(",")):
        if coding in ("gzip", "x-gzip"):
            body = unpacked(body)
        elif coding == "deflate":
            body = _inflated(body)
        elif coding not in ("", "identity"):
            break  # brotli and others cannot be undone here: the payload stays as it is, and has no text
    else:
        return (lines[0] if lines else ""), fields, body
    return (lines[0] if lines else ""), [*fields, ("x-undecoded", coding)], body


def _inflated(body: bytes) -> bytes:
    """Deflate with or without its zlib header; what is neither stays."""
    for bits in (15, -15):
        try:
            return zlib.decompressobj(bits).decompress(body)
        except zlib.error:
            continue
    return body


def decode(payload: bytes, fields: list[tuple[str, str]]) -> tuple[str, str]:
    """Text and charset: from the content type, else from the page's head, else UTF-8; bad bytes are replaced.

    Names that are no charset of texts count as none.
    """
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    found = _CHARSET.search(kind) or _CHARSET.search(payload[:2048].decode("latin-1"))
    name = found[1].lower() if found else "utf-8"
    try:
        if codecs.lookup(name).name not in ("idna", "punycode", "undefined"):
            return payload.decode(name, "replace"), name
    except (LookupError, UnicodeError, ValueError):
        pass
    return payload.decode("utf-8", "replace"), "utf-8"


RECORDS = (
    "page_id long, warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "headers array<struct<name:string,value:string>>, block binary"
)


def _row(key: int | None, fields: list[tuple[str, str]], block: bytes) -> tuple:
    by = named(fields)
    return (
        key, by.get("warc-type", ""), by.get("warc-record-id", ""), by.get("warc-target-uri", "").strip("<>"), by.get("warc-date", ""), by.get("warc-payload-digest"),
        [{"name": n, "value": v} for n, v in fields], block,
    )


def read_records(files: DataFrame, content: str = "content", key: str | None = None) -> DataFrame:
    """All records of WARC files (plain or gzip), one row each: ids, URI, date, payload digest, all headers, block.

    ``files`` holds one file a row, as ``spark.read.format("binaryFile")`` gives; a file is held whole, so at most 2 GB,
    while its records leave one by one. ``key`` names a column to carry as ``page_id`` (null without it). A null or
    damaged file gives the records that can be read.
    """
    arrow = arrow_schema(files.sparkSession, RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k, data in zip(batch.column(0), batch.column(1)):
                for fields, block, _ in records_of(unpacked(data.as_py() or b"")):
                    rows.append(_row(k.as_py(), fields, block))
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    named_key = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return files.select(named_key.alias("page_id"), F.col(content)).mapInArrow(run, RECORDS)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A page table as WARC: page_id and ``content``, a response record; ``read_records`` reads it.

    Null html is an empty body, a null url an empty URI. The record id is of key, URI, date and body, so rows that
    differ in any of them have records of their own.
    """
    schema = "page_id long, content binary"
    arrow = arrow_schema(pages.sparkSession, schema)

    def one(k: int | None, u: str | None, t: str | None) -> bytes:
        body = (t or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        found = digest(body)
        fields = [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", u or "", date, str(k), found)), ("WARC-Target-URI", u or ""),
            ("WARC-Date", date), ("WARC-Payload-Digest", found), ("WARC-Block-Digest", digest(head + body)), ("Content-Type", "application/http; msgtype=response"),
        ]
        return build(fields, head + body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, uris, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in in_chunks(texts):
                made = [one(k.as_py(), u, t) for k, u, t in zip(keys.slice(a, b - a), uris[a:b], texts[a:b])]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(made, pa.binary())], schema=arrow)

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, schema)


def derive_one(source: dict) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """Type, headers and block of both derivatives of a response."""
    status, fields, payload = http_parts(source["block"] or b"")
    text, charset = decode(payload, fields)
    title, lang = _TITLE.search(text), _LANG.search(text)
    undecoded = next((v for k, v in fields if k == "x-undecoded"), None)
    plain = b"" if undecoded else " ".join(blocks(text)[0]).encode()
    about_source = [(h["name"], h["value"]) for h in source["headers"] or () if h["name"].lower() != "content-length"]
    found = digest(payload)
    said = [
        *((f"source-{k.lower()}", v) for k, v in about_source),
        ("http-status-line", status),
        *((f"http-header-{k.lower()}", v) for k, v in fields),
        ("charset-detected", charset),
        ("payload-digest", source["payload_digest"] or found),
        ("payload-digest-valid", str((source["payload_digest"] or found) == found).lower()),
        *([("title", " ".join(title[1].split()))] if title else []),
        *([("language", lang[1].lower())] if lang else []),
        ("conversion-digest", digest(plain)),
    ]
    about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in said).encode()
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", plain)):
        out.append(
            (
                kind,
                [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", record_id(kind, source["record_id"] or "")),
                    ("WARC-Refers-To", source["record_id"] or ""),
                    ("WARC-Refers-To-Target-URI", source["target_uri"] or ""),
                    ("WARC-Refers-To-Date", source["warc_date"] or ""),
                    ("WARC-Target-URI", source["target_uri"] or ""),
                    ("WARC-Date", source["warc_date"] or ""),
                    ("WARC-Block-Digest", digest(block)),
                    ("Content-Type", mime),
                ],
                block,
            )
        )
    return out


def derive(records: DataFrame, with_record: bool = True) -> DataFrame:
    """Two rows per response record of ``records``: its key, warc_type, ids, URI, date, source and own digests, sizes, and the record's bytes.

    ``record_sha256`` is of the whole record; ``record`` (left out unless asked for) is ready to be written, one after
    another. Its metadata keep the source's WARC and HTTP headers. Other types of records give nothing. A response with
    a null block gives empty derivatives, one in a coding that cannot be undone an empty conversion; repeated responses
    give equal ones.
    """
    schema = (
        "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, source_digest string, block_digest string, "
        "content_length long, record_sha256 string" + (", record binary" if with_record else "")
    )
    arrow = arrow_schema(records.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in in_chunks(batch.column("block").to_pylist()):
                rows = []
                for source in batch.slice(a, b - a).to_pylist():
                    for kind, fields, block in derive_one(source):
                        record, own = build(fields, block), dict(fields)
                        rows.append(
                            (source["page_id"], kind, own["WARC-Record-ID"], own["WARC-Refers-To"], own["WARC-Target-URI"], own["WARC-Date"])
                            + (source["payload_digest"], own["WARC-Block-Digest"], len(block), hashlib.sha256(record).hexdigest(), record)[: 5 if with_record else 4]
                        )
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    found = records.where(F.col("warc_type") == "response")
    return found.select("page_id", "record_id", "target_uri", "warc_date", "payload_digest", "headers", "block").mapInArrow(run, schema)
