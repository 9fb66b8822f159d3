"""ARC and WARC records as bytes: the line formats, declared lengths, identifiers and digests."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

# Fixed values of the two ARC versions: the fields of a record's header line.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PAGE_HEADER = b"X-Page-Id"
DATE = "20240101000000"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(version: int, records: list[bytes], name: str = "pages.arc", date: str = DATE) -> bytes:
    """An ARC file: the version block, then records, each after a newline."""
    body = f"{version} 0 taxloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
    more = " 200 - - 0 -" if version == 2 else ""
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode()
    return b"".join([head, body, *(b"\n" + r for r in records), b"\n"])


def arc_record(version: int, url: str, block: bytes, mime: str = "text/html", date: str = DATE, ip: str = "0.0.0.0") -> bytes:
    more = f" 200 {digest(block)} - 0 -" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{more} {len(block)}\n".encode() + block


def arc_records(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: header fields by name, and ``block``, as many bytes as the header line declares.

    The first record must be the version block; it says how the other header lines are read. A URL may hold spaces,
    so fields count from the right. A line with too few fields or a length past the end is an error.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        opening = version is None
        if opening:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC file starts with its version block")
            length = int(line.rsplit(" ", 1)[1])
            version = int(data[end + 1 : end + 1 + length].split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        fields = ARC_FIELDS[version]
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"not an ARC {version} header line: {line[:200]}")
        record = dict(zip(fields, values, strict=True))
        length = int(record["Archive-length"])
        if end < 0 or end + 1 + length > len(data):
            raise ValueError("a record is shorter than it declares")
        record["block"] = data[end + 1 : end + 1 + length]
        record["version"] = version
        at = end + 1 + length
        if not opening:
            yield record


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its empty line) and payload; a block without a header is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = block.find(mark)
        if at >= 0:
            return block[: at + len(mark)], block[at + len(mark) :]
    return block, b""


def header_value(header: bytes, name: bytes) -> str | None:
    for line in header.splitlines()[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def record_id(page: object, payload_digest: str) -> str:
    """An identifier that is the same on every run: from the page and its payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:sha1:{payload_digest}')}>"


def warc_date(arc_date: str) -> str:
    """14 digits as an ISO time; missing digits of a shorter date are those of the first moment."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, ident: str, url: str, date: str, ip: str, block: bytes, payload_digest: str, refers_to: str | None = None) -> bytes:
    """One WARC record without the two empty lines that end it."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {ident}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of a WARC file; header names in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record is shorter than it declares")
        yield headers, block
