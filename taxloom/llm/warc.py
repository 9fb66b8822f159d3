"""WARC archives from legacy ARC records: convert, mark revisits, write through Spark, read back."""

from __future__ import annotations

import gzip
import io
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.llm.archives import PAGE_HEADER, arc_file, arc_record, arc_records, digest, header_value, record_id, split_http, warc_date, warc_record, warc_records
from taxloom.llm.common import cut, discard, own_dir, stored

SEGMENT = 1 << 20
FILE_BYTES = 1 << 24
BROADCAST_ROWS = 100_000
RECORD = "page_id string, url string, ip string, date string, header binary, payload binary, payload_bytes long, payload_digest string"


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Rows of ``content``: ARC files of about a MiB with a record for each page; versions 1 and 2 take turns.

    A record's block is an HTTP response with the page's id, escaped as in a URL, in a header line and the text in UTF-8
    as payload (null: empty). White space and control characters of a URL are escaped; a null or blank URL becomes
    'urn:page:' and the id.
    """
    narrow = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).alias("payload"))

    def build(batches):
        turn, held, size = 0, [], 0
        for batch in batches:
            bodies = batch.column(2).cast(pa.binary())
            for page, url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, strict=True):
                payload = body.as_py() or b""
                own = b"" if page is None else b"%s: %s\r\n" % (PAGE_HEADER, quote(page).encode())
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (own, len(payload), payload)
                clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or "").strip()) or f"urn:page:{page}"
                held.append(arc_record(1 + turn % 2, clean, block))
                size += len(block)
                if size >= SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array([arc_file(1 + turn % 2, held)], pa.binary())], names=["content"])
                    turn, held, size = turn + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([arc_file(1 + turn % 2, held)], pa.binary())], names=["content"])

    return narrow.mapInArrow(build, "content binary")


def convert(archives: DataFrame) -> DataFrame:
    """Parse ARC files (``content``, as the binary file source reads them) into what WARC records need.

    Header lines are read as the file's version block says and blocks by their declared lengths. Date, digest and page
    id (null if a record has none) are synthesised from them.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in arc_records(content.as_py()):
                    header, payload = split_http(r["block"])
                    page = header_value(header, PAGE_HEADER)
                    rows.append((page if page is None else unquote(page), r["URL"], r["IP-address"], warc_date(r["Archive-date"]), header, payload, len(payload), digest(payload)))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return archives.select("content").mapInArrow(parse, RECORD)


def revisits(records: DataFrame, least_bytes: int = 0, kind: str = "string") -> DataFrame:
    """(page_id, payload_digest, response): of equal payloads the largest page id is the response, the others revisit it.

    Ids are compared as values of the type ``kind``.
    """
    typed = records.select(F.col("page_id").cast(kind).alias("page"), "page_id", "payload_digest", "payload_bytes")
    heads = typed.filter(f"payload_bytes >= {least_bytes}").groupBy("payload_digest", "payload_bytes")
    shared = heads.agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = typed.join(shared, ["payload_digest", "payload_bytes"]).filter("not (page <=> response)")
    return rows.select("page_id", "payload_digest", F.col("response").cast("string").alias("response")).distinct()


def write_warc(records: DataFrame, again: DataFrame, path: str) -> None:
    """Write the records as WARC files of about ``FILE_BYTES`` under path; pages in ``again`` become revisits without payload.

    Each record is a gzip member of its own, so that a reader may start at any of them.
    """

    def build(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    revisit = r["response"] is not None
                    kind = "revisit" if revisit else "response" if r["header"] else "resource"
                    block = r["header"] if revisit else r["header"] + r["payload"]
                    refers = record_id(r["response"], r["payload_digest"]) if revisit else None
                    record = warc_record(kind, record_id(r["page_id"], r["payload_digest"]), r["url"], r["date"], r["ip"], block, r["payload_digest"], refers)
                    held.append(gzip.compress(record + b"\r\n\r\n", 6, mtime=0))
                    size += len(held[-1])
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])

    marks = cut(again)
    small = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(marks) if small else marks
    on = [records["page_id"].eqNullSafe(side["page_id"]), records["payload_digest"] == side["payload_digest"]]
    marked = records.join(side, on, "left").select(*[records[c] for c in records.columns], side["response"])
    # A string column may hold any bytes and the text sink writes them as they are. It ends a row with its separator: an empty gzip member.
    end = gzip.compress(b"", mtime=0).decode("latin-1")
    sink = marked.mapInArrow(build, "file binary").select(F.col("file").cast("string")).write
    sink.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the WARC files under path: type, ids, URL, date, page id, payload, and its full size and digest.

    A response's payload is checked against its digest. A revisit's size is the one that its HTTP header declares.
    Without ``with_payload`` the payload is checked and left out.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in warc_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    header, payload = split_http(block)
                    declared = head["warc-payload-digest"].removeprefix("sha1:")
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and digest(payload) != declared:
                        raise ValueError(f"the payload of {head['warc-record-id']} has changed")
                    size = int(header_value(header, b"Content-Length") or 0) if revisit else len(payload)
                    page = header_value(header, PAGE_HEADER)
                    own = payload if with_payload and not revisit else None
                    rows.append((head["warc-record-id"], head["warc-type"], head["warc-target-uri"], head["warc-date"], head.get("warc-refers-to"), page if page is None else unquote(page), own, size, declared))
                    held += len(own or b"")
                    if len(rows) == 2048 or held > FILE_BYTES:
                        yield _table(rows)
                        rows, held = [], 0
                if rows:
                    yield _table(rows)

    def _table(rows):
        names = ["record_id", "record_type", "url", "date", "refers_to_record", "page_id", "payload", "payload_bytes", "payload_digest"]
        kinds = [pa.string()] * 6 + [pa.binary(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    out = files.mapInArrow(parse, "record_id string, record_type string, url string, date string, refers_to_record string, page_id string, payload binary, payload_bytes long, payload_digest string")
    return out if with_payload else out.drop("payload")


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Convert pages, as ARC records, to WARC files under path (the shared folder if none) and read the files back.

    The ARC records are parsed once; what they hold is kept as Parquet in the shared folder until the WARC files are
    written from it. Of records with equal payloads of ``least_bytes`` or more, that with the largest page id is a
    response and the others revisit it; all else are responses. Returns page_id, ``payload_bytes``, ``payload_digest``
    (of the full payload), ``record_type``, ``refers_to``, ``url``, ``record_id``.

    Page ids are of any type that Spark casts to text and back. A null html is an empty payload; null or odd URLs are
    replaced or escaped. Rows that repeat a page id are records of their own; if their payloads are equal too they are
    both responses or both revisits. Null ids come after all others. Other columns are ignored. An empty table gives an
    empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    path = path or f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = stored(convert(pages_to_arc(pages)), "arc-records")
    write_warc(records, revisits(records, least_bytes, kind), path)
    discard(records)
    back = cut(read_warc(spark, path, with_payload=False))
    first = back.filter("record_type != 'revisit'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").cast(kind).alias("refers_to")).distinct()
    joined = back.join(first, "refers_to_record", "left")
    return joined.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")
