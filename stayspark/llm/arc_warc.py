"""Legacy web archives to WARC: ARC 1 and 2 files are parsed by their declared
header fields and lengths, equal payloads become revisits, and WARC records
with equivalent identifiers, dates, types and digests are written.

Archives are bounded segments (``SEGMENT_BYTES``, or one longer record), one
file each, gzip-compressed, written by Spark's writer to any store that it
reaches and read back as whole files. Only (digest, page) pairs are grouped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ensure_checkpoint_dir, small_enough, written

SEGMENT_BYTES = 8 << 20
#: Capture time of pages that have none.
NO_DATE = "19700101000000"
#: Repeated payloads (a digest, an id and a url each) that are broadcast.
BROADCAST_ROWS = 50_000

# --- fixed values of the two formats ---
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"),
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
# --- end of fixed values ---

PAGE_HEADER, PAYLOAD_SIZE_HEADER, REFERS_TO_HEADER = "X-Page-Id", "X-Payload-Length", "X-Refers-To-Page-Id"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(url: str) -> str:
    """A url for a space-separated line: no white space or control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"


# --- ARC --------------------------------------------------------------------

def arc_start(name: str, version: int) -> bytes:
    """Version block: the archive's own record, with its field names."""
    body = f"{version} 0 legacy\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = ["filedesc://" + name, "0.0.0.0", NO_DATE, "text/plain"]
    if version == 2:
        head += ["200", "-", "-", "0", name]
    return f"{' '.join([*head, str(len(body))])}\n".encode() + body + b"\n"


def arc_record(name: str, version: int, url: str, date: str, mime: str, block: bytes, offset: int = 0) -> bytes:
    """One record, without the line end that closes it."""
    head = [_escaped(url), "0.0.0.0", date, mime]
    if version == 2:
        head += ["200", "-", "-", str(offset), name]
    return f"{' '.join([*head, str(len(block))])}\n".encode() + block


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record after the version block.

    Field names come from the version block; lengths are the declared ones.
    A url that holds spaces is whatever stands before the last fields."""
    at, names = 0, None
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line without end at byte {at}")
        line = content[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if not line:
            at = end + 1
            continue
        n = len(names) if names else (10 if line.count(" ") >= 9 else 5)
        parts = line.rsplit(" ", n - 1)
        if len(parts) != n or not parts[-1].isdigit():
            raise ValueError(f"bad ARC header line at byte {at}: {line[:80]!r}")
        stop = end + 1 + int(parts[-1])
        if stop > len(content):
            raise ValueError(f"ARC record at byte {at} is longer than its archive")
        block = content[end + 1: stop]
        at = stop
        if names is None:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC archive starts with a filedesc record")
            version, fields = block.decode("utf-8").split("\n")[:2]
            names = tuple(fields.split())
            if names != ARC_FIELDS.get(int(version.split()[0])):
                raise ValueError(f"unknown ARC fields {names}")
        else:
            yield dict(zip(names, parts)), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers, payload); a block without them is payload."""
    if block.startswith(b"HTTP/"):
        for blank in (b"\r\n\r\n", b"\n\n"):
            cut = block.find(blank)
            if cut >= 0:
                return block[: cut + len(blank)], block[cut + len(blank):]
    return b"", block


def _header(http: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", http)
    return m[1].decode() if m else None


# --- WARC -------------------------------------------------------------------

def warc_date(arc_date: str) -> str:
    """W3C date of an ARC date of up to 14 digits (missing parts: the least)."""
    d = (arc_date + NO_DATE[len(arc_date):])[:14] if arc_date.isdigit() else NO_DATE
    try:
        return datetime.strptime(d, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(url: str, date: str, digest: str, page_id) -> str:
    """The same record gets the same identifier however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page_id}')}>"


def warc_record(r: dict) -> bytes:
    """One record, without the two line ends that close it."""
    date = warc_date(r["date"])
    block = r["http"] + (r["payload"] if r["record_type"] == "response" else b"")
    lines = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", record_id(r["url"], date, r["digest"], r["page_id"])),
             ("WARC-Date", date), ("WARC-Target-URI", r["url"]), ("WARC-Payload-Digest", "sha1:" + r["digest"]),
             ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
             ("WARC-Identified-Payload-Type", r["mime"]), (PAYLOAD_SIZE_HEADER, len(r["payload"]))]
    if r["page_id"] is not None:
        lines.append((PAGE_HEADER, r["page_id"]))
    if r["record_type"] == "revisit":
        to_date = warc_date(r["to_date"])
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", r["to_url"]), ("WARC-Refers-To-Date", to_date),
                  ("WARC-Refers-To", record_id(r["to_url"], to_date, r["digest"], r["refers_to"])),
                  (REFERS_TO_HEADER, r["refers_to"])]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return CRLF.join([WARC_VERSION.encode(), *(f"{k}: {v}".encode("utf-8", "surrogateescape") for k, v in lines), b"", block])


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, by the declared lengths."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = content[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = dict(h.split(": ", 1) for h in head)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if content[stop: stop + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} doesn't end where it says")
        yield headers, content[start:stop]
        at = stop + 4


# --- archives as DataFrames ---------------------------------------------------

def _segments(records: Iterator[bytes], start: bytes = b"", between: bytes = b"") -> Iterator[bytes]:
    """Records joined up to SEGMENT_BYTES (a longer one alone)."""
    held, size = [], 0
    for r in records:
        if size and size + len(r) > SEGMENT_BYTES:
            yield start + between.join(held)
            held, size = [], 0
        held.append(r)
        size += len(r)
    if size:
        yield start + between.join(held)


def _content_batches(segments: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for s in segments:
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.binary())], names=["content"])


def write_archives(segments: DataFrame, path: str, close: str) -> None:
    """A gzip-compressed file for each segment; ``close`` ends the last record."""
    (segments.select(F.col("content").cast("string")).write.option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("lineSep", close).option("maxRecordsPerFile", 1).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(content)``, one row per archive file, plain or gzip-compressed; one
    file at a time in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                raw = c.as_py()
                yield from _content_batches([gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(run, "content binary")


def pages_to_arc(pages: DataFrame, version: int = 1, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """``(content)``: ARC archives of captured pages, as a legacy crawler
    would have left them (the page's id is an HTTP header of the capture)."""
    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{uuid.uuid4().hex}.arc"

        def records():
            for b in batches:
                for i, url, html in zip(*b.columns):
                    i = i.as_py()
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    http += b"" if i is None else f"{PAGE_HEADER}: {i}\r\n".encode()
                    body = html.as_buffer()
                    yield arc_record(name, version, url.as_py(), NO_DATE, "text/html", http + CRLF + (body.to_pybytes() if body else b""))
        yield from _content_batches(_segments(records(), arc_start(name, version), b"\n"))
    return kept.mapInArrow(run, "content binary")


_PARSED = "page_id long, url string, date string, mime string, http binary, payload binary, digest string, size long"


def parse_arc_archives(archives: DataFrame, bodies: bool = True) -> DataFrame:
    """One row per ARC record: page, url, date, type, HTTP headers, payload,
    the payload's digest and size. Without ``bodies`` the headers and payload
    are null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                rows = []
                for f, block in parse_arc(c.as_py()):
                    http, payload = split_http(block)
                    page = _header(http, PAGE_HEADER)
                    rows.append((int(page) if page else None, f["URL"], f["Archive-date"], f["Content-type"],
                                 http if bodies else None, payload if bodies else None, sha1_base32(payload), len(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.int64()))],
                        names=["page_id", "url", "date", "mime", "http", "payload", "digest", "size"])
    return archives.mapInArrow(run, _PARSED)


def first_captures(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(of, first)``: for each payload of at least ``min_bytes`` bytes that
    several records have, its digest and the page, url and date of the
    smallest page id."""
    return (records.where(F.col("size") >= min_bytes).groupBy("digest")
            .agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("first"))
            .where("n > 1 and first is not null").select(F.col("digest").alias("of"), "first"))


def with_revisits(records: DataFrame, first: DataFrame) -> DataFrame:
    """Adds record_type, refers_to, to_url and to_date. Of records with equal
    payloads the smallest page id is the response (rows that share it are all
    responses), the others revisit it; groups without any id, and payloads
    not in ``first``, are all responses."""
    joined = records.join(first, F.col("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select(*records.columns, F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
                         *[F.when(revisit, F.col(f"first.{c}")).alias(a) for c, a in (("page_id", "refers_to"), ("url", "to_url"), ("date", "to_date"))])


def records_to_warc(records: DataFrame) -> DataFrame:
    """``(content)``: WARC archives of the records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for b in batches:
                names = b.schema.names
                for row in zip(*b.columns):
                    yield warc_record({n: v.as_py() for n, v in zip(names, row)})

        yield from _content_batches(_segments(made(), between=CRLF + CRLF))
    return records.mapInArrow(run, "content binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record: page_id, record_id, url, date, record_type,
    payload_bytes, payload_digest, refers_to, payload (null for a revisit).
    The digest of a stored payload is checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                rows = []
                for h, block in parse_warc(c.as_py()):
                    payload = split_http(block)[1] if h["WARC-Type"] == "response" else None
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and sha1_base32(payload) != digest:
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload differs from its digest")
                    page, to = h.get(PAGE_HEADER), h.get(REFERS_TO_HEADER)
                    rows.append((int(page) if page else None, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Type"],
                                 len(payload) if payload is not None else int(h[PAYLOAD_SIZE_HEADER]), digest, int(to) if to else None, payload))
                if rows:
                    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=_READ_NAMES)
    return read_archives(spark, path).mapInArrow(run, _READ)


_READ = ("page_id long, record_id string, url string, date string, record_type string, payload_bytes long, "
         "payload_digest string, refers_to long, payload binary")
_READ_NAMES = [f.split()[0] for f in _READ.split(", ")]


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """ARC files below ``arc_path`` to WARC files in ``warc_path``."""
    archives = read_archives(spark, arc_path)
    first = written(first_captures(parse_arc_archives(archives, bodies=False), min_bytes), "first_captures")
    # A short list of repeated payloads goes to every task; a long one is joined by digest, payloads and all.
    first = F.broadcast(first) if small_enough(first, BROADCAST_ROWS) else first
    write_archives(records_to_warc(with_revisits(parse_arc_archives(archives), first)), warc_path, "\r\n\r\n")


def archive_pages(pages: DataFrame, version: int = 1, min_bytes: int = 0, url_col: str = "url",
                  html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Pages to ARC files, those to WARC files, and what the WARC files hold
    (:func:`read_warc`), one row per page.

    Null html is an empty payload, a null url is written as ``-``; null ids
    stay null. Repeated rows give repeated records. Other columns are
    ignored. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stayspark/archives-{uuid.uuid4().hex}"
    write_archives(pages_to_arc(pages, version, url_col, html_col, id_col), f"{root}/arc", "\n")
    convert(spark, f"{root}/arc", f"{root}/warc", min_bytes)
    return read_warc(spark, f"{root}/warc")
