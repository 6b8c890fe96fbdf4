"""WARC archives from legacy ARC records.

``read_arc`` parses ARC files of version 1 (five header fields) and 2 (ten) by their declared lengths; ``convert`` gives each record what WARC
asks for and ARC lacks: an identifier, an ISO timestamp, a type, and digests of block and payload. Of records with equal payloads of at
least ``LEAST`` bytes, that with the largest key stays whole and the others become revisits of it. ``write_warc`` writes
WARC/1.1 files and ``read_warc`` reads them back by Content-Length.

Each record is a gzip member of its own, as WARC readers expect. Files are written by Spark's text writer, whose line end is the zero byte that
ends a member (the highest byte of its length), so any store that Spark writes to will do and lost executors leave nothing behind. A file
takes records until it has ``FILE_BYTES``. Payloads are bytes on the way: they are written as they are, whatever their encoding.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import map_arrow, written

LEAST, FILE_BYTES, ARC_BYTES, LEVEL = 1000, 64 << 20, 4 << 20, 3
#: Up to so many revisits are broadcast to their records, with a few hundred bytes each; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A gzip member holds less, so the highest byte of its length is zero; a longer record is several members.
MEMBER_BYTES = (1 << 24) - 1
#: Fixed field names of the two ARC versions.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
ARC_NAMES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_SCHEMA = "version string, url string, ip string, date string, type string, block binary, digest string, size bigint, key bigint"


@dataclass
class ArcRecord:
    version: str
    url: str
    ip: str
    date: str
    type: str
    block: bytes


def arc_header(version: str, url: str, ip: str, date: str, kind: str, length: int, status: int = 200, offset: int = 0, file: str = "-") -> bytes:
    """One header line; spaces in the URL are escaped, since fields are separated by them."""
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 256 else "%20", url) or "about:blank"
    kind = (kind or "no-type").split(";")[0].strip().replace(" ", "") or "no-type"
    fields = [url, ip, date, kind, str(length)] if version == "1" else [url, ip, date, kind, str(status), "-", "-", str(offset), file, str(length)]
    return (" ".join(fields) + "\n").encode()


def arc_file(version: str, name: str, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """A whole ARC file: its version block, then (url, ip, date, type, block) records."""
    about = f"{version} 0 trackloom\n{ARC_NAMES[version]}\n\n".encode()
    out = [arc_header("1", f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", len(about)) if version == "1" else arc_header("2", f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", len(about), file=name), about]
    for url, ip, date, kind, block in records:
        out += [arc_header(version, url, ip, date, kind, len(block), file=name), block, b"\n"]
    return b"".join(out)


def parse_header(line: bytes) -> dict[str, str]:
    """The fields of an ARC header line and its version, which the number of fields tells; ValueError if it is neither.

    A URL with spaces, which some old crawlers wrote, takes what is left of the fixed fields at the end.
    """
    fields = line.decode("utf-8", "surrogateescape").split(" ")
    for version in ("2", "1"):
        names = ARC_FIELDS[version]
        if len(fields) >= len(names):
            own = [" ".join(fields[: len(fields) - len(names) + 1]), *fields[len(fields) - len(names) + 1 :]]
            found = dict(zip(names, own, strict=True))
            if found["length"].isdigit() and re.fullmatch(r"\d{8,14}", found["date"]):
                return found | {"version": version}
    raise ValueError(f"not an ARC header line: {line[:200]!r}")


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, gzipped as a whole or by record; the version block comes first, as a filedesc record.

    Blank lines between records are skipped. A record that ends before its declared length raises ValueError.
    """
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        head = parse_header(raw[at:end].rstrip(b"\r"))
        size = int(head["length"])
        block = raw[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"{head['url']}: {len(block)} bytes of {size}")
        yield ArcRecord(head["version"], head["url"], head["ip"], head["date"], head["type"], block)
        at = end + 1 + size


def _parse_batches(key_header: str | None) -> Callable:
    """mapInArrow: (ARC file) -> ARC_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for records in _chunks(parse_arc(raw.as_py() or b""), lambda r: len(r.block)):
                    payloads = [payload_of(r.block) for r in records]
                    columns = [[getattr(r, f) for r in records] for f in ("version", "url", "ip", "date", "type", "block")]
                    columns += [[hashlib.sha1(p).hexdigest() for p in payloads], [len(p) for p in payloads], [_key(r.block, key_header) for r in records]]
                    kinds = [pa.string()] * 5 + [pa.binary(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ARC_SCHEMA.split(", ")])

    return run


def _key(block: bytes, header: str | None) -> int | None:
    found = http_header(block, header) if header else None
    return int(found) if found and re.fullmatch(r"-?[0-9]{1,19}", found) and -(1 << 63) <= int(found) < 1 << 63 else None


def _chunks(items: Iterator, size: Callable[[object], int], most: int = ARC_BYTES, rows: int = 256) -> Iterator[list]:
    """Lists of items of about ``most`` bytes together, and of at most so many rows."""
    held: list = []
    used = 0
    for item in items:
        held.append(item)
        used += size(item)
        if used >= most or len(held) == rows:
            yield held
            held, used = [], 0
    if held:
        yield held


def read_arc(spark: SparkSession, path: str, key_header: str | None = None) -> DataFrame:
    """ARC_SCHEMA rows of the ARC files at a path that Spark reads; each file is one task's.

    digest and size are those of the payload; key is an integer in the HTTP header of that name, null without it.
    """
    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), _parse_batches(key_header), ARC_SCHEMA)


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header; the whole block if it isn't an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return block
    ends = [(p + len(e)) for e in (b"\r\n\r\n", b"\n\n") if (p := block.find(e)) >= 0]
    return block[min(ends) :] if ends else b""


def http_header(block: bytes, name: str) -> str | None:
    head = block[: len(block) - len(payload_of(block))].decode("utf-8", "replace") if block.startswith(b"HTTP/") else ""
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$", head)
    return found[1] if found else None


def iso_date(date: str) -> str:
    """The ISO form of the 14 digits of an ARC date; shorter ones are filled with the earliest month, day and time."""
    digits = (date + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def base32_sha1(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record_id(*parts: object) -> str:
    """The same identifier for the same parts, so a task that runs again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def warc_type(url: str, block: bytes) -> tuple[str, str]:
    """WARC type and content type of an ARC record's URL and block."""
    if url.startswith("filedesc:"):
        return "warcinfo", "application/warc-fields"
    if block.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", "text/dns" if url.startswith("dns:") else "application/octet-stream"


def warc_record(kind: str, content: str, url: str, ip: str, date: str, identity: str, digest: str, block: bytes, refers_to: str | None = None, target: str | None = None, target_date: str | None = None) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identity}", f"WARC-Date: {iso_date(date)}"]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: {base32_sha1(digest)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}", f"WARC-Refers-To-Target-URI: {target}", f"WARC-Refers-To-Date: {iso_date(target_date)}"]
    lines += [f"WARC-Block-Digest: {base32_sha1(hashlib.sha1(block).hexdigest())}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def member(record: bytes, level: int = LEVEL) -> bytes:
    """The record as gzip members, without the zero byte at the end."""
    out = []
    for at in range(0, len(record), MEMBER_BYTES):
        part = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(part.compress(record[at : at + MEMBER_BYTES]) + part.flush())
    return b"".join(out)[:-1]


def _converted(file_bytes: int) -> Callable:
    """mapInArrow: (rid, key, url, ip, date, type, block, digest, first_rid, first_key, first_url, first_date) -> (file, record); record is gzipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, used = 0, 0
        for batch in batches:
            rows = (r for low in range(0, batch.num_rows, 64) for r in batch.slice(low, 64).to_pylist())
            for part in _chunks(rows, lambda r: len(r["block"] or b"")):
                files, out = [], []
                for r in part:
                    files.append(file)
                    out.append(member(_record(r) + b"\r\n\r\n"))
                    used += len(out[-1])
                    if used >= file_bytes:
                        file, used = file + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(out, pa.binary())], ["file", "record"])

    return run


def _record(r: dict) -> bytes:
    block, digest = r["block"] or b"", r["digest"]
    kind, content = warc_type(r["url"], block)
    identity = record_id("record", r["rid"], r["key"], r["url"], r["date"], digest)
    if kind == "warcinfo":
        block = f"software: trackloom\r\nformat: WARC File Format 1.1\r\nconverted-from: {r['url']}\r\n".encode()
    elif r["first_rid"] is not None:
        head = block[: len(block) - len(payload_of(block))] if kind == "response" else b""
        first = record_id("record", r["first_rid"], r["first_key"], r["first_url"], r["first_date"], digest)
        return warc_record("revisit", content, r["url"], r["ip"], r["date"], identity, digest, head, first, r["first_url"], r["first_date"])
    return warc_record(kind, content, r["url"], r["ip"], r["date"], identity, digest, block)


def convert(records: DataFrame, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, record): gzipped WARC records of ARC_SCHEMA rows, and the number of the file within its task that each goes to.

    The records are written once, with their digests; only digests, keys and URLs meet, and of these only the revisits return to their records.
    Records of equal payload and equal largest key are all whole; null keys are the smallest. An identifier counts the record's place in
    the written table, so repeated rows have records of their own.
    """
    records = written(records.withColumn("rid", F.monotonically_increasing_id()), "records", "zstd")
    facts = records.where((F.col("size") >= least) & ~F.col("url").startswith("filedesc:"))
    facts = facts.select("rid", "digest", F.coalesce("key", F.lit(-(1 << 63))).alias("order"), "key", "url", "date")
    firsts = facts.groupBy("digest").agg(F.max(F.struct("order", "rid", "key", "url", "date")).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1").select(F.col("digest").alias("of"), "first"), "firsts")
    later = facts.join(firsts, F.col("digest") == F.col("of")).where(F.col("order") < F.col("first.order"))
    later = written(later.select(F.col("rid").alias("own"), *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("rid", "key", "url", "date")]), "revisits")
    if later.count() <= BROADCAST_ROWS:
        later = F.broadcast(later)
    told = records.join(later, F.col("rid") == F.col("own"), "left")
    columns = ("rid", "key", "url", "ip", "date", "type", "block", "digest", "first_rid", "first_key", "first_url", "first_date")
    return map_arrow(told.select(*columns), _converted(file_bytes), "file int, record binary")


def write_warc(records: DataFrame, folder: str) -> str:
    """Writes the gzipped records as WARC files and returns the folder."""
    text = records.select("file", F.col("record").cast("string").alias("value"))
    text.write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(folder)
    return folder


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file that comes in pieces."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC file ends within a header")
                return
        lines = bytes(held[:end]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:100]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        while len(held) < end + 4 + size + 4:
            if not more():
                break
        if len(held) < end + 4 + size:
            raise ValueError(f"{fields.get('WARC-Record-ID')}: a block is shorter than its Content-Length")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]


def expanded(raw: bytes, step: int = 1 << 20, feed: int = 1 << 14) -> Iterator[bytes]:
    """The file's bytes in pieces, expanded if gzipped (one member or many)."""
    if raw[:2] != b"\x1f\x8b":
        for at in range(0, len(raw), step):
            yield raw[at : at + step]
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        part = zlib.decompressobj(31)
        while at < len(raw) and not part.eof:  # little at a time: what a member leaves is copied
            chunk = view[at : at + feed]
            out = part.decompress(chunk)
            at += len(chunk) - len(part.unused_data)
            yield out


WARC_SCHEMA = "type string, id string, url string, date string, refers_to string, digest string, headers map<string,string>, block binary"


def warc_digest(fields: dict[str, str]) -> str | None:
    return base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex() if "WARC-Payload-Digest" in fields else None


def checked(fields: dict[str, str], block: bytes) -> str | None:
    """The digest of the record's payload, counted from its block; that of the header for a revisit. ValueError if a digest isn't that of its header."""
    if base32_sha1(hashlib.sha1(block).hexdigest()) != fields.get("WARC-Block-Digest", ""):
        raise ValueError(f"{fields.get('WARC-Record-ID')}: the block doesn't have its digest")
    digest = warc_digest(fields)
    if digest is not None and fields["WARC-Type"] != "revisit" and hashlib.sha1(payload_of(block)).hexdigest() != digest:
        raise ValueError(f"{fields.get('WARC-Record-ID')}: the payload doesn't have its digest")
    return digest


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("type", "id", "url", "date", "refers_to", "digest", "headers", "block")
    kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.binary()]
    for batch in batches:
        for raw in batch.column(0):
            for found in _chunks(parse_warc(expanded(raw.as_py() or b"")), lambda x: len(x[1])):
                rows = [
                    (f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Target-URI"), f["WARC-Date"], f.get("WARC-Refers-To"), checked(f, block), list(f.items()), block)
                    for f, block in found
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """WARC_SCHEMA rows of all records of the WARC files at a path; digests are hexadecimal, and checked."""
    return map_arrow(_files(spark, folder), _read_batches, WARC_SCHEMA)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")


FACTS = "type string, id string, refers_to string, key bigint, size bigint, digest string"


def _facts(key_header: str) -> Callable:
    """mapInArrow: (WARC file) -> FACTS, counted from the blocks; size is that of the payload, null for a revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for raw in batch.column(0):
                for found in _chunks(parse_warc(expanded(raw.as_py() or b"")), lambda x: len(x[1])):
                    rows = [
                        (f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"), _key(block, key_header), None if f["WARC-Type"] == "revisit" else len(payload_of(block)), checked(f, block))
                        for f, block in found
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FACTS.split(", ")])

    return run


def _as_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) -> (arc): small ARC files of the pages, by turns of version 1 and 2."""
    n = 0
    for batch in batches:
        rows = (row for low in range(0, batch.num_rows, 64) for row in zip(*(c.to_pylist() for c in batch.slice(low, 64).columns), strict=True))
        for part in _chunks(rows, lambda row: len(row[2] or "")):
            records = []
            for page, url, html in part:
                payload = (html or "").encode("utf-8", "surrogatepass")
                key = "" if page is None else str(page)
                head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {key}\r\n\r\n"
                records.append((url or "about:blank", "0.0.0.0", "19960101000000", "text/html", head.encode() + payload))
            yield pa.RecordBatch.from_arrays([pa.array([arc_file("12"[n % 2], f"pages-{n}.arc", records)], pa.binary())], ["arc"])
            n += 1


def _page_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string"))


def pages_as_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(arc): pages as small legacy archives of a few megabytes, each page's id in an HTTP header.

    Null html is empty, a null URL is about:blank, a null id an empty header; further columns are ignored.
    """
    return map_arrow(_page_rows(pages, id_col, url_col, html_col), _as_arc, "arc binary")


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> str:
    """Pages -> ARC files -> ARC records -> WARC files; returns the folder. Odd pages are taken as ``pages_as_arc`` says; an empty table has no file."""

    def through_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parse_batches("X-Page-Id")(_as_arc(batches))

    records = map_arrow(_page_rows(pages, id_col, url_col, html_col), through_arc, ARC_SCHEMA)
    return write_warc(convert(records.where(~F.col("url").startswith("filedesc:")), least), folder)


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives, counted from the payloads as they were read.

    A revisit has the payload of the record it refers to; refers_to is the page_id of that record. Repeated and null page_ids have a row for each
    record. A record that is cut off or doesn't have its digest raises ValueError.
    """
    found = written(map_arrow(_files(spark, folder), _facts("X-Page-Id"), FACTS).where("type in ('response', 'revisit')"), "facts")
    whole = found.where("type = 'response'").select(F.col("key").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "id")
    again = found.where("type = 'revisit'").select(F.col("key").alias("own"), "refers_to").join(whole, F.col("refers_to") == F.col("id"), "left")
    again = again.select(F.col("own").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("page_id").alias("refers_to"))
    return whole.drop("id").withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(again)


#: The same facts in DuckDB, from the pages themselves.
PAGES_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 1000
"""
