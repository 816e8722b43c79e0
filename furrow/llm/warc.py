"""WARC records in ZIP packages: writer, and a reader that never unpacks.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member per
record as is usual for WARC, and ``indexes/index.txt`` with one ``offset length``
line per record. The reader
parses the end record, the ZIP64 locator and end record, and the central
directory itself, finds the stored data of both members and reads byte ranges
of the package in place.

Of pages with the same payload the one with the smallest id is written as
``response`` with its payload; the others are ``revisit`` records that name it.
Payloads shorter than ``min_revisit_bytes`` are always written in full.

Null or empty html is a payload of 0 bytes. Rows that share the smallest id of
their payload are all responses. Null ids are kept and never referred to, unless
all pages of a payload have a null id: then all are responses. An empty table
gives no packages and no rows. Characters that a URI may not hold are percent-encoded
in the record and come back so. A page of any length is one record; columns beyond
``page_id, url, html`` are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from furrow.llm import files
from furrow.session import checkpointed, scratch_path, ship_package

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.txt"
PACKAGE_BYTES = 32 << 20  # a package is closed once it holds this much
RANGE_BYTES = 1 << 20  # neighbouring records are read together up to this much

# Fixed values of the ZIP format.
END_SIGNATURE = b"PK\x05\x06"
END64_LOCATOR_SIGNATURE = b"PK\x06\x07"
END64_SIGNATURE = b"PK\x06\x06"
CENTRAL_SIGNATURE = b"PK\x01\x02"
LOCAL_SIGNATURE = b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
MAX_COMMENT = 65535

RECORD_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
RANGE_SCHEMA = "package string, start bigint, lengths array<bigint>"


# --- records ---------------------------------------------------------------------------


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id, digest: str) -> str:
    """The id of a page's record: a name-based UUID of page id and payload digest.
    Only rows that agree in both share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:sha1:{digest}')}>"


def record_bytes(page_id, url, payload: bytes, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, whose block is empty. The
    page ids, which need not be unique or present, are fields of their own."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    digest = digest_text(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}")
    if revisit:
        head += [f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises where the block does not fit its headers."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    length = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("WARC record is cut short")
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and digest_text(block) != digest:
        raise ValueError("WARC payload does not match its digest")

    def page(name: str):
        return int(head[name]) if name in head else None

    return {
        "page_id": page("WARC-Page-ID"),
        "payload_bytes": int(head["WARC-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page("WARC-Refers-To-Page-ID"),
        "url": head.get("WARC-Target-URI"),
        "payload": block if kind == "response" else None,
    }


# --- packages --------------------------------------------------------------------------


def package_bytes(records: list[bytes]) -> bytes:
    out, index, at = io.BytesIO(), [], 0
    for rec in records:
        index.append(f"{at} {len(rec)}\n")
        at += len(rec)
    stamp = (1980, 1, 1, 0, 0, 0)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(DATA_MEMBER, stamp), "w", force_zip64=at > FULL32) as member:
            for rec in records:
                member.write(rec)
        z.writestr(zipfile.ZipInfo(INDEX_MEMBER, stamp), "".join(index))
    return out.getvalue()


def _wide(extra: bytes, fields: list[int]) -> list[int]:
    """Central directory fields, with the saturated ones taken from the ZIP64 extra field."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            wide = extra[at + 4 : at + 4 + size]
        at += 4 + size
    out, at = [], 0
    for value in fields:
        if value == FULL32:
            if at + 8 > len(wide):
                raise ValueError("ZIP64 field is missing")
            (value,) = struct.unpack_from("<Q", wide, at)
            at += 8
        out.append(value)
    return out


def central_directory(size: int, read_at) -> dict[str, tuple[int, int, int]]:
    """Member name -> (local header offset, stored size, method).

    ``read_at(length, offset)`` reads a range of a package of ``size`` bytes;
    only the tail and the directory are read.
    """
    tail_len = min(size, MAX_COMMENT + 22)
    tail = read_at(tail_len, size - tail_len)
    spot = tail.rfind(END_SIGNATURE)
    while spot >= 0 and spot + 22 + (struct.unpack_from("<H", tail, spot + 20)[0] if spot + 22 <= len(tail) else -1) != len(tail):
        spot = tail.rfind(END_SIGNATURE, 0, spot)
    if spot < 0:
        raise ValueError("not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, spot + 10)
    if FULL16 == count or FULL32 in (length, start):
        end_at = size - tail_len + spot
        locator = read_at(20, end_at - 20)
        if locator[:4] != END64_LOCATOR_SIGNATURE:
            raise ValueError("ZIP64 locator is missing")
        record = read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != END64_SIGNATURE:
            raise ValueError("ZIP64 end record is missing")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, found = read_at(length, start), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL_SIGNATURE:
            raise ValueError("ZIP directory is broken")
        (method,) = struct.unpack_from("<H", raw, at + 10)
        packed, plain = struct.unpack_from("<II", raw, at + 20)
        name_len, extra_len, note_len = struct.unpack_from("<HHH", raw, at + 28)
        (local,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + name_len].decode("utf-8", "replace")
        extra = raw[at + 46 + name_len : at + 46 + name_len + extra_len]
        plain, packed, local = _wide(extra, [plain, packed, local])
        found[name] = (local, packed, method)
        at += 46 + name_len + extra_len + note_len
    return found


def member_range(members: dict, name: str, read_at) -> tuple[int, int]:
    """Where the stored bytes of a member lie in the package."""
    local, size, method = members[name]
    if method != 0:
        raise ValueError(f"{name} is compressed; ranges need stored members")
    head = read_at(30, local)
    if head[:4] != LOCAL_SIGNATURE:
        raise ValueError("ZIP local header is broken")
    name_len, extra_len = struct.unpack_from("<HH", head, 26)
    return local + 30 + name_len + extra_len, size


def record_ranges(size: int, read_at) -> Iterator[tuple[int, list[int]]]:
    """(offset in the package, lengths of neighbouring records) for all records."""
    members = central_directory(size, read_at)
    base, _ = member_range(members, DATA_MEMBER, read_at)
    at, index_len = member_range(members, INDEX_MEMBER, read_at)
    start, lengths, held = base, [], 0
    for line in read_at(index_len, at).decode().splitlines():
        offset, length = map(int, line.split())
        if lengths and (held + length > RANGE_BYTES or base + offset != start + held):
            yield start, lengths
            lengths, held = [], 0
        if not lengths:
            start = base + offset
        lengths.append(length)
        held += length
    if lengths:
        yield start, lengths


# --- Spark jobs ------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: the record each page becomes.

    Only payloads seen more than once are joined, on their digest; their table
    has one row per repeated payload, and adaptive execution splits hot ones.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha1("payload")))
    firsts = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull())
        .select("_digest", "_first")
    )
    return rows.join(firsts, "_digest", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to")
    )


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write the records and return the manifest: ``package, records, bytes``."""
    ship_package(records.sparkSession)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")  # pages carry no date of their own

    def write(batches):
        name, k, held, total = files.attempt_name(), 0, [], 0

        def close():
            uri = files.write_bytes(folder, f"pages-{name}-{k:05d}.wacz", package_bytes(held))
            return pa.RecordBatch.from_pydict({"package": [uri], "records": [len(held)], "bytes": [total]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for i in range(batch.num_rows):
                rec = gzip.compress(record_bytes(*(c[i].as_py() for c in columns), date), 6, mtime=0)
                if held and total + len(rec) > PACKAGE_BYTES:
                    yield close()
                    k, held, total = k + 1, [], 0
                held.append(rec)
                total += len(rec)
        if held:
            yield close()

    manifest = records.mapInArrow(write, "package string, records bigint, bytes bigint")
    return checkpointed(manifest, records.sparkSession, "warc-manifest")


def locate_records(packages: DataFrame) -> DataFrame:
    """Byte ranges of all records of the packages, from directories and indexes alone."""
    ship_package(packages.sparkSession)

    def locate(batches):
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                with files.open_ranges(uri) as f:
                    found = list(record_ranges(f.size(), lambda n, at: f.read_at(n, at)))
                yield pa.RecordBatch.from_pydict(
                    {"package": [uri] * len(found), "start": [x[0] for x in found], "lengths": [x[1] for x in found]},
                    pa.schema([("package", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))]),
                )

    return packages.select("package").mapInArrow(locate, RANGE_SCHEMA)


def read_records(packages: DataFrame) -> DataFrame:
    """All records of the packages. Ranges are dealt out evenly, so one large
    package is read by many tasks."""
    ranges = locate_records(packages)
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())]
        + [("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    )

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_ranges(row["package"]) as f:
                    data = memoryview(f.read_at(sum(row["lengths"]), row["start"]))
                at, out = 0, []
                for n in row["lengths"]:
                    out.append(parse_record(gzip.decompress(data[at : at + n])))
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema)

    return ranges.repartition(parts, "package", "start").mapInArrow(read, RECORD_SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to packages and read all records back."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    return read_records(write_packages(with_revisits(pages, min_revisit_bytes), folder))
