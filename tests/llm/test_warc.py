from __future__ import annotations

import base64
import hashlib
import io
import re
import zipfile

import pytest

from furrow.llm import warc


def reader(data: bytes):
    return lambda n, at: data[at : at + n]


def brute(rows, least):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    count = {}
    for _, html in rows:
        count[html or ""] = count.get(html or "", 0) + 1
    out = []
    for page, html in rows:
        text = html or ""
        data = text.encode()
        refers = first.get(text) if count[text] > 1 and len(data) >= least else None
        refers = None if refers == page else refers
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert rows_of(warc.archive_pages(pages)) == brute([(r.page_id, r.html) for r in pages.collect()], 0)


@pytest.mark.parametrize("least", [0, 3])
def test_odd_rows(spark, least):
    rows = [(3, "u", "aa", 1), (1, None, "aa", 1), (2, "x\r\ny é", "", 1), (9, "u", None, 1), (None, "u", "aaa", 1), (4, "u", "aaa", 1)]
    rows += [(5, "u", "ab" * 400_000, 1), (6, "u", "ab" * 400_000, 1), (7, "u", "é ", 1), (7, "u", "é ", 1), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int").repartition(3)
    assert rows_of(warc.archive_pages(pages, min_revisit_bytes=least)) == brute([(r[0], r[2]) for r in rows], least)
    back = warc.archive_pages(pages).where("record_type = 'response'").select("page_id", "payload").collect()
    assert {(r[0], bytes(r[1])) for r in back} <= {(r[0], (r[2] or "").encode()) for r in rows}


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_directory_of_a_package_with_many_members_and_a_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(70_000):  # more than the 16-bit count holds: ZIP64 end records
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        z.writestr("last", b"payload")
        z.comment = b"note PK\x05\x06 in a comment"
    data = out.getvalue()
    found = warc.central_directory(len(data), reader(data))
    assert len(found) == 70_001
    at, size = warc.member_range(found, "last", reader(data))
    assert data[at : at + size] == b"payload"


def test_wide_sizes_come_from_the_extra_field():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z, z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as m:
        m.write(b"xyz")
    data = bytearray(out.getvalue())
    assert warc._wide(b"\x01\x00\x10\x00" + (5).to_bytes(8, "little") + (7).to_bytes(8, "little"), [warc.FULL32, 3, warc.FULL32]) == [5, 3, 7]
    found = warc.central_directory(len(data), reader(bytes(data)))
    at, size = warc.member_range(found, "a", reader(bytes(data)))
    assert bytes(data[at : at + size]) == b"xyz"
    with pytest.raises(ValueError):
        warc.central_directory(10, reader(b"not a zip."))


def test_a_compressed_member_is_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    data = out.getvalue()
    with pytest.raises(ValueError):
        warc.member_range(warc.central_directory(len(data), reader(data)), "a", reader(data))


def test_a_changed_payload_is_noticed():
    rec = warc.record_bytes(1, "u", b"payload", None)
    assert warc.parse_record(rec)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(rec.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.parse_record(rec[:-5])


def test_records_have_the_mandatory_fields():
    seen = set()
    for page, refers in ((1, None), (2, 1), (None, None), (1, None)):
        for payload in (b"", b"<html>\r\n\r\nWARC-Date: x</html>"):
            head, _, block = warc.record_bytes(page, "http://a/é b", payload, refers, "2025-05-01T00:00:00Z").partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            assert lines[0] == "WARC/1.1" and len(fields) == len(lines) - 1
            assert {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length", "Content-Type"} <= set(fields)
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and fields["WARC-Date"] == "2025-05-01T00:00:00Z"
            assert int(fields["Content-Length"]) == len(block) - 4 == (0 if refers else len(payload))
            assert fields["WARC-Target-URI"] == "http://a/%C3%A9%20b"
            seen.add((page, payload, fields["WARC-Record-ID"]))
            if refers:
                assert fields["WARC-Refers-To"] == warc.record_urn(refers, warc.digest_text(payload)) != fields["WARC-Record-ID"]
    assert len({urn for *_, urn in seen}) == len(seen) == 6
