"""The archive against records written by hand, and round trips."""

import base64
import hashlib

import pytest

from doclake.llm.common import shared_dir
from doclake.llm.warc import page_records, parse_record, parse_records, read_records, write_archive

SCHEMA = "page_id long, url string, html string, sha256 string"


def brute(rows, min_bytes):
    out = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        mates = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        owner = min(mates, default=page)
        again = len(payload) >= min_bytes and owner is not None and page != owner
        out.append((page, len(payload), digest, "revisit" if again else "response", owner if again else None))
    return out


@pytest.fixture(scope="module")
def rows():
    pages = ["<p>a</p>", "", None, "<p>é 😀</p>", "\r\n\r\n", "x" * 50000, "<b>b"]
    made = [(100 - i, f"http://h/{i} \r\nX: y", pages[i % 7], "c") for i in range(40)]
    made += [(1000 + i, None, "<hot>", "c") for i in range(200)]
    return made + [(3, "u", "twice", "c"), (3, "u", "twice", "c"), (None, "u", "alone", "c"), (None, "u", "<b>b", "c")]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_records_match_brute_force(spark, rows, min_bytes):
    got = page_records(spark.createDataFrame(rows, SCHEMA), shared_dir(spark, "warc"), min_bytes)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, min_bytes), key=key)


def test_records_come_back_byte_for_byte(spark, rows):
    path = shared_dir(spark, "warc")
    write_archive(spark.createDataFrame(rows, SCHEMA), path)
    payloads = spark.read.parquet(f"{path}/payloads")
    assert payloads.count() == len({r[2] or "" for r in rows})
    parsed = parse_records(read_records(spark, path)).collect()
    have = {r.page_id: r for r in parsed if r.record_type == "response" and r.page_id is not None}
    for page, url, html, _ in rows:
        if page in have:
            assert bytes(have[page].payload).decode() == (html or "")
            assert have[page].url == (None if url is None else url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"))


def test_a_spoilt_record_is_an_error():
    good = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:4>\r\nWARC-Payload-Digest: sha1:"
            + base64.b32encode(hashlib.sha1(b"hi").digest())
            + b"\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    assert parse_record(good)["payload"] == b"hi"
    with pytest.raises(ValueError):
        parse_record(good.replace(b"\r\n\r\nhi", b"\r\n\r\nho"))


def test_empty_table(spark):
    assert page_records(spark.createDataFrame([], SCHEMA), shared_dir(spark, "warc")).count() == 0
