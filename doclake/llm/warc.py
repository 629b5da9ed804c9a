"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds each distinct payload once, under its SHA-256 digest, which is checked again on
reading. ``headers`` holds, for each record, the exact bytes that stand before its payload: the WARC header and the HTTP
header. Joined on the digest they give back the original records, byte for byte; a revisit has no payload of its own.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page id is the response, others
revisit it; records with smaller payloads are all responses. Rows that repeat a page id with an equal payload are all
written alike. A NULL html is an empty payload; a NULL url leaves the target header out; blanks and control characters of
a url are written as %XX. A row without a page id is a response where no row with an id has the same payload, and comes
back without an id. An empty table gives an archive without records; further columns are ignored.

Payload bytes cross the network twice: to meet their equals when written, and to meet their header when read. Partial
aggregation keeps one copy per task of a payload that a third of all rows share, and its many revisits carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm.common import stored

# The base32 alphabet, lines of the two headers.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are eight groups of 20, each of four letters."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [
            F.substring(F.lit(BASE32), F.shiftright(value, 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
            for k in (3, 2, 1, 0)
        ]
    return F.concat(*letters)


def _uri(url: Column) -> Column:
    """A url on one line: every blank, control or delete character as %XX."""
    parts = F.transform(
        F.filter(F.split(url, ""), lambda c: c != ""),
        lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c),
    )
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(parts, "")).otherwise(url)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _lines(*lines: Column) -> Column:
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def write_archive(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0
) -> None:
    """Write ``df`` as an archive below ``path``."""
    pages = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha256", F.sha2("payload", 256))
    pages.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    narrow = stored(
        pages.select(
            "page_id",
            "url",
            "sha256",
            F.octet_length("payload").cast("long").alias("n_bytes"),
            sha1_base32(F.col("payload")).alias("sha1"),
        ),
        "warc-digests",
    )
    # Only payloads that more than one record has can have revisits.
    owners = (
        narrow.where(F.col("n_bytes") >= min_bytes)
        .groupBy("sha256")
        .agg(F.min("page_id").alias("owner"), F.count("*").alias("n"))
        .where("n > 1 and owner is not null")
        .drop("n")
    )
    placed = narrow.join(owners, "sha256", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    http = _lines(
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        _field("Content-Length", F.col("n_bytes").cast("string")),
    )
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    header = _lines(
        F.lit(VERSION),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        _field("WARC-Target-URI", _uri(F.col("url"))),
        F.when(revisit, _field("WARC-Refers-To", _record_id(F.col("owner")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        _field("Content-Length", length.cast("string")),
    )
    headers = placed.select(
        "sha256", revisit.alias("is_revisit"), F.encode(F.concat(header, http), "UTF-8").alias("header")
    )
    headers.write.parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records of an archive: is_revisit, record (bytes)."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    # A payload that does not have the digest it is stored under stops the job.
    checked = payloads.select(
        "sha256",
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary"))
        .alias("payload"),
    )
    end = F.lit(bytearray(END))
    whole = headers.where("not is_revisit").join(checked, "sha256", "left")
    responses = whole.select("is_revisit", F.concat("header", "payload", end).alias("record"))
    revisits = headers.where("is_revisit").select("is_revisit", F.concat("header", end).alias("record"))
    return responses.unionByName(revisits)


_PARSED = "page_id long, url string, record_type string, refers_to long, sha1 string, n_bytes long, payload binary"


def parse_record(record: bytes) -> dict:
    """Fields of one record; wrong lengths or a payload that fails its digest are errors."""
    head, _, rest = record.partition(END)
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first!r}")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != END:
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(END)
    said = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    sha1 = fields["warc-payload-digest"].removeprefix("sha1:")

    def page(value: str | None) -> int | None:
        text = (value or "none").removeprefix("<urn:x-page:").removesuffix(">")
        return None if text == "none" else int(text)

    if fields["warc-type"] == "response":
        if len(payload) != said or base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha1:
            raise ValueError("a payload does not have its digest")
    return {
        "page_id": page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": page(fields.get("warc-refers-to")),
        "sha1": sha1,
        "n_bytes": said,
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(n, kinds[k]) for n, k in (part.split(" ") for part in _PARSED.split(", "))])
    for batch in batches:
        rows = [parse_record(r) for r in batch.column("record").to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=fields)


def parse_records(records: DataFrame) -> DataFrame:
    """Records as columns, with the payload of responses."""
    return records.select("record").mapInArrow(_parse, _PARSED)


def page_records(df: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``df`` (page_id, url, html) to an archive and read it back: one row per record."""
    write_archive(df, path, min_bytes=min_bytes)
    parsed = stored(parse_records(read_records(df.sparkSession, path)).drop("payload"), "warc-records")
    # What a revisit says of its payload must be what the response it refers to was found to hold.
    found = parsed.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"), F.col("sha1"), F.col("n_bytes").alias("held")
    )
    revisits = parsed.where("record_type = 'revisit'").join(found.distinct(), ["refers_to", "sha1"], "left")
    proven = revisits.withColumn(
        "n_bytes",
        F.when(F.col("held").eqNullSafe(F.col("n_bytes")), F.col("held")).otherwise(
            F.raise_error(F.lit("a revisit refers to another payload")).cast("long")
        ),
    ).drop("held")
    every = parsed.where("record_type = 'response'").unionByName(proven)
    return every.select(
        "page_id",
        F.col("n_bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
