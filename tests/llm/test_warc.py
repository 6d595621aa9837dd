"""Archives: exact round trips, also with record marks in payloads and splits of a few bytes."""

import base64
import hashlib

import pytest

from postlens.llm import warc
from postlens.session import fresh_path

MARK = "WARC/1.0\r\n"
FAKE = MARK + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
HTML = [None, "", "<p>one</p>", "<p>one</p>", "\r\n\r\n", MARK, MARK * 3, "x" + FAKE + "y", FAKE, "café \U0001f600" * 50, "z" * 5000, "x" + FAKE + "y", None]


def pages(spark):
    rows = [(i, None if i % 3 == 0 else f"http://h/{i}\r\nX: 1", h, "own", "own") for i, h in enumerate(HTML)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, path string")


def expected(rows):
    first, out = {}, {}
    for key, html in sorted(rows):
        data = (html or "").encode()
        keep = first.setdefault(data, key)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[key] = (len(data), digest, "response" if keep == key else "revisit", None if keep == key else keep)
    return out


@pytest.mark.parametrize("split", ["128m", "64b", "700b"])
def test_round_trip(spark, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(spark, pages(spark).coalesce(2)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == expected(list(enumerate(HTML)))


def test_payloads_come_back_whole(spark):
    path = fresh_path(spark, "warc")
    warc.write_warc(pages(spark).where("page_id <> 3 and page_id <> 11"), path)
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, path).where("warc_type = 'response'").collect()}
    assert got["<urn:page:7>"] == HTML[7].encode() and got["<urn:page:6>"] == HTML[6].encode()
    assert "<urn:page:999>" not in got


def test_least_bytes_makes_small_ones_responses(spark):
    path = fresh_path(spark, "warc")
    warc.write_warc(pages(spark), path, least_bytes=20)
    kinds = {r["record_id"]: r["warc_type"] for r in warc.read_warc(spark, path).collect()}
    assert kinds["<urn:page:3>"] == "response" and kinds["<urn:page:11>"] == "revisit"


def test_empty_table(spark):
    assert warc.round_trip(spark, pages(spark).limit(0)).count() == 0


def test_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(None, "u", "a"), (5, "u", "a"), (5, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    got = warc.round_trip(spark, rows).collect()
    assert sorted((r["page_id"] is None, r["record_type"]) for r in got) == [(False, "response"), (False, "response"), (True, "response"), (True, "revisit")]


def test_every_record_has_the_mandatory_fields(spark):
    path = fresh_path(spark, "warc")
    warc.write_warc(pages(spark).where("page_id <> 7 and page_id <> 6"), path, date="2024-05-06T07:08:09Z")
    files = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    kinds = set()
    for file in files:
        data, at = bytes(file["content"]), 0
        while at < len(data):
            fields, skip, size = warc._head(data[at + len(warc.MAGIC):])
            assert data[at:].startswith(warc.MAGIC) and fields["warc-date"] == "2024-05-06T07:08:09Z"
            assert {"warc-type", "warc-record-id", "content-length"} <= fields.keys()
            assert fields.get("warc-profile") == (warc.PROFILE if fields["warc-type"] == "revisit" else None)
            kinds.add(fields["warc-type"])
            at += len(warc.MAGIC) + skip + size
            assert data[at:at + len(warc.END)] == warc.END
            at += len(warc.END)
    assert kinds == {"response", "revisit"}
