"""op4: round trip, digests, rules for revisits."""

import base64
import hashlib

import pytest
from compare import assert_same, connection
from llm.cases import clashing

from tessera.llm.op4_query import ORACLES, op4_warc
from tessera.llm.warc_store import read_catalog, restore_records, write_archive

ROWS = [(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, None, "other é"), (None, "http://n/", None), (4, "http://x/\r\ny", ""), (None, None, "same"), (5, "u", "z" * 100_000), (6, "http://a/\u2028WARC-Page-ID: 77\x85WARC-Type: x\u2029\x0b \r\nWARC-Page-ID: 78", "sep")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_catalog(spark, pages):
    rows = read_catalog(spark, write_archive(pages)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows), key=str) == sorted(((i, len((h or "").encode()), digest(h)) for i, _, h in ROWS), key=str)
    same = [r for r in rows if r["payload_digest"] == digest("same")]
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in same) == [("1", "revisit", 2), ("2", "response", None), ("2", "revisit", 2), ("None", "revisit", 2)]
    empty = [r for r in rows if r["payload_bytes"] == 0]
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in empty) == [("4", "response", None), ("None", "revisit", 4)]


def test_separators_in_a_url(spark, pages):
    record = next(bytes(r["record"]).decode() for r in restore_records(spark, write_archive(pages)).collect() if r["page_id"] == 6)
    assert "WARC-Target-URI: http://a/%E2%80%A8WARC-Page-ID:%2077%C2%85WARC-Type:%20x%E2%80%A9%0B%20%0D%0AWARC-Page-ID:%2078\r\n" in record


def test_small_payloads_are_all_responses(spark, pages):
    rows = read_catalog(spark, write_archive(pages, min_bytes=5)).collect()
    assert all(r["record_type"] == "response" for r in rows)


def test_records_are_well_formed(spark, pages):
    records = restore_records(spark, write_archive(pages)).collect()
    assert len(records) == len(ROWS)
    ids = set()
    for r in records:
        raw = bytes(r["record"])
        head, rest = raw.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1" and rest.endswith(b"\r\n\r\n")
        block = rest[:-4]
        assert int(fields["Content-Length"]) == len(block)
        http, body = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK")
        assert body == (bytes(r["payload"]) if fields["WARC-Type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha1:" + digest(bytes(r["payload"]).decode())
        ids.add(fields["WARC-Record-ID"])
    assert len(ids) == len(ROWS)


def test_payloads_are_stored_once(spark, pages):
    archive = write_archive(pages)
    assert spark.read.parquet(archive.payloads).count() == len({h or "" for _, _, h in ROWS})


def test_damage_is_noticed(spark, pages):
    archive = write_archive(pages)
    from pyspark.sql import functions as F

    broken = spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.lit(b"!")))
    broken.write.parquet(archive.payloads + "-broken")
    with pytest.raises(Exception, match="digest"):
        read_catalog(spark, type(archive)(archive.headers, archive.payloads + "-broken")).collect()


def test_empty_and_clashing(spark, pages):
    assert read_catalog(spark, write_archive(pages.limit(0))).count() == 0
    assert read_catalog(spark, write_archive(clashing(pages.withColumnRenamed("url", "doc_id"), ["key", "payload", "seq", "digest", "n", "id", "header", "response", "record_type"]).withColumnRenamed("doc_id", "url"))).count() == len(ROWS)


def test_query(spark, sf_dir):
    assert_same(op4_warc(spark, sf_dir), connection(sf_dir), ORACLES["op4_warc"])
