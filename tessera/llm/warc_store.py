"""Content-addressed web archive: payload bytes once, exact record headers apart, records restored by joins.

An archive is two Parquet tables in shared storage, the payloads bucketed by key so that restoring moves headers only. ``payloads`` has one row
for each distinct payload under its SHA-256, which is checked again whenever
the payload is read. ``headers`` has one row for each record: the exact bytes
of its WARC and HTTP headers and the key of its payload. Of records with equal
payloads one is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch, dealt_anew, shared_path, stage

#: Alphabet of RFC 4648 (a fixed value of that format).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
UNSAFE = r"[\x00-\x20\x7F-\u00A0\u2028\u2029]"


@dataclass(frozen=True)
class Archive:
    """Paths of the two tables; ``bucketed`` is the name under which the session that wrote the payloads knows their buckets."""

    headers: str
    payloads: str
    bucketed: str = ""


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: each 5 hex digits are 4 characters."""
    digest = F.sha1(data)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letters = F.transform(
        numbers, lambda n: F.concat(*(F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))
    )
    return F.array_join(letters, "")


def record_id(key: Column, seq: Column) -> Column:
    h = F.md5(F.concat_ws(":", key, seq.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def _header(date: str) -> Column:
    """Exact header text of a record from its columns; lines end in CR LF, controls and separators in a URL are escaped."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("n")).otherwise(F.lit(0))
    # what would end or split a line for any reader: C0 and C1 controls, space, DEL, U+2028 and U+2029
    url = F.array_join(
        F.transform(
            F.regexp_extract_all("url", F.lit(UNSAFE + "+|[^" + UNSAFE[1:] + "+"), F.lit(0)),
            lambda s: F.when(s.rlike("^" + UNSAFE), F.regexp_replace(F.hex(F.encode(s, "UTF-8")), "(..)", "%$1")).otherwise(s),
        ),
        "",
    )
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.col("id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.col("response_id"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *fields), F.lit(END), http)  # concat_ws leaves null fields out


def write_archive(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write a record for each row of ``pages`` (page_id, url, html) and return where.

    A null html is an empty payload. Of the records of a payload of at least
    ``min_bytes`` bytes the one of greatest page_id is the response (null ids
    are least; of repeated rows one is taken); below that size all are
    responses. Long payloads are stored whole, an empty table makes an empty
    archive, further columns are not part of an archive whatever their names.
    Rows are numbered once, when the list of records is written.
    """
    spark = pages.sparkSession
    body = pages.select("page_id", "url", payload_of(F.col("html")).alias("payload")).withColumn("key", F.sha2("payload", 256))
    scratch = Scratch(spark)
    records = scratch.stage(
        body.select(
            "page_id", "url", "key", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n"),
            F.monotonically_increasing_id().alias("seq"),
        ),
        "records",
    )
    # one row a payload and task after the partial step: a payload of very many copies does not travel with them
    stored = shared_path(spark, "payloads")
    archive = Archive(shared_path(spark, "headers"), stored, "payloads_" + stored.rsplit("-", 1)[1])
    once = body.groupBy("key").agg(F.first("payload").alias("payload"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", stored).saveAsTable(archive.bucketed)
    responses = records.groupBy("key").agg(F.max(F.struct("page_id", "seq")).alias("response"))
    marked = (
        records.join(dealt_anew(responses, "response", "key"), "key")
        .withColumn("record_type", F.when((F.col("n") < min_bytes) | (F.col("seq") == F.col("response.seq")), "response").otherwise("revisit"))
        .withColumn("id", record_id(F.col("key"), F.col("seq")))
        .withColumn("response_id", record_id(F.col("key"), F.col("response.seq")))
    )
    marked.select("key", _header(date).alias("header")).write.parquet(archive.headers)
    scratch.clear()
    return archive


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """The header table with the fields parsed from the header bytes: lines end in CR LF alone, a field is what follows its name there."""
    lines = F.split("header", "\r\n")

    def field(name: str) -> Column:
        found = F.get(F.filter(lines, lambda line: line.startswith(f"{name}: ")), F.lit(0))
        return F.substring(found, F.lit(len(name) + 3), F.char_length(found))

    return spark.read.parquet(archive.headers).select(
        "key",
        "header",
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("id"),
        F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("digest"),
        field("WARC-Refers-To").alias("refers_id"),
    )


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """(key, payload) with every payload checked against its key; a mismatch raises an error."""
    known = archive.bucketed and spark.catalog.tableExists(archive.bucketed)
    stored = spark.table(archive.bucketed) if known else spark.read.parquet(archive.payloads)
    checked = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not have the digest "), F.col("key"))).cast("binary")
    )
    return stored.select("key", checked.alias("payload"))


def restore_records(spark: SparkSession, archive: Archive, kind: str | None = None) -> DataFrame:
    """(page_id, id, refers_id, digest, record_type, header, payload, record) of all records or those of one type: the original bytes and the full payload."""
    headers = read_headers(spark, archive)
    if kind:
        headers = headers.where(F.col("record_type") == kind)
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers.join(read_payloads(spark, archive), "key").select(
        "page_id", "id", "refers_id", "digest", "record_type", "header", "payload",
        F.concat(F.col("header").cast("binary"), block, F.lit(END.encode())).alias("record"),
    )


def _agreed(digest: Column, other: Column) -> Column:
    return F.when(digest == other, digest).otherwise(F.raise_error(F.concat(F.lit("header and payload differ in record "), F.col("id"))).cast("string"))


def read_catalog(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the restored records.

    Size and digest are taken from the bytes between header and end mark of each
    restored response, and must agree with the header. A revisit is looked up by
    the record id it names; refers_to is the page id there.
    """
    head = F.octet_length("header")
    body = F.substring("record", head + 1, F.octet_length("record") - head - len(END))
    restored = restore_records(spark, archive, "response")
    read = restored.select("page_id", "id", F.octet_length(body).cast("long").alias("payload_bytes"), _agreed(F.col("digest"), base32_sha1(body)).alias("payload_digest"))
    responses = stage(read, "responses")
    first = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    # both are tables, so the revisits of one response can be split
    named = responses.select(F.col("id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = read_headers(spark, archive).where("record_type = 'revisit'").join(named, "refers_id")
    agreed = _agreed(F.col("digest"), F.col("payload_digest")).alias("payload_digest")
    return first.union(revisits.select("page_id", "payload_bytes", agreed, "record_type", "refers_to"))
