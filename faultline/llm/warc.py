"""WARC archives through a chunked record table.

A page becomes one row per chunk of its payload: record identifier, chunk number, at most
``CHUNK_BYTES`` bytes. Each chunk row is written as a WARC record of its own, as the format
defines for segmented records: the first segment is the response, the others are
continuations that name its identifier. So no writer or reader holds more of a record than
one chunk, and Spark's text source writes and reads the archives in any store it reaches.

Of pages with equal payloads the one with the least id is the response; the others are
revisit records without a payload that refer to it.

Reading splits archives at the record boundary. A boundary holds a token of this archive
set, so payloads that hold archives themselves do not break it, and every segment's length
is checked against its header. Records of one segment are digested where they are read;
segments of longer ones are sorted by identifier and number, and a digest is carried along
from chunk to chunk without joining them.

Nulls: a null html is an empty payload, a null url an empty one. A page without an id is
never referred to; it revisits a page with an id and equal payload, if there is one. Ties
and repeated rows: all rows with the least id of a payload are responses. Payloads of less
than ``min_bytes`` are responses always. Empty tables give empty archives. Other columns
play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 64 * 1024
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1 digest: 160 bits as 32 signs of five bits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to for every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long"),
                             "_same": F.sha2("payload", 256)})
    # One row per payload that several rows share.
    shared = rows.filter(F.col("bytes") >= min_bytes).groupBy("_same").agg(
        F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 AND _first IS NOT NULL")
    joined = rows.join(shared.select("_same", "_first"), "_same", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("bytes") >= min_bytes)
    return joined.select(
        "page_id", "url", "payload", "digest", "bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"))


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table: a row per record and chunk number, from 1; an empty payload has one chunk."""
    last = F.greatest(F.ceil(F.col("bytes") / chunk_bytes), F.lit(1)).cast("int")
    last = F.when(F.col("record_type") == "revisit", F.lit(1)).otherwise(last)
    body = F.substring(F.col("payload"), (F.col("chunk") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    return rows.withColumn("chunks", last).withColumn("chunk", F.explode(F.sequence(F.lit(1), F.col("chunks")))).withColumn(
        "body", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(body)).drop("payload")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")))


def _line(name: str, value: Column) -> Column:
    """A header line, absent for null."""
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _uri(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES) -> str:
    """Write one WARC file per task, gzipped; the token of this set, which readers need."""
    token = uuid.uuid4().hex
    rows = chunked(records(pages, min_bytes), chunk_bytes)
    first = F.col("chunk") == 1
    own = record_id(F.col("page_id"))
    # Rows of one page with other payloads are told apart by the digest.
    origin = F.concat(own, F.lit(":"), F.col("digest"))
    many = F.col("chunks") > 1
    header = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Set: {token}\r\n"),
        _line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        _line("WARC-Record-ID", _uri(F.when(first, origin).otherwise(F.concat(origin, F.lit(":"), F.col("chunk").cast("string"))))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        # A line break in a url would end its header line.
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        F.coalesce(_line("WARC-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(F.when(F.col("record_type") == "revisit", F.concat(
            _line("WARC-Refers-To", _uri(F.concat(record_id(F.col("refers_to")), F.lit(":"), F.col("digest")))),
            _line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
            F.lit(f"WARC-Profile: {PROFILE}\r\n"))), F.lit("")),
        F.coalesce(F.when(many, F.concat(
            _line("WARC-Segment-Number", F.col("chunk").cast("string")),
            F.when(first, F.lit("")).otherwise(_line("WARC-Segment-Origin-ID", _uri(origin))))), F.lit("")),
        F.coalesce(F.when(many & (F.col("chunk") == F.col("chunks")), _line(
            "WARC-Segment-Total-Length", F.col("bytes").cast("string"))), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"))
    # The writer ends each row with a line feed, the last byte of the record's end.
    value = F.concat(header.cast("binary"), F.col("body"), F.lit(END[:-1]).cast("binary")).cast("string")
    rows.select(value.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return token


def read_archives(spark: SparkSession, path: str, token: str) -> DataFrame:
    """The chunk table of an archive set.

    record (identifier of the first segment), chunk, page_id, record_type, refers_to,
    digest (as stated), total (length of the whole, on the last chunk) and body.
    """
    boundary = f"{VERSION}\r\nWARC-Set: {token}\r\n"
    raw = spark.read.option("lineSep", END + boundary).text(path).select(F.col("value").cast("binary").alias("v"))
    # The first record of a file still has its boundary, the last one its end.
    n = len(boundary)
    at_start = F.substring("v", 1, n) == F.lit(boundary.encode())
    raw = raw.select(F.when(at_start, F.expr(f"substring(v, {n + 1})")).otherwise(F.col("v")).alias("v"))
    split = raw.withColumn("_at", F.expr("position(CAST('\\r\\n\\r\\n' AS BINARY), v)")).filter("_at > 0")
    head = split.select(
        F.concat(F.expr("substring(v, 1, _at - 1)").cast("string"), F.lit("\r\n")).alias("h"),
        F.expr("substring(v, _at + 4)").alias("b"))
    field = lambda name: F.nullif(F.regexp_extract("h", rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    rows = head.select(
        bare(F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID"))).alias("record"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("chunk"),
        field("WARC-Page-ID").cast("long").alias("page_id"), field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        field("WARC-Segment-Total-Length").cast("long").alias("total"),
        field("WARC-Segment-Number").isNotNull().alias("segmented"),
        field("Content-Length").cast("int").alias("_n"), "b")
    body = F.substring("b", F.lit(1), F.col("_n"))
    whole = F.octet_length("b") >= F.col("_n")
    broken = F.raise_error(F.concat(F.lit("archive record cut short: "), F.col("record")))
    return rows.withColumn("body", F.when(whole, body).otherwise(broken.cast("binary"))).drop("_n", "b")


class _Digest:
    """One record in the making: its digest and the copies of its first chunk."""

    def __init__(self, row: dict):
        self.row, self.copies, self.at, self.bytes, self.sha = row, 0, 0, 0, hashlib.sha1()

    def add(self, chunk: int, body: bytes) -> None:
        if chunk == 1:
            self.copies += 1
        # A repeated row repeats each of its chunks.
        if chunk == self.at:
            return
        if chunk != self.at + 1:
            raise ValueError(f"chunk {self.at + 1} of {self.row['record']} is missing")
        self.at = chunk
        self.bytes += len(body)
        self.sha.update(body)

    def done(self) -> list[dict]:
        digest = base64.b32encode(self.sha.digest()).decode()
        keys = ("page_id", "record_type", "refers_to")
        return [{k: self.row[k] for k in keys} | {"payload_bytes": self.bytes, "payload_digest": digest}] * self.copies


_RESULT = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _carried(batches):
    """Digest sorted chunks one by one; a record may span batches."""
    now = None
    for batch in batches:
        out = []
        small = batch.drop_columns(["body"]).to_pylist()
        for row, body in zip(small, batch.column("body"), strict=True):
            if now is None or now.row["record"] != row["record"]:
                out += now.done() if now else []
                now = _Digest(row)
            now.add(row["chunk"], body.as_py())
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
    if now:
        yield pa.RecordBatch.from_pylist(now.done(), schema=_ARROW)


def digests(spark: SparkSession, path: str, token: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records, from their bytes.

    A revisit has no payload of its own; its digest and length are those of the response
    that it names.
    """
    rows = read_archives(spark, path, token)
    single = rows.filter("NOT segmented AND record_type = 'response'").select(
        "page_id", "record_type", "refers_to", F.octet_length("body").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("body")).alias("payload_digest"))
    parts = rows.filter("segmented").select(
        "record", "chunk", "page_id", F.lit("response").alias("record_type"), "refers_to", "body")
    long = parts.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_carried, _RESULT)
    responses = single.unionByName(long)
    named = responses.filter("page_id IS NOT NULL").select(
        F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("digest")).distinct()
    revisits = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest").join(
        named, ["refers_to", "digest"]).withColumnRenamed("digest", "payload_digest")
    return responses.unionByName(revisits)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS f, unhex(sha1(h)) AS s FROM p),
b AS (SELECT *, CAST(s AS BIT)::VARCHAR AS bits FROM d)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(range(0, 32),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || bits[5 * k + 1:5 * k + 5])::INT AS INT), 1)), '') AS payload_digest,
  CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f < page_id THEN f END AS refers_to
FROM b
"""
