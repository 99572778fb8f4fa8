"""Operator 1, WARC as a content-addressed archive.

A record is its WARC header block, a protocol (HTTP) header block and a payload. ``archive`` keeps
each distinct payload's bytes once, under the SHA-256 of these bytes, and every record's two header
blocks byte for byte with that digest. ``restore`` joins them into the records that went in.

Digests are verified three times: the archive compares each record's declared payload digest, if
its header has one of the form sha256:<hex>, with that of the bytes; it compares a second,
independent hash and the length of all payloads under one digest, so a collision or a fault is seen;
and ``restore`` recomputes the digest of the bytes that it joins.

A payload is shuffled once, by digest; the join then brings the small header rows to it.

Defined results: a null payload has no digest and no stored bytes, its record is restored as its
headers alone; an empty payload is stored like any other; null headers count as empty; records with
equal record_id are kept each; an empty table gives empty tables; further columns are ignored.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import only

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"


class Archive(NamedTuple):
    #: record_id, warc_header, http_header, digest, declared (null: the header declares none)
    headers: DataFrame
    #: digest, payload, length, copies, sound
    payloads: DataFrame


def records_of_pages(pages: DataFrame) -> DataFrame:
    """(record_id, record): a response record for each page; the payload is its HTML."""
    p = only(pages, page_id="page_id", url="url", html="html")
    body = F.coalesce("html", F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(body) + len(HTTP)).cast("string"), F.lit(CRLF + CRLF),
    )
    return p.select(F.col("page_id").cast("bigint").alias("record_id"), F.concat(head.cast("binary"), F.lit(HTTP).cast("binary"), body).alias("record"))


def split_records(records: DataFrame) -> DataFrame:
    """(record_id, warc_header, http_header, payload) of whole records, each block with the empty
    line that ends it. Latin-1 maps bytes to characters one to one, so nothing is changed; a record
    without an empty line is all WARC header, one with a single empty line has no payload."""
    r = only(records, record_id="record_id", record="record")
    whole = F.decode("record", "ISO-8859-1")
    r = r.select("record_id", "record", F.locate(CRLF * 2, whole).alias("a"), whole.alias("s"))
    r = r.withColumn("a", F.when(F.col("a") > 0, F.col("a") + 3).otherwise(F.length("s")))
    r = r.withColumn("b", F.expr(f"locate('{CRLF * 2}', s, a + 1)"))
    r = r.withColumn("b", F.when(F.col("b") > 0, F.col("b") + 3).otherwise(F.octet_length("record")))
    part = lambda x, n: F.substring(F.col("record"), x, n)
    return r.select("record_id", part(F.lit(1), F.col("a")).alias("warc_header"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("http_header"), part(F.col("b") + 1, F.octet_length("record") - F.col("b")).alias("payload"))


def archive(records: DataFrame) -> Archive:
    """records: record_id, warc_header, http_header, payload (binary)."""
    r = only(records, record_id="record_id", warc_header="warc_header", http_header="http_header", payload="payload")
    r = r.withColumn("digest", F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)))
    said = F.lower(F.regexp_extract(F.decode("warc_header", "ISO-8859-1"), r"(?im)^WARC-Payload-Digest:[ \t]*sha256:([0-9a-f]{64})[ \t]*\r?$", 1))
    empty = F.lit(b"")
    headers = r.select("record_id", F.coalesce("warc_header", empty).alias("warc_header"), F.coalesce("http_header", empty).alias("http_header"), "digest", F.when(F.length(said) > 0, said == F.col("digest")).alias("declared"))
    stored = r.where("payload is not null").select("digest", "payload", F.xxhash64("payload").alias("x"), F.octet_length("payload").cast("bigint").alias("length"))
    payloads = stored.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.max("length").alias("length"), F.count("*").alias("copies"), ((F.min("x") == F.max("x")) & (F.min("length") == F.max("length"))).alias("sound")
    )
    return Archive(headers, payloads)


def restore(kept: Archive) -> DataFrame:
    """(record_id, digest, length, record, verified) of every record of an archive."""
    p = kept.payloads.select(F.col("digest").alias("d"), "payload", "length", "sound")
    j = kept.headers.join(p, F.col("digest") == F.col("d"), "left")
    sound = F.when(F.col("digest").isNull(), True).otherwise(F.coalesce(F.col("sound") & (F.sha2("payload", 256) == F.col("digest")), F.lit(False)))
    return j.select("record_id", "digest", "length", F.concat("warc_header", "http_header", F.coalesce("payload", F.lit(b""))).alias("record"), (sound & F.coalesce("declared", F.lit(True))).alias("verified"))


def _file_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            at, rows = 0, []
            while at < len(data):
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", data[at:end])
                stop = end + 4 + int(length[1] if length else 0)
                rows.append((path, len(rows), data[at:stop]))
                at = stop + 4 if data[stop : stop + 4] == b"\r\n\r\n" else stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["path", "record_id", "record"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_id, record) of WARC files, plain or gzipped, one task a file; record_id counts
    from 0 in each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(_file_batches, "path string, record_id bigint, record binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, digest, length, record, verified): pages as records, archived and restored."""
    back = restore(archive(split_records(records_of_pages(pages))))
    return back.select(F.col("record_id").alias("page_id"), "digest", "length", F.decode("record", "UTF-8").alias("record"), "verified")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)
SELECT page_id, sha256(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS length,
       'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || url || e || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR)
       || '>' || e || 'WARC-Payload-Digest: sha256:' || sha256(html) || e || 'Content-Type: application/http; msgtype=response' || e || 'Content-Length: '
       || CAST(octet_length(encode(html)) + octet_length(encode(http)) AS VARCHAR) || e || e || http || html AS record, TRUE AS verified
FROM p, (SELECT chr(13) || chr(10) AS e, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) AS http)
"""
