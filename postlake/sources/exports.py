"""Reading finished exports back, for comparisons: archives of JSON lines and mail directories."""

from __future__ import annotations

import email
import email.policy
import io
import json
import os
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _tar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for member in t:
                    if member.isfile() and member.name.endswith(".jsonl"):
                        lines = t.extractfile(member).read().decode().splitlines()
                        rows += [(path, member.name, k, line) for k, line in enumerate(lines) if line.strip() and json.loads(line) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["path", "member", "line", "value"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, line, value) of archives of JSON lines, one task a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_tar_batches, "path string, member string, line bigint, value string")


def _kind(path: str) -> str:
    return {".eml": "eml", ".vcf": "vcard", ".ics": "icalendar", ".mbox": "mbox", ".msg": "msg"}.get(os.path.splitext(path)[1].lower(), "other")


def mail_fields(raw: bytes) -> tuple[str | None, str | None, str | None, str | None]:
    """(subject, from, date, message id) of one message."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    return tuple(str(m[k]) if m[k] is not None else None for k in ("subject", "from", "date", "message-id"))


def _mail_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kind = _kind(path)
            parts = [content]
            if kind == "mbox":
                parts = [re.sub(rb"(?m)^>(>*From )", rb"\1", p.partition(b"\n")[2]) for p in re.split(rb"(?m)^(?=From )", content) if p]
            for k, p in enumerate(parts):
                fields = mail_fields(p) if kind in ("eml", "mbox") else (None,) * 4
                rows.append((path, kind, k, *fields, p))
        if rows:
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "kind", "ordinal", "subject", "sender", "date", "message_id", "content"])


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """A row a message of .eml and .mbox files, and a row a file of the other kinds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_mail_batches, "path string, kind string, ordinal bigint, subject string, sender string, date string, message_id string, content binary")
