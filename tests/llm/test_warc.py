import gzip
import hashlib

from pyspark.sql import functions as F

from postlake.llm.warc import archive, read_warc, records_of_pages, restore, round_trip, split_records

SCHEMA = "record_id bigint, warc_header binary, http_header binary, payload binary, digest string, length string, x int"


def test_archive_keeps_a_payload_once_and_every_header(spark):
    big = bytes(range(256)) * 20000
    declared = lambda p: b"WARC/1.0\r\nwarc-payload-digest: SHA256:" + hashlib.sha256(p).hexdigest().encode() + b"\r\n\r\n"
    rows = [(1, b"h1\r\n\r\n", b"x", b"same"), (2, b"h2\xff\r\n\r\n", b"", b"same"), (3, None, None, b""), (4, b"only", b"", None), (4, b"only", b"", None), (None, b"n", b"", b"same"), (5, declared(big), b"", big), (6, declared(b"other"), b"", b"same")]
    df = spark.createDataFrame([(*x, "d", "l", 0) for x in rows], SCHEMA)
    kept = archive(df)
    store = {r.digest: (bytes(r.payload), r.copies, r.sound) for r in kept.payloads.collect()}
    assert store == {hashlib.sha256(p).hexdigest(): (p, n, True) for p, n in ((b"same", 4), (b"", 1), (big, 1))}
    got = sorted(((r.record_id or 0, bytes(r.record), r.verified) for r in restore(kept).collect()))
    assert got == sorted((i or 0, (w or b"") + (h or b"") + (p or b""), i != 6) for i, w, h, p in rows)
    assert restore(archive(spark.createDataFrame([], SCHEMA))).collect() == []


def test_damage_is_seen(spark):
    kept = archive(spark.createDataFrame([(1, b"h", b"", b"payload", "", "", 0)], SCHEMA))
    worse = kept._replace(payloads=kept.payloads.withColumn("payload", F.lit(b"changed")))
    gone = kept._replace(payloads=kept.payloads.where("false"))
    assert [r.verified for r in restore(worse).collect()] == [r.verified for r in restore(gone).collect()] == [False]


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é\r\n\r\nx</p>", "r"), (2, None, None, "r"), (3, "http://b", "", "r"), (1, "http://a", "<p>é\r\n\r\nx</p>", "r"), (None, "u", "v", "r")], "page_id bigint, url string, html string, record string")
    whole = sorted(bytes(r.record) for r in records_of_pages(pages).collect())
    back = round_trip(pages).collect()
    assert sorted(r.record.encode() for r in back) == whole and all(r.verified for r in back)
    parts = split_records(spark.createDataFrame([(1, b"no empty line"), (2, b"one\r\n\r\nrest"), (3, b""), (4, None)], "record_id bigint, record binary")).orderBy("record_id").collect()
    assert [tuple(x if x is None else bytes(x) for x in r[1:]) for r in parts] == [(b"no empty line", b"", b""), (b"one\r\n\r\n", b"rest", b""), (b"", b"", b""), (None, None, None)]


def test_files(spark, tmp_path):
    records = [b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s" % (len(p), p) for p in (b"abc", b"", b"x\r\n\r\ny")]
    whole = b"\r\n\r\n".join(records) + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    got = read_warc(spark, str(tmp_path)).collect()
    for name in ("a.warc", "b.warc.gz"):
        assert [bytes(r.record) for r in sorted(got, key=lambda r: r.record_id) if r.path.endswith(name)] == records
