import base64
import email.header
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from postlake.functions import mailcode as mc
from postlake.operators import families, sinks


def test_words_and_names():
    for text in ("plain", "é" * 100, "日本語 subject", ""):
        got = mc.unstructured(text)
        assert got.isascii() and "".join(s.decode(c or "ascii") if isinstance(s, bytes) else s for s, c in email.header.decode_header(got)) == text
        assert all(len(base64.b64decode(w[10:-2])) <= 45 for w in got.split() if w.startswith("=?"))
    assert mc.unstructured("a\nb") == "" and mc.unstructured(None) == ""
    assert [mc.display_name(x) for x in ("Ann B.", 'A "x", B', "É")] == ["Ann B.", '"A \\"x\\", B"', "=?UTF-8?B?w4k=?="]
    assert mc.parameter("name", "a.txt") == 'name="a.txt"' and mc.parameter("name", "é.txt") == "name=\"_.txt\"; name*=UTF-8''%C3%A9.txt"
    long = mc.parameter("name", "é" * 30)
    assert "name*0*=UTF-8''%C3" in long and "; name*1*=%C3" in long and "name*2*=" in long and "name*3*=" not in long


@pytest.mark.parametrize(
    "text,failure",
    [("", "empty"), ("A: b\nC: d", "bare_line_feed"), ("A: b\rC", "bare_carriage_return"), ("\r\nA: b", "leading_blank_line"), (" x\r\nA: b", "orphan_continuation"), ("nothing", "missing_colon"), ("A b: c", "invalid_field_name"), ("A: \x01", "control_character"), ("A: b\r\n c", None), ("A: b\r\n\r\nbody", None)],
)
def test_header_validation(text, failure):
    got = mc.validated_headers(text)
    assert got[1] == failure and (got[0] is None) == (failure is not None) and got[2] == text.endswith("body")


def test_header_filter():
    assert mc.kept_header_lines("A: 1\nContent-Type: x\n more\nB: 2") == "A: 1\nB: 2"


def test_rtf():
    def pack(body, size, magic=0x75465A4C, crc=None):
        return struct.pack("<4I", len(body) + 12, size, magic, zlib.crc32(body) if crc is None else crc) + body

    # literals, then a reference to the first of them, which lies right behind the start dictionary
    at = len(mc._RTF_START)
    body = bytes([0b1000]) + b"abc" + bytes([at >> 4, (at & 15) << 4 | 1])
    assert mc.rtf(pack(body, 6)) == b"abcabc" and mc.rtf(pack(body, 5)) == b"abcab" and mc.rtf(pack(body, 99)) is None and mc.rtf(pack(body, 6, crc=1)) is None
    raw = b"{\\rtf1}"
    assert mc.rtf(struct.pack("<4I", len(raw) + 12, len(raw) + 12, 0x414C454D, 0) + raw) == raw
    assert mc.rtf(None) is None and mc.rtf(b"short") is None and mc.rtf(bytes(20)) is None
    html = b"{\\rtf1\\ansi\\fromhtml1{\\*\\htmltag64 <p>}\\htmlrtf hidden\\htmlrtf0 caf\\'e9 \\{x\\}{\\*\\htmltag72 </p>}}"
    assert mc.rtf_html(html) == "<p>café {x}</p>" and mc.rtf_html(b"{\\rtf1 x}") is None


def test_eml_and_mbox(spark):
    rows = [("m1", "Héllo", "Ann", "a@x", "b@x", None, "Thu, 01 Jan 1970 00:00:00 +0000", "<1@x>", "From me\nline"), ("m2", "s", None, None, "b@x", None, "d", None, "t"), ("m3", "s", None, "a@x", None, None, "d", None, "t")]
    m = spark.createDataFrame(rows, "message_key string, subject string, sender_name string, sender_address string, to_list string, cc_list string, date string, message_id string, text string")
    got = {r.message_key: r.eml for r in sinks.plain_eml(m).collect()}
    assert got["m2"] is None and got["m3"] is None
    assert got["m1"] == "From: Ann <a@x>\r\nTo: b@x\r\nSubject: =?UTF-8?B?SMOpbGxv?=\r\nDate: Thu, 01 Jan 1970 00:00:00 +0000\r\nMessage-ID: <1@x>\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\nFrom me\r\nline\r\n"
    box = m.select(F.lit("/a").alias("folder_path"), "message_key", F.col("sender_address").alias("sender"), "date", F.col("text").alias("content"))
    assert sinks.mbox_folders(box.where("message_key = 'm1'")).first().mbox == "From a@x Thu, 01 Jan 1970 00:00:00 +0000\n>From me\nline\n\n"
    assert sinks.mail_stream(box).count() == 3 and {r.file_name for r in sinks.numbered(box, suffix=".eml").collect()} == {"1.eml", "2.eml", "3.eml"}


def test_shards_and_tar(spark, tmp_path):
    f = spark.createDataFrame([("a", 5), ("b", 6), ("c", 20), ("d", 1), ("e", 9)], "path string, size long")
    assert [(r.path, r.shard) for r in sinks.shards(f, 10).orderBy("path").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 3)]
    files = spark.createDataFrame([(f"f{k:02d}", bytes([k]) * 700) for k in range(20)], "path string, content binary")
    rows = sinks.write_tar(files, str(tmp_path), 6000).collect()
    assert len(rows) == 20
    seen = {}
    for t in tmp_path.glob("*"):
        assert t.suffix == ".tar"
        with tarfile.open(t) as h:
            seen |= {e.name: h.extractfile(e).read() for e in h}
    assert seen == {f"f{k:02d}": bytes([k]) * 700 for k in range(20)} and len({r.shard for r in rows}) > 3


def test_families(spark):
    m = spark.createDataFrame([("m1", "IPM.Note"), ("m2", "REPORT.x"), ("m3", "IPM.Schedule.Meeting.Request"), ("m4", "IPM.Note")], "message_key string, message_class string")
    b = spark.createDataFrame([("m1", "t1", "text"), ("m1", "h1", "html"), ("m1", "r1", "rtf"), ("m4", "t4", "text"), ("m3", "t3", "text")], "message_key string, body_key string, body_type string")
    a = spark.createDataFrame([("m1", "a2", 1, None), ("m1", "a1", 0, "image/png")], "message_key string, attachment_key string, ordinal int, content_type string")
    parts = families.mime_parts(m, b, a).orderBy("message_key", "ordinal", "kind").collect()
    show = [(r.message_key, r.ordinal, r.kind, r.media_type) for r in parts]
    assert show == [
        ("m1", 0, "multipart_alternative", "multipart/alternative"), ("m1", 0, "root", "multipart/mixed"), ("m1", 1, "body", "text/plain"), ("m1", 2, "body", "text/html"), ("m1", 3, "body", "application/rtf"),
        ("m1", 4, "attachment", "image/png"), ("m1", 5, "attachment", "application/octet-stream"), ("m2", 0, "report_body", "message/delivery-status"), ("m2", 0, "root", "multipart/report"),
        ("m3", 0, "body", "text/plain"), ("m3", 0, "root", "multipart/mixed"), ("m3", 1, "calendar", "text/calendar"), ("m4", 0, "body", "text/plain"),
    ]
    key = {(r.message_key, r.kind): r.part_key for r in parts}
    assert {r.parent_part_key for r in parts if r.media_type in ("text/html",)} == {key["m1", "multipart_alternative"]} and [r.parent_part_key for r in parts if r.message_key == "m4"] == [None]
    p = spark.createDataFrame([(4, 0x001A001E, "IPM.Note"), (4, 0x0037001F, "Re: x"), (2, 0x3001001F, " In/box ")], "node_id long, tag long, text string")
    n = spark.createDataFrame([(4, 0), (36, 1), (2, 2), (34, 3)], "node_id long, ordinal long")
    got = {r.message_node_id: r for r in families.message_rows(n, p, "x").collect()}
    assert got["node_4"].normalized_subject == "x" and got["node_24"].item_type == "message_candidate"
    f = families.folder_rows(n, p.where(F.col("tag") == 0x3001001F).select("node_id", F.col("text").alias("display_name")), "x").orderBy("ordinal").collect()
    assert [(r.name, r.folder_path) for r in f] == [("root", "/"), ("In/box", "/In_box"), ("node_22", "/node_22")]
    h = spark.createDataFrame([("m1", "A: b\r\n"), ("m2", None), ("m3", "x")], "message_key string, transport_headers string")
    assert [(r.status, r.authoritative) for r in families.header_rows(h).orderBy("message_key").collect()] == [("transport_headers_valid", True), ("transport_headers_absent", False), ("transport_headers_invalid_missing_colon", False)]


def test_flat_recipients(spark):
    rows = [("m", 0, 1, None, "Ann", "a@x", "smtp", None), ("m", 1, 4, "Bob", "B", "/o=x", "EX", None), ("m", 2, None, None, None, None, None, None), ("m", 3, 9, None, None, "/o", "EX", "s@x")]
    df = spark.createDataFrame(rows, "message_key string, ordinal int, role_code int, recipient_name string, display_name string, raw_address string, address_type string, smtp string")
    got = [(r.recipient_type, r.display_name, r.smtp_address, r.resolution_status) for r in families.flat_recipients(df).orderBy("ordinal").collect()]
    assert got == [("to", "Ann", "a@x", "smtp_available"), ("reply_to", "Bob", None, "raw_address_preserved"), ("unknown", None, None, "address_unavailable"), ("unknown_9", None, "s@x", "smtp_available")]
