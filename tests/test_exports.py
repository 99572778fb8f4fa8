import email
import email.policy
import struct

from pyspark.sql import functions as F

from postlake.functions import mailcode as mc
from postlake.operators import sinks
from postlake.sources.exports import read_archives, read_mail


def test_eml_shapes():
    fields = [("From", "a@x"), ("Subject", mc.unstructured("Hé")), ("Cc", None)]
    whole = mc.eml("k", fields, {"text": b"hi\n", "html": b"<p>hi", "rtf": b"{\\rtf1}"}, [("é.png", "image/png", "c1", b"\x89PNG"), ("n", "bad", None, b"")])
    m = email.message_from_bytes(whole, policy=email.policy.default)
    assert [p.get_content_type() for p in m.walk()] == ["multipart/mixed", "multipart/alternative", "text/plain", "text/html", "application/rtf", "image/png", "application/octet-stream"]
    assert m["subject"] == "Hé" and m["cc"] is None
    png = list(m.walk())[5]
    assert png.get_content() == b"\x89PNG" and b"filename*=UTF-8''%C3%A9.png" in whole and png["content-id"] == "<c1>"
    assert email.message_from_bytes(mc.eml("k", fields, {"text": b"only"}, [])).get_payload() == "only\r\n"
    assert email.message_from_bytes(mc.eml("k", fields, {"report": b"r", "text": b"t"}, [])).get_content_type() == "multipart/report"
    assert mc.eml("k", fields, {"calendar": b"x"}, []) is None
    assert mc.transport_date("A: b\r\nDate: Thu, 01 Jan 1970 00:00:00 +0000\r\n") == "Thu, 01 Jan 1970 00:00:00 +0000"
    assert mc.transport_date("Date: x") is None and mc.transport_date("Date: a\r\nDate: b") is None and mc.transport_date(None) is None


def read_cfb(data):
    """A small reader, by the published format."""
    head = struct.unpack_from("<IIIIIIIII", data, 40)
    sector = lambda k: data[512 * (k + 1) : 512 * (k + 2)]
    fat = [x for s in struct.unpack_from("<109I", data, 76) if s != 0xFFFFFFFF for x in struct.unpack("<128I", sector(s))]

    def chain(k, table, get):
        out = b""
        while k < 0xFFFFFFFA:
            out += get(k)
            k = table[k]
        return out

    directory = chain(head[2], fat, sector)
    mini_fat = struct.unpack(f"<{128 * head[6]}I", chain(head[5], fat, sector)) if head[6] else ()
    entries = []
    for at in range(0, len(directory), 128):
        size, kind, _, left, right, child = struct.unpack_from("<HBBIII", directory, at + 64)
        start, length = struct.unpack_from("<IQ", directory, at + 116)
        entries.append((directory[at : at + max(0, size - 2)].decode("utf-16-le"), kind, right, child, start, length))
    mini = chain(entries[0][4], fat, sector)[: entries[0][5]]
    out, k = {}, entries[0][3]
    while k != 0xFFFFFFFF:
        name, kind, right, _, start, length = entries[k]
        body = chain(start, fat, sector) if length >= 4096 else chain(start, mini_fat, lambda x: mini[64 * x : 64 * x + 64])
        out[name] = body[:length]
        k = right
    return out


def test_compound_files():
    streams = {"a": b"", "bb": b"x", "C": b"y" * 65, "long": bytes(range(256)) * 300, "edge": b"z" * 4096, "mini": b"m" * 4095}
    assert read_cfb(mc.cfb(streams)) == streams and read_cfb(mc.cfb({})) == {}
    got = read_cfb(mc.msg({0x0037001F: "Hé", 0x0E070003: -3, 0x10090102: b"rtf"}))
    assert got["__substg1.0_0037001F"].decode("utf-16-le") == "Hé" and got["__substg1.0_10090102"] == b"rtf"
    assert struct.unpack_from("<IIiI", got["__properties_version1.0"], 48) == (0x0E070003, 6, -3, 0)


def test_exports_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("y", None)], "a string, b int")
    lines = sinks.json_lines(rows).collect()
    assert [r.value for r in lines] == ['{"a":"x","b":1}', '{"a":"y","b":null}']
    files = spark.createDataFrame([("metadata/m.jsonl", "\n".join(r.value for r in lines).encode()), ("bodies/b.txt", b"no")], "path string, content binary")
    sinks.write_tar(files, str(tmp_path / "tar")).collect()
    assert sorted(r.value for r in read_archives(spark, str(tmp_path / "tar")).collect()) == [r.value for r in lines]
    box = spark.createDataFrame([("/f", f"m{k}", "a@x", "Thu, 01 Jan 1970 00:00:00 +0000", f"Subject: s{k}\n\nFrom here\n>From there") for k in range(3)], "folder_path string, message_key string, sender string, date string, content string")
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "f.mbox").write_text(sinks.mbox_folders(box).first().mbox)
    (tmp_path / "mail" / "one.eml").write_bytes(mc.eml("k", [("Subject", "one")], {"text": b"t"}, []))
    (tmp_path / "mail" / "c.vcf").write_bytes(b"BEGIN:VCARD")
    got = read_mail(spark, str(tmp_path / "mail")).orderBy("kind", "ordinal").collect()
    assert [(r.kind, r.subject) for r in got] == [("eml", "one"), ("mbox", "s0"), ("mbox", "s1"), ("mbox", "s2"), ("vcard", None)]
    assert bytes(got[1].content).startswith(b"Subject: s0\n\nFrom here\n>From there\n")
    assert read_mail(spark, str(tmp_path / "mail")).where(F.col("content").isNull()).count() == 0
