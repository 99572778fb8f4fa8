import struct

from pyspark.sql import functions as F

from postlake.functions import dates
from postlake.operators import sinks, typed


def test_rtf_progress_and_streams(spark, tmp_path):
    raw = b"{\\rtf1}"
    stored = struct.pack("<4I", len(raw) + 12, len(raw) + 12, 0x414C454D, 0) + raw
    b = spark.createDataFrame([("m1", "rtf", stored), ("m2", "rtf", b"bad"), ("m3", "text", b"t")], "message_key string, body_type string, content binary")
    got = {r.message_key: (r.path, r.content and bytes(r.content), r.status) for r in sinks.rtf_files(b).collect()}
    assert got == {"m1": ("rtf/m1.rtf", raw, "rtf_validated"), "m2": ("rtf/m2.rtf", None, "rtf_invalid")}
    e = spark.createDataFrame([("a", 1)], "event string, n int")
    sinks.append_progress(e, str(tmp_path / "p"))
    sinks.append_progress(e, str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ['{"event":"a","n":1}'] * 2
    t = spark.createDataFrame([("/a", "2"), ("/a", "1")], "folder_path string, text string")
    head, tail = typed.calendar_frame()
    files = {r.file: r.content for r in sinks.typed_streams(t, t, t.where("false"), (head, tail)).collect()}
    assert files == {"contacts.vcf": "12", "calendar.ics": head + "12" + tail}


def test_adapter_date(spark):
    rows = [("Mon, x", "filetime:116444736000000000", None), (" ", "filetime:116444736000000000", None), (None, None, "filetime:116444736010000000"), (None, "odd", None)]
    d = spark.createDataFrame(rows, "h string, s string, r string")
    got = [r.d for r in d.select(dates.adapter_date(F.col("h"), F.col("s"), F.col("r")).alias("d")).collect()]
    assert got == ["Mon, x", "Thu, 01 Jan 1970 00:00:00 +0000", "Thu, 01 Jan 1970 00:00:01 +0000", None]
