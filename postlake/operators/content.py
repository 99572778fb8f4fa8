"""Bodies and attachments of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import identity as ids
from postlake.functions import text as tx

MAX_BODY_BYTES = 64 << 20
#: A binary body of this length is a reference that wasn't resolved.
_REFERENCE_BYTES = 4
EMBEDDED = 5


def usable_binary(c: Column, most: int = MAX_BODY_BYTES) -> Column:
    """F09."""
    n = F.octet_length(c)
    return F.coalesce((n > 0) & (n != _REFERENCE_BYTES) & (n <= most), F.lit(False))


def body_extension(kind: Column) -> Column:
    return F.when(kind.isin("html", "rtf"), kind).otherwise("txt")


def body_payloads(messages: DataFrame) -> DataFrame:
    """P08. messages(message_key, text string, html binary, html_text string, rtf binary) to
    (message_key, body_type, encoding, content): text; HTML as bytes if they are usable, else as
    text; usable RTF."""
    utf8, none = F.lit("utf-8"), tx.none()
    part = lambda kind, enc, content: F.struct(F.lit(kind).alias("body_type"), enc.alias("encoding"), content.alias("content"))
    parts = F.array_compact(
        F.array(
            F.when(F.col("text").isNotNull(), part("text", utf8, F.col("text").cast("binary"))),
            F.when(usable_binary(F.col("html")), part("html", none, F.col("html"))).when(F.col("html_text").isNotNull(), part("html", utf8, F.col("html_text").cast("binary"))),
            F.when(usable_binary(F.col("rtf")), part("rtf", none, F.col("rtf"))),
        )
    )
    return messages.select("message_key", F.inline(parts))


def body_records(payloads: DataFrame) -> DataFrame:
    """P10: what is recorded of a body; a null content is one that couldn't be had."""
    content = F.coalesce("content", F.lit(b""))
    path = F.concat(F.lit("bodies/"), "message_key", F.lit("."), body_extension(F.col("body_type")))
    return payloads.select(
        "message_key", ids.body_key(F.col("message_key"), F.col("body_type")).alias("body_key"), "body_type", path.alias("archive_path"), "encoding",
        F.octet_length(content).cast("bigint").alias("size_bytes"), F.sha2(content, 256).alias("sha256"), F.when(F.col("content").isNotNull(), "extracted").otherwise("unavailable").alias("status"),
    )


def body_coverage(messages: DataFrame) -> DataFrame:
    """(message_key, supported_body_properties, extracted, unresolved, preferred, status):
    which bodies a message has properties of and which of them could be read."""
    kinds = ("text", "html", "rtf")
    present = {"text": F.col("text").isNotNull(), "html": F.col("html").isNotNull() | F.col("html_text").isNotNull(), "rtf": F.col("rtf").isNotNull()}
    got = {"text": F.col("text").isNotNull(), "html": usable_binary(F.col("html")) | F.col("html_text").isNotNull(), "rtf": usable_binary(F.col("rtf"))}
    listed = lambda which, order=kinds: F.array_compact(F.array(*[F.when(which[k], F.lit(k)) for k in order]))
    d = messages.select("message_key", F.size(listed(present)).alias("supported_body_properties"), listed(got).alias("extracted"), F.array_except(listed(present), listed(got)).alias("unresolved"), F.get(listed(got, ("html", "text", "rtf")), F.lit(0)).alias("preferred"))
    n, k = F.size("extracted").cast("string"), F.col("supported_body_properties").cast("string")
    base = F.concat(F.lit("body_payload_extracted; payloads="), n, F.lit("; supported_body_properties="), k, F.lit("; body_types="), F.array_join(F.array_sort("extracted"), ","))
    status = (
        F.when((F.size("extracted") > 0) & (F.size("unresolved") > 0), F.concat(base, F.lit("; preferred_body_type="), "preferred", F.lit("; unresolved_body_types="), F.array_join("unresolved", ",")))
        .when(F.size("extracted") > 0, base)
        .when(F.col("supported_body_properties") > 0, F.concat(F.lit("body_payload_properties_present_but_unusable; supported_body_properties="), k))
        .otherwise("body_payload_property_absent; supported_body_properties=0")
    )
    return d.withColumn("status", status)


def size_status(declared: Column, actual: Column) -> Column:
    """P13."""
    return (
        F.when(declared.isNull() & actual.isNull(), "payload_unavailable_size_unknown")
        .when(declared.isNull(), "declared_size_absent")
        .when(actual.isNull(), "payload_unavailable_declared_size_present")
        .when(declared == actual, "size_matched")
        .otherwise("size_mismatch")
    )


def source_reference(method: Column) -> Column:
    return (
        F.when(method == 1, "mapi:PR_ATTACH_DATA_BIN/by_value")
        .when(method == EMBEDDED, "mapi:PR_ATTACH_DATA_OBJ/embedded_message")
        .when(method.isNull(), "attachment_table_or_property_context:method_absent")
        .otherwise(F.concat(F.lit("mapi:PR_ATTACH_METHOD="), method.cast("string")))
    )


def attachment_records(attachments: DataFrame) -> DataFrame:
    """P11, P12, P15. attachments(message_key, ordinal, long_name, short_name, content_id, hidden,
    method, declared_size, content)."""
    name = F.coalesce("long_name", "short_name")
    embedded_name = F.concat(F.lit("embedded_"), F.col("ordinal").cast("string"), F.lit(".eml"))
    safe = F.when((F.col("method") == EMBEDDED) & name.isNull(), embedded_name).otherwise(tx.safe_filename(name, F.col("ordinal")))
    d = attachments.withColumn("attachment_key", ids.attachment_key(F.col("message_key"), F.col("ordinal"))).withColumn("filename_original", name).withColumn("filename_safe", safe)
    size = F.octet_length("content").cast("bigint")
    declared = F.when(F.col("declared_size") >= 0, F.col("declared_size").cast("bigint"))
    status = F.when(F.col("content").isNotNull(), "extracted").when(F.col("method") == EMBEDDED, "embedded_message_payload_deferred").otherwise("attachment_payload_unavailable")
    return d.select(
        "message_key", "attachment_key", "ordinal", "filename_original", "filename_safe", tx.file_extension(F.col("filename_safe")).alias("extension"), F.coalesce(size, F.lit(0)).alias("size_bytes"),
        declared.alias("declared_size_bytes"), size_status(declared, size).alias("size_status"), F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("sha256"),
        (F.coalesce("hidden", F.lit(False)) | F.col("content_id").isNotNull()).alias("is_inline"), "content_id", F.col("method").alias("attachment_method"), source_reference(F.col("method")).alias("source_ref"),
        F.concat(F.lit("attachments/"), "message_key", F.lit("/"), "attachment_key", F.lit("_"), "filename_safe").alias("archive_path"), status.alias("extraction_status"),
    )


def extension_allowed(extension: Column, allowed: list[str]) -> Column:
    """no list and no extension both allow."""
    return F.lit(True) if not allowed else extension.isNull() | F.lower(extension).isin(*[a.lower().lstrip(".") for a in allowed])


def with_payloads(records: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Records with their content; null where it is missing."""
    return records.join(payloads.select(key, "content"), key, "left")


def unique_names(files: DataFrame, folder: str, name: str, order: list[str]) -> DataFrame:
    """Adds ``unique_name``: the second and later files of one sanitised name in a folder get
    _0002 and so on before their extension."""
    d = files.withColumn("__safe", tx.sanitize_segment(F.col(name)))
    n = F.row_number().over(Window.partitionBy(folder, "__safe").orderBy(*order))
    d = d.withColumn("__n", n)
    mark = F.concat(F.lit("_"), F.lpad(F.col("__n").cast("string"), 4, "0"))
    stem, ext = F.regexp_extract("__safe", r"^(.+)\.([^.]+)$", 1), F.regexp_extract("__safe", r"^(.+)\.([^.]+)$", 2)
    named = F.when(F.col("__n") == 1, F.col("__safe")).when(ext != "", F.concat(stem, mark, F.lit("."), ext)).otherwise(F.concat("__safe", mark))
    return d.withColumn("unique_name", named).drop("__safe", "__n")


def bytes_by_message(payloads: DataFrame) -> DataFrame:
    """A07."""
    return payloads.groupBy("message_key").agg(F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))
