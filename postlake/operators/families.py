"""Message, folder, header and MIME families, evidence and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import identity as ids
from postlake.functions import text as tx
from postlake.functions.mailcode import validated_headers_udf
from postlake.operators.typed import is_encrypted, is_report, is_schedule


def wide_properties(properties: DataFrame, fields: dict[str, tuple[int, ...]], by: tuple[str, ...] = ()) -> DataFrame:
    """P01. properties(node_id, tag, text) to a column for each field: its first tag that has a text.
    ``by`` names columns that tell apart the nodes of several files."""
    aggs = []
    for name, tags in fields.items():
        aggs.append(F.coalesce(*[F.min(F.when(F.col("tag") == t, F.col("text"))) for t in tags]).alias(name))
    return properties.groupBy(*by, "node_id").agg(*aggs)


MESSAGE_FIELDS = {
    "message_class": (0x001A001F, 0x001A001E), "subject": (0x0037001F, 0x0037001E), "sender_name": (0x0C1A001F, 0x0C1A001E), "sender_email": (0x0C1F001F, 0x0C1F001E), "sender_address_type": (0x0C1E001F, 0x0C1E001E),
    "internet_message_id": (0x1035001F, 0x1035001E), "in_reply_to_id": (0x1042001F, 0x1042001E), "conversation_index": (0x00710102,), "transport_headers": (0x007D001F, 0x007D001E), "sent_at": (0x00390040,),
    "received_at": (0x0E060040,), "created_at": (0x30070040,), "modified_at": (0x30080040,), "body": (0x1000001F, 0x1000001E),
}


def message_rows(nodes: DataFrame, properties: DataFrame, archive: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    """P01-P03. nodes(node_id) of messages; one whose properties couldn't be read has a candidate row."""
    wide = wide_properties(properties, MESSAGE_FIELDS, by).withColumn("__seen", F.lit(True))
    node = ids.node_identity(F.col("node_id"))
    seen = F.col("__seen").isNotNull()
    d = nodes.where(ids.message_kind(F.col("node_id")).isNotNull()).join(wide, [*by, "node_id"], "left")
    return d.select(
        *by, ids.message_key(archive, node).alias("message_key"), node.alias("message_node_id"), *MESSAGE_FIELDS, tx.normalize_subject(F.col("subject")).alias("normalized_subject"),
        tx.threading_status(F.col("internet_message_id"), F.col("in_reply_to_id"), F.array(), F.col("conversation_index")).alias("threading_status"),
        F.when(seen, "message_metadata").otherwise("message_candidate").alias("item_type"), F.when(seen, "message_properties_extracted").otherwise("message_properties_unavailable").alias("extraction_status"),
    )


def folder_rows(nodes: DataFrame, names: DataFrame, archive: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    """P04, P05. nodes(node_id, ordinal); names(node_id, display_name). The root comes first, every
    folder lies below it."""
    n = nodes.where(ids.folder_kind(F.col("node_id")).isNotNull()).join(names, [*by, "node_id"], "left")
    identity = ids.node_identity(F.col("node_id"))
    name = F.coalesce(F.nullif(tx.trim(F.col("display_name")), F.lit("")), identity)
    root = ids.folder_key(archive, "root")
    rows = n.select(*by, ids.folder_key(archive, identity).alias("folder_key"), identity.alias("node_id"), root.alias("parent_folder_key"), name.alias("name"), F.concat(F.lit("/"), F.regexp_replace(name, r"[/\x00-\x1F\x7F]", "_")).alias("folder_path"), F.col("ordinal").cast("bigint").alias("ordinal"), F.lit("folder_found").alias("status"))
    top = (nodes.select(*by).distinct() if by else nodes.sparkSession.range(1)).select(*by, root.alias("folder_key"), F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_folder_key"), F.lit("root").alias("name"), F.lit("/").alias("folder_path"), F.lit(-1).cast("bigint").alias("ordinal"), F.lit("folder_synthetic_root").alias("status"))
    return top.unionByName(rows)


def header_rows(messages: DataFrame) -> DataFrame:
    """A row a message; authoritative where the transport headers are valid and carry no body."""
    v = F.col("v")
    d = messages.select("message_key", "transport_headers", validated_headers_udf("transport_headers").alias("v"))
    absent = F.col("transport_headers").isNull()
    sure = v["failure"].isNull() & ~v["embedded_body"]
    status = F.when(absent, "transport_headers_absent").when(v["failure"].isNotNull(), F.concat(F.lit("transport_headers_invalid_"), v["failure"])).when(v["embedded_body"], "transport_headers_with_body").otherwise("transport_headers_valid")
    return d.select("message_key", ids.stable_id("header", F.col("message_key")).alias("header_key"), v["normalized"].alias("normalized_headers"), status.alias("status"), (~absent & sure).alias("authoritative"))


def recipient_rows(tables: DataFrame) -> DataFrame:
    """P16, J17. tables(message_key, roles, names, smtp, raw), lists by row; lists that disagree in
    length give nothing."""
    same = (F.size("roles") == F.size("names")) & (F.size("roles") == F.size("smtp")) & (F.size("roles") == F.size("raw"))
    r = tables.where(same).select("message_key", F.posexplode(F.arrays_zip("roles", "names", "smtp", "raw")).alias("ordinal", "z"))
    role = tx.table_role(F.col("z.roles"))
    status = F.when(F.col("z.smtp").isNotNull(), "smtp_available").when(F.col("z.raw").isNotNull(), "raw_address_preserved").otherwise("address_unavailable")
    return r.select("message_key", ids.recipient_key(F.col("message_key"), role, F.col("ordinal")).alias("recipient_key"), role.alias("recipient_type"), F.col("z.names").alias("display_name"), F.col("z.smtp").alias("smtp_address"), F.col("z.raw").alias("raw_address"), "ordinal", status.alias("status"))


def flat_recipients(rows: DataFrame) -> DataFrame:
    """P17. rows(message_key, ordinal, role_code, recipient_name, display_name, raw_address,
    address_type, smtp): an SMTP address is taken from the raw one where the address type says so."""
    role = tx.flat_role(F.col("role_code"))
    own = F.when((F.upper(F.col("address_type")) == "SMTP") & F.col("raw_address").contains("@"), F.col("raw_address"))
    smtp = F.coalesce("smtp", own)
    status = F.when(smtp.isNotNull(), "smtp_available").when(F.col("raw_address").isNotNull(), "raw_address_preserved").otherwise("address_unavailable")
    return rows.select("message_key", ids.recipient_key(F.col("message_key"), role, F.col("ordinal")).alias("recipient_key"), role.alias("recipient_type"), F.coalesce("recipient_name", "display_name").alias("display_name"), "raw_address", "address_type", smtp.alias("smtp_address"), status.alias("resolution_status"), "ordinal")


_ORDER = {"text": 0, "html": 1, "rtf": 2, "report": 3, "calendar": 4}
_MEDIA = {"text": "text/plain", "html": "text/html", "rtf": "application/rtf", "report": "message/delivery-status", "calendar": "text/calendar"}


def _by(values: dict, column: str) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def mime_parts(messages: DataFrame, bodies: DataFrame, attachments: DataFrame) -> DataFrame:
    """(message_key, part_key, parent_part_key, ordinal, kind, media_type, status, authoritative).

    A message of more than one part has a root, multipart/report for reports and multipart/mixed
    else; a text and an HTML body share an alternative. Children are numbered from 0 in the order
    alternative, text, HTML, RTF, report, calendar, attachments by position; the root is 0 as well."""
    b = bodies.where(F.col("body_type").isin(*_ORDER)).groupBy("message_key").agg(F.count("*").alias("nb"), F.count_distinct(F.when(F.col("body_type").isin("text", "html"), F.col("body_type"))).alias("alt"))
    a = attachments.groupBy("message_key").agg(F.count("*").alias("na"))
    m = messages.select("message_key", is_report().alias("rep"), is_schedule().alias("sch"), is_encrypted().alias("enc")).join(b, "message_key", "left").join(a, "message_key", "left").na.fill(0, ["nb", "alt", "na"])
    m = m.withColumn("rooted", (F.col("nb") + F.col("na") > 1) | F.col("rep") | F.col("sch") | F.col("enc") | (F.col("na") > 0)).withColumn("alternative", F.col("rooted") & (F.col("alt") == 2))
    key = lambda *p: ids.stable_id("mime", F.col("message_key"), *p)
    root = F.when(F.col("rooted"), key("root"))
    plain = ~F.col("rep") & ~F.col("sch") & ~F.col("enc") & (F.col("nb") > 0)
    tops = m.where("rooted").select("message_key", key("root").alias("part_key"), F.lit(None).cast("string").alias("parent_part_key"), F.lit(-1).alias("phase"), F.lit(0).cast("bigint").alias("place"), F.lit("root").alias("kind"),
        F.when(F.col("rep"), "multipart/report").otherwise("multipart/mixed").alias("media_type"), F.when(F.col("nb") == 0, "mime_body_unavailable").otherwise("mime_projection_complete").alias("status"), plain.alias("authoritative"))
    alts = m.where("alternative").select("message_key", key("alternative").alias("part_key"), root.alias("parent_part_key"), F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("place"), F.lit("multipart_alternative").alias("kind"), F.lit("multipart/alternative").alias("media_type"), F.lit("mime_alternative_projection").alias("status"), F.lit(True).alias("authoritative"))
    under = F.when(F.col("alternative") & F.col("body_type").isin("text", "html"), key("alternative")).otherwise(root)
    parts = bodies.where(F.col("body_type").isin(*_ORDER)).join(m, "message_key").select("message_key", key("body", F.col("body_key")).alias("part_key"), under.alias("parent_part_key"), F.lit(1).alias("phase"), _by(_ORDER, "body_type").cast("bigint").alias("place"), F.lit("body").alias("kind"),
        F.when(F.col("enc"), "application/octet-stream").otherwise(_by(_MEDIA, "body_type")).alias("media_type"), F.lit("mime_body_projection").alias("status"), (~F.col("enc")).alias("authoritative"))
    has = lambda t: bodies.where(F.col("body_type") == t).select("message_key").distinct()
    lack = m.where("rep").join(has("report"), "message_key", "left_anti").select("message_key", key("report-body").alias("part_key"), key("root").alias("parent_part_key"), F.lit(2).alias("phase"), F.lit(0).cast("bigint").alias("place"), F.lit("report_body").alias("kind"), F.lit("message/delivery-status").alias("media_type"), F.lit("report_body_unavailable_non_authoritative").alias("status"), F.lit(False).alias("authoritative"))
    cal = m.where("sch").select("message_key", key("calendar").alias("part_key"), key("root").alias("parent_part_key"), F.lit(3).alias("phase"), F.lit(0).cast("bigint").alias("place"), F.lit("calendar").alias("kind"), F.lit("text/calendar").alias("media_type"), F.lit("schedule_payload_unavailable_non_authoritative").alias("status"), F.lit(False).alias("authoritative"))
    att = attachments.join(m, "message_key").select("message_key", key("attachment", F.col("attachment_key")).alias("part_key"), root.alias("parent_part_key"), F.lit(4).alias("phase"), F.col("ordinal").cast("bigint").alias("place"), F.lit("attachment").alias("kind"), tx.safe_media_type(F.coalesce("content_type", F.lit(""))).alias("media_type"), F.lit("mime_attachment_projection").alias("status"), F.lit(True).alias("authoritative"))
    every = alts.unionByName(parts).unionByName(lack).unionByName(cal).unionByName(att)
    order = Window.partitionBy("message_key").orderBy("phase", "place", "part_key")
    return tops.withColumn("ordinal", F.lit(0)).unionByName(every.withColumn("ordinal", F.row_number().over(order) - 1)).drop("phase", "place")


def property_evidence(properties: DataFrame, archive: str) -> DataFrame:
    """(evidence_key, node_id, tag, raw_size, raw_sha256, raw_hex) of retained properties."""
    node = ids.node_identity(F.col("node_id"))
    return properties.select(ids.stable_id("evidence", archive, node, F.col("tag")).alias("evidence_key"), "node_id", "tag", F.octet_length("raw").cast("bigint").alias("raw_size"), F.sha2("raw", 256).alias("raw_sha256"), tx.bounded_hex(F.col("raw")).alias("raw_hex"), "status")


def derived_evidence(families: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """P28, U01. family: (rows, its key column) to (evidence_key, family, record_key)."""
    out = None
    for name, (rows, key) in families.items():
        part = rows.select(ids.stable_id("evidence", name, F.col(key)).alias("evidence_key"), F.lit(name).alias("family"), F.col(key).alias("record_key"))
        out = part if out is None else out.unionByName(part)
    return out


def manifest(families: dict[str, DataFrame], payloads: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """P29. payloads(archive_path, size_bytes, sha256): a row for each family, those outside
    ``always`` only if they aren't empty, and for each payload. (artifact, kind, records, size_bytes, sha256)"""
    out = payloads.select(F.col("archive_path").alias("artifact"), F.lit("payload").alias("kind"), F.lit(1).cast("bigint").alias("records"), "size_bytes", "sha256")
    for name, rows in families.items():
        n = rows.agg(F.count("*").alias("records"))
        n = n if name in always else n.where("records > 0")
        out = out.unionByName(n.select(F.lit(f"metadata/{name}.jsonl").alias("artifact"), F.lit("family").alias("kind"), "records", F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("sha256")))
    return out


def named_columns(columns: DataFrame) -> DataFrame:
    """P34. columns(tag): adds name and role of table columns."""
    internal, person = (0x67F2, 0x67F3), (0x0C15, 0x3001, 0x3002, 0x3003, 0x39FE)
    ident = F.shiftright("tag", 16)
    return columns.withColumn("role", F.when(ident.isin(*internal), "internal").when(ident.isin(*person), "recipient").otherwise("unknown"))
