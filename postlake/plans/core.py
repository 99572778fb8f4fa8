"""The reference's own operators as queries, each with its SQL twin. A query's name lists the
operators of the survey that it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import dates, identity as ids
from postlake.functions import text as tx
from postlake.operators import batch, content, envelopes, families, graph, ownership, reports, routing, sinks, typed
from postlake.plans import driver as dr
from postlake.plans import twins as tw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


_ITEMS = tw.with_(tw.NBT, tw.FOLDERS, tw.MESSAGES)


@query("m1_routing_counts", _ITEMS + f""", i AS (SELECT folder_key, folder_path, {tw.route(tw.kind('message_class'), 'visibility')} AS s FROM messages)
SELECT f.folder_key, f.folder_path, count(i.s) AS item_count, count(*) FILTER (s LIKE 'routed_%') AS emitted_count, count(*) FILTER (s LIKE 'filtered_%') AS filtered_count, count(*) FILTER (s LIKE 'skipped_%') AS skipped_count,
 count(*) FILTER (s LIKE 'unavailable_%') AS unavailable_count, count(*) FILTER (s LIKE 'failed_%') AS failed_count FROM folders f LEFT JOIN i ON i.folder_key = f.folder_key GROUP BY f.folder_key, f.folder_path""")  # fmt: skip
def routing_counts(spark, d):
    # kind and status are columns of their own, or each count would work them out again
    m = dr.messages(spark, d).withColumn("item_kind", routing.item_kind(F.col("message_class")))
    m = m.withColumn("routing_status", routing.routing_status(F.col("item_kind"), F.col("visibility")))
    items = m.select(F.lit("item").alias("record_kind"), F.col("folder_key").alias("parent_envelope_key"), "folder_path", "routing_status")
    return routing.routing_counts(dr.folders(spark, d), items)


@query("F01_F02_F03_routing", _ITEMS + f""", k AS (SELECT message_key, visibility, {tw.kind('message_class')} AS item_kind FROM messages)
SELECT message_key, item_kind, {tw.confidence('item_kind')} AS confidence, {tw.route('item_kind', 'visibility')} AS routed_all, {tw.route('item_kind', 'visibility', "'note','schedule','report'")} AS routed_email, {tw.route('item_kind', 'visibility', "'contact'")} AS routed_contact,
 {tw.route('item_kind', "CASE WHEN visibility IN ('associated', 'deleted') THEN 'x' ELSE visibility END")} AS with_hidden FROM k""")  # fmt: skip
def routing_decisions(spark, d):
    k, v = F.col("item_kind"), F.col("visibility")
    m = dr.messages(spark, d).withColumn("item_kind", routing.item_kind(F.col("message_class")))
    return m.select(
        "message_key", k, routing.class_confidence(k).alias("confidence"), routing.routing_status(k, v).alias("routed_all"), routing.routing_status(k, v, "email").alias("routed_email"),
        routing.routing_status(k, v, "contact").alias("routed_contact"), routing.routing_status(k, v, deleted=True, associated=True).alias("with_hidden"),
    )


@query("B01_B08_node_ids", tw.with_(tw.NBT) + """SELECT node_id, CASE node_id & 31 WHEN 2 THEN 'normal_folder' WHEN 3 THEN 'search_folder' END AS folder_kind, CASE node_id & 31 WHEN 4 THEN 'normal_message' WHEN 8 THEN 'associated_message' END AS message_kind,
 CASE node_id & 31 WHEN 13 THEN 'hierarchy_table' WHEN 14 THEN 'contents_table' WHEN 15 THEN 'associated_contents_table' WHEN 16 THEN 'search_contents_table' END AS table_kind, (node_id // 32) * 32 + 2 AS owner_folder,
 CASE WHEN ordinal = 0 THEN 'null' WHEN ordinal % 32 = 0 THEN 'heap' ELSE 'node' END AS reference_kind, CASE WHEN ordinal // 32 BETWEEN 1 AND 65535 THEN ordinal // 32 END AS heap_index, ordinal & 2 <> 0 AS internal_block, ordinal & 31 = 18 AS recipient_table,
 'node_' || lower(to_hex(node_id)) AS identity, ((ordinal & 255) << 24) | (((ordinal >> 8) & 255) << 16) | (((ordinal >> 16) & 255) << 8) | ((ordinal >> 24) & 255) AS swapped, ordinal & 65535 AS tag_type FROM nbt""")  # fmt: skip
def node_ids(spark, d):
    n, o = F.col("node_id"), F.col("ordinal")
    return dr.nbt(spark, d).select(
        n, ids.folder_kind(n).alias("folder_kind"), ids.message_kind(n).alias("message_kind"), ids.table_kind(n).alias("table_kind"), ids.owner_folder(n).alias("owner_folder"), ids.reference_kind(o).alias("reference_kind"),
        ids.heap_index(o).alias("heap_index"), ids.is_internal_block(o).alias("internal_block"), ids.is_recipient_table(o).alias("recipient_table"), ids.node_identity(n).alias("identity"), ids.swapped32(o).alias("swapped"), ids.tag_type(o).alias("tag_type"),
    )


@query("A02_message_ownership", tw.with_(tw.NBT, tw.CANDIDATES, tw.FOLDERS, tw.MEMBERS, tw.OWNERS) + "SELECT * FROM owners")
def owners(spark, d):
    return ownership.resolved_owners(dr.candidates(spark, d), dr.memberships(spark, d))


@query("J03_J14_unmatched", tw.with_(tw.NBT, tw.CANDIDATES, tw.FOLDERS, tw.MEMBERS) + "SELECT node_id, ordinal FROM candidates WHERE node_id NOT IN (SELECT node_id FROM members)")
def unmatched(spark, d):
    return ownership.unmatched(dr.candidates(spark, d), dr.memberships(spark, d), "node_id").select("node_id", "ordinal")


@query("J08_exactly_one", "SELECT o_orderkey, CASE WHEN n = 1 THEN l_partkey END AS l_partkey, CASE WHEN n = 1 THEN l_suppkey END AS l_suppkey, coalesce(n, 0) AS match_count, CASE WHEN n IS NULL THEN 'unavailable' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status "
       "FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")  # fmt: skip
def exactly_one(spark, d):
    li = dr.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    return ownership.exactly_one(dr.table(spark, d, "orders").select("o_orderkey"), li, "o_orderkey")


@query("A08_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    return ownership.duplicated(dr.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("J18_paired_compare", "WITH a AS (SELECT l_suppkey AS k, l_partkey AS r, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n FROM lineitem WHERE l_linenumber = 1), "
       "b AS (SELECT l_suppkey AS k, l_partkey AS r, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n FROM lineitem WHERE l_linenumber = 2) "
       "SELECT coalesce(a.k, b.k) AS l_suppkey, coalesce(a.n, b.n) AS k, a.r AS left_row, b.r AS right_row, CASE WHEN a.r IS NULL THEN 'only_right' WHEN b.r IS NULL THEN 'only_left' ELSE 'paired' END AS pair_status FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n")  # fmt: skip
def paired(spark, d):
    li = dr.table(spark, d, "lineitem")
    out = ownership.paired(li.where("l_linenumber = 1"), li.where("l_linenumber = 2"), "l_suppkey", "l_partkey")
    return out.withColumn("k", F.col("k").cast("bigint"))


@query("X01_X02_keys", f"SELECT doc_id, {tw.sid('pst', 'source')} AS archive, {tw.sid('folder', 'source', 'lang')} AS folder, {tw.sid('msg', 'source', 'doc_id')} AS msg, {tw.sid('body', 'doc_id', "'text'")} AS body, {tw.sid('att', 'doc_id', 'n_chars')} AS att, {tw.sid('rcpt', 'doc_id', "'to'", '7')} AS rcpt, "
       f"{tw.sid('msg', 'doc_id', 'lang', "lpad(lower(to_hex(doc_id)), 8, '0')")} AS embedded, sha256(text) AS digest, crc FROM (SELECT *, 0 AS crc FROM documents)")  # fmt: skip
def keys(spark, d):
    x = dr.table(spark, d, "documents")
    c = F.col
    return x.select(
        "doc_id", ids.archive_id(c("source")).alias("archive"), ids.folder_key(c("source"), c("lang")).alias("folder"), ids.message_key(c("source"), c("doc_id")).alias("msg"), ids.body_key(c("doc_id"), "text").alias("body"),
        ids.attachment_key(c("doc_id"), c("n_chars")).alias("att"), ids.recipient_key(c("doc_id"), "to", "7").alias("rcpt"), ids.embedded_key(c("doc_id"), c("lang"), c("doc_id")).alias("embedded"),
        F.sha2(c("text").cast("binary"), 256).alias("digest"), F.lit(0).alias("crc"),
    )


@query("X10_X20_X27_X28_text", r"""WITH s AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'Re: fwd : ' || text WHEN turn % 3 = 1 THEN '  FW:RE: ' || text ELSE text END AS subject FROM conversations),
q AS (SELECT *, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)^(>*From )', '>\1', 'g') AS m FROM s)
SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(subject, '(?i)^(\s*(re|fw|fwd)\s*:)+', ''), '\s+', ' ', 'g'))) AS subject, CASE WHEN m LIKE '%' || chr(10) THEN m ELSE m || chr(10) END AS mbox,
 replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10)) AS crlf, CASE WHEN NOT contains(text, chr(10)) AND NOT contains(text, chr(13)) THEN nullif(trim(text), '') END AS header,
 replace(replace(replace(replace(replace(text, '\', '\\'), ';', '\;'), ',', '\,'), chr(13), ''), chr(10), '\n') AS escaped FROM q""")  # fmt: skip
def text_functions(spark, d):
    t = F.col("text")
    subject = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Re: fwd : "), t)).when(F.col("turn") % 3 == 1, F.concat(F.lit("  FW:RE: "), t)).otherwise(t)
    c = dr.table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.normalize_subject(subject).alias("subject"), tx.mboxrd(t).alias("mbox"), tx.crlf(t).alias("crlf"), tx.clean_header(t).alias("header"), tx.escape_text(t).alias("escaped"))


@query("X13_X19_paths", r"""WITH p AS (SELECT *, '/ ' || p_brand || '//' || p_type || ': x?/..' || p_name AS path FROM part), s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: substr(coalesce(nullif(regexp_replace(trim(regexp_replace(x, '[:?]', '_', 'g')), '^\.+|\.+$', '', 'g'), ''), '_'), 1, 120)) AS seg FROM p)
SELECT p_partkey, list_aggregate(seg, 'string_agg', '/') AS safe, CASE WHEN len(seg) > 1 THEN list_aggregate(seg[1:len(seg)-1], 'string_agg', '/') || '/' ELSE '' END || '.' || seg[len(seg)] || '.directory/' || seg[len(seg)] || '.mbox' AS nested,
 NOT (path LIKE '/%') AND NOT list_contains(string_split(path, '/'), '..') AS confined, CASE WHEN p_size < 128 THEN 'lt_128' WHEN p_size < 512 THEN 'lt_512' WHEN p_size < 4096 THEN 'lt_4096' WHEN p_size < 65536 THEN 'lt_65536' ELSE 'gte_65536' END AS bucket,
 substr(regexp_replace(regexp_replace(p_type || '(' || p_brand, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS reason, CAST(nullif(regexp_extract('a=1; n: ' || p_size || ', z', 'n:\s*([^,;]*)', 1), '') AS BIGINT) AS counter FROM s""")  # fmt: skip
def paths(spark, d):
    p = dr.table(spark, d, "part").withColumn("path", F.concat(F.lit("/ "), "p_brand", F.lit("//"), "p_type", F.lit(": x?/.."), "p_name"))
    path = F.col("path")
    return p.select(
        "p_partkey", tx.safe_folder_path(path).alias("safe"), tx.nested_mailbox_path(path).alias("nested"), tx.is_confined(path).alias("confined"), tx.size_bucket(F.col("p_size")).alias("bucket"),
        tx.sanitized_reason(F.concat("p_type", F.lit("("), "p_brand")).alias("reason"), tx.status_counter(F.concat(F.lit("a=1; n: "), "p_size", F.lit(", z")), "n").alias("counter"),
    )


@query("X50_filetime", "SELECT o_orderkey, strftime(make_timestamp(CAST(epoch_us(o_orderdate) AS BIGINT)), '%a, %d %b %Y %H:%M:%S') || ' +0000' AS rfc2822, epoch_us(o_orderdate) AS micros FROM orders")
def filetime(spark, d):
    ticks = F.unix_micros("o_orderdate") * 10 + dates.EPOCH_TICKS
    o = dr.table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", dates.filetime_rfc2822(ticks).alias("rfc2822"), dates.filetime_micros(ticks).alias("micros"))


@query("P08_P10_bodies", tw.with_(tw.TEXTS, tw.PAYLOADS, tw.BODIES) + "SELECT * FROM bodies")
def bodies(spark, d):
    return content.body_records(content.body_payloads(dr.texts(spark, d)))


@query("P09_U04_body_coverage", tw.with_(tw.TEXTS) + """, g AS (SELECT message_key, [text IS NOT NULL, html IS NOT NULL OR html_text IS NOT NULL, rtf IS NOT NULL] AS p, [text IS NOT NULL, coalesce(octet_length(html) NOT IN (0, 4), FALSE) OR html_text IS NOT NULL, coalesce(octet_length(rtf) NOT IN (0, 4), FALSE)] AS g FROM texts),
h AS (SELECT message_key, list_filter(['text', 'html', 'rtf'], lambda x, i: p[i]) AS present, list_filter(['text', 'html', 'rtf'], lambda x, i: g[i]) AS got FROM g), j AS (SELECT *, list_filter(present, lambda x: NOT list_contains(got, x)) AS un, CASE WHEN list_contains(got, 'html') THEN 'html' WHEN list_contains(got, 'text') THEN 'text' WHEN list_contains(got, 'rtf') THEN 'rtf' END AS preferred FROM h)
SELECT message_key, CAST(len(present) AS INTEGER) AS supported_body_properties, list_aggregate(got, 'string_agg', ',') AS extracted, list_aggregate(un, 'string_agg', ',') AS unresolved, preferred,
 CASE WHEN len(got) > 0 THEN 'body_payload_extracted; payloads=' || len(got) || '; supported_body_properties=' || len(present) || '; body_types=' || list_aggregate(list_sort(got), 'string_agg', ',') || CASE WHEN len(un) > 0 THEN '; preferred_body_type=' || preferred || '; unresolved_body_types=' || list_aggregate(un, 'string_agg', ',') ELSE '' END
 WHEN len(present) > 0 THEN 'body_payload_properties_present_but_unusable; supported_body_properties=' || len(present) ELSE 'body_payload_property_absent; supported_body_properties=0' END AS status FROM j""")  # fmt: skip
def coverage(spark, d):
    flat = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return content.body_coverage(dr.texts(spark, d)).withColumn("extracted", flat("extracted")).withColumn("unresolved", flat("unresolved"))


@query("P11_P15_attachments", tw.with_(tw.RAW_ATTACHMENTS, tw.ATTACHMENTS) + "SELECT * FROM attachments")
def attachments(spark, d):
    return content.attachment_records(dr.attachments(spark, d))


@query("F06_W04_separate_files", tw.with_(tw.RAW_ATTACHMENTS, tw.ATTACHMENTS) + """, n AS (SELECT *, row_number() OVER (PARTITION BY message_key, filename_original2 ORDER BY ordinal) AS k FROM (SELECT *, 'file' || (ordinal % 4) || '.' || coalesce(extension, 'x') AS filename_original2 FROM attachments WHERE extension IS NULL OR extension IN ('sta', 'eco', 'eml')))
SELECT attachment_key, CASE WHEN k = 1 THEN filename_original2 ELSE regexp_extract(filename_original2, '^(.+)\\.', 1) || '_' || lpad(CAST(k AS VARCHAR), 4, '0') || '.' || regexp_extract(filename_original2, '([^.]+)$', 1) END AS unique_name FROM n""")  # fmt: skip
def separate_files(spark, d):
    a = content.attachment_records(dr.attachments(spark, d)).where(content.extension_allowed(F.col("extension"), ["STA", ".eco", "eml"]))
    a = a.withColumn("name", F.concat(F.lit("file"), (F.col("ordinal") % 4).cast("string"), F.lit("."), F.coalesce("extension", F.lit("x"))))
    return content.unique_names(a, "message_key", "name", ["ordinal"]).select("attachment_key", "unique_name")


@query("J06_J19_A07_body_bytes", tw.with_(tw.TEXTS, tw.PAYLOADS) + "SELECT message_key, CAST(sum(octet_length(content)) AS BIGINT) AS bytes FROM payloads GROUP BY message_key")
def body_bytes(spark, d):
    return content.bytes_by_message(content.body_payloads(dr.texts(spark, d)))


@query("P22_K12_contacts", _ITEMS + f"""SELECT {tw.sid('contact', 'message_key')} AS contact_key, 'BEGIN:VCARD' || e || 'VERSION:3.0' || e || 'UID:' || {tw.sid('contact', 'message_key')} || e || coalesce('FN:' || sender_name || e, '') || coalesce('EMAIL;TYPE=SMTP:' || sender_email || e, '')
 || 'X-MAIL-STATUS:' || CASE WHEN coalesce(sender_name, sender_email) IS NULL THEN 'contact_fields_unavailable' ELSE 'contact_partial_source_fields' END || e || 'X-MAIL-AUTHORITATIVE:' || CASE WHEN coalesce(sender_name, sender_email) IS NULL THEN 'false' ELSE 'true' END || e || 'END:VCARD' || e AS vcard
 FROM messages, (SELECT chr(13) || chr(10) AS e) WHERE message_class IN ('IPM.Contact', 'IPM.DistList')""")  # fmt: skip
def contacts(spark, d):
    return typed.vcards(typed.contacts(dr.messages(spark, d)))


@query("P23_K13_calendars", _ITEMS + f"""SELECT {tw.sid('calendar', 'message_key')} AS calendar_key, 'BEGIN:VEVENT' || e || 'UID:' || {tw.sid('calendar-uid', 'message_key')} || e || 'DTSTAMP:19700101T000000Z' || e || 'X-MAIL-DTSTAMP-SYNTHETIC:TRUE' || e || coalesce('SUMMARY:' || replace(replace(subject, ';', chr(92) || ';'), ',', chr(92) || ',') || e, '')
 || coalesce('ORGANIZER;CN=' || sender_name || ':mailto:' || sender_email || e, '') || 'X-MAIL-MESSAGE-CLASS:' || message_class || e || 'X-MAIL-STATUS:' || CASE WHEN coalesce(subject, sender_name, sender_email) IS NULL THEN 'calendar_fields_unavailable' ELSE 'calendar_partial_source_fields' END || e
 || 'X-MAIL-RECURRENCE-STATUS:recurrence_unavailable_source_properties_not_decoded' || e || 'END:VEVENT' || e AS vevent FROM messages, (SELECT chr(13) || chr(10) AS e) WHERE message_class = 'IPM.Appointment'""")  # fmt: skip
def calendars(spark, d):
    return typed.events(typed.calendars(dr.messages(spark, d)))


@query("P24_K14_non_mail", _ITEMS + f""", k AS (SELECT *, coalesce({tw.kind('message_class')}, 'unknown') AS item_kind FROM messages)
SELECT {tw.sid('non-mail', 'message_key')} AS non_mail_key, item_kind, CASE item_kind WHEN 'journal' THEN 'routed_journal' WHEN 'other' THEN 'skipped_unknown_item_class' WHEN 'unknown' THEN 'unavailable_missing_item_class' ELSE 'skipped_unsupported_by_readpst' END AS route_status,
 CASE item_kind WHEN 'journal' THEN CASE WHEN coalesce(subject, sender_name, created_at, modified_at) IS NULL THEN 'journal_fields_unavailable' ELSE 'journal_partial_source_fields' END WHEN 'other' THEN 'unknown_class_preserved' WHEN 'unknown' THEN 'missing_class_preserved' ELSE 'unsupported_by_readpst_preserved' END AS status,
 CASE WHEN ordinal % 4 = 0 THEN 'body_record:b1,body_record:b2,' ELSE '' END || 'message_class:' || coalesce(message_class, '<missing>') || ',message_record:' || message_key AS refs
 FROM k WHERE item_kind IN ('journal', 'task', 'sticky_note', 'other', 'unknown')""")  # fmt: skip
def non_mail(spark, d):
    m = dr.messages(spark, d)
    b = m.where("ordinal % 4 = 0").select("message_key", F.explode(F.array(F.lit("b2"), F.lit("b1"))).alias("body_key"))
    return typed.non_mail(m, b).select("non_mail_key", "item_kind", "route_status", "status", F.array_join("raw_evidence_refs", ",").alias("refs"))


@query("P25_special_items", _ITEMS + f""", f AS (SELECT message_key, lower(coalesce(message_class, '')) AS c, ordinal FROM messages), b AS (SELECT message_key AS bm, ordinal, t AS body_type, CASE WHEN ordinal % 3 <> 0 THEN 'content' || ordinal END AS content FROM messages, unnest(['report', 'text', 'calendar']) u(t) WHERE ordinal % 5 <> 0),
k AS (SELECT message_key, 'report' AS kind, ['report'] AS types, 'report_payload_unavailable' AS absent, 'report_payload_observed_report_type_unavailable' AS st, TRUE AS dec FROM f WHERE c LIKE 'report.%' OR c LIKE '%ndr%'
 UNION ALL SELECT message_key, 'schedule', ['calendar'], 'schedule_payload_unavailable', 'schedule_payload_observed_method_unavailable', TRUE FROM f WHERE c LIKE 'ipm.schedule.%' OR c LIKE '%calendar%' OR c LIKE '%meeting%'
 UNION ALL SELECT message_key, 'encrypted', ['text', 'html', 'rtf'], 'encrypted_body_unavailable', 'encrypted_body_opaque', FALSE FROM f WHERE c LIKE '%encrypted%')
SELECT {tw.sid('special', 'message_key', 'kind', "coalesce('body' || bm || body_type, 'unavailable')")} AS special_key, message_key, kind, coalesce(CAST(length(content) AS BIGINT), 0) AS raw_size_bytes, CASE WHEN dec THEN CAST(length(content) AS BIGINT) END AS decoded_size_bytes,
 CASE WHEN bm IS NULL THEN absent WHEN content IS NULL THEN st || '; source_body_unavailable' ELSE st END AS status, content IS NOT NULL AND dec AS authoritative FROM k LEFT JOIN b ON bm = message_key AND list_contains(types, body_type)""")  # fmt: skip
def special(spark, d):
    m = dr.messages(spark, d)
    b = m.where("ordinal % 5 <> 0").select("message_key", "ordinal", F.explode(F.array(F.lit("report"), F.lit("text"), F.lit("calendar"))).alias("body_type"))
    b = b.select("message_key", F.concat(F.lit("body"), "message_key", "body_type").alias("body_key"), "body_type", F.lit("x").alias("sha256"), F.when(F.col("ordinal") % 3 != 0, F.concat(F.lit("content"), F.col("ordinal").cast("string")).cast("binary")).alias("content"))
    return typed.special_items(m, b).select("special_key", "message_key", "kind", "raw_size_bytes", "decoded_size_bytes", "status", "authoritative")


_ENVELOPES = tw.with_(tw.NBT, tw.CANDIDATES, tw.FOLDERS, tw.MESSAGES, tw.MEMBERS, tw.OWNERS)


@query("P18_P21_F04_R08_items", _ENVELOPES + f""", fo AS (SELECT folder_key AS envelope_key, 'folder' AS record_kind, parent_folder_key AS parent_envelope_key, folder_path, NULL AS item_kind, status || CASE WHEN count(*) OVER (PARTITION BY parent_folder_key, folder_path) > 1 THEN '; folder_path_collision' ELSE '' END AS provenance_status,
  CASE WHEN count(*) OVER (PARTITION BY parent_folder_key, folder_path) > 1 THEN 'failed_folder_path_collision' ELSE 'folder_discovered' END AS extraction_status, 'not_applicable_folder' AS routing_status, (SELECT string_agg(c.folder_key, ',' ORDER BY c.folder_key) FROM folders c WHERE c.parent_folder_key = folders.folder_key) AS children FROM folders),
ca AS (SELECT {tw.sid('msg', "'drv'", tw.node('c.node_id'))} AS envelope_key, o.folder_key AS parent, coalesce(o.folder_path, '') AS fp, {tw.kind('m.message_class')} AS k, o.owner_status, o.outcome, m.extraction_status AS ex, CASE c.message_kind WHEN 'normal_message' THEN 'visible' ELSE 'associated' END AS v
  FROM candidates c JOIN owners o ON c.node_id = o.node_id LEFT JOIN messages m ON m.message_node_id = {tw.node('c.node_id')} WHERE c.ordinal % 2 = 0),
ot AS (SELECT {tw.sid('item', "'drv'", tw.node('node_id'))} AS envelope_key FROM nbt WHERE node_id & 31 NOT IN (2, 3, 4, 8, 13, 14, 15, 16)),
re AS (SELECT message_key, folder_key, folder_path, {tw.kind('message_class')} AS k, extraction_status FROM messages WHERE message_key NOT IN (SELECT envelope_key FROM ca))
SELECT * FROM fo UNION ALL SELECT envelope_key, 'item', parent, fp, coalesce(k, 'other'), owner_status, CASE outcome WHEN 'resolved' THEN ex WHEN 'ambiguous' THEN 'unavailable_ambiguous_owner' ELSE 'unavailable_unresolved_owner' END, {tw.route('k', 'v')}, NULL FROM ca
UNION ALL SELECT envelope_key, 'item', NULL, '', 'other', 'source_nbt_entry_not_message_or_folder', 'skipped_unclassified_source_entry', 'unavailable_unclassified_source_entry', NULL FROM ot
UNION ALL SELECT message_key, 'item', folder_key, folder_path, coalesce(k, 'other'), 'message_record_source', CASE WHEN k IS NULL THEN 'unavailable_missing_item_class' ELSE extraction_status END, {tw.route('k', "'visible'")}, NULL FROM re""")  # fmt: skip
def items(spark, d):
    f, m, n = dr.folders(spark, d), dr.messages(spark, d), dr.nbt(spark, d)
    c = dr.candidates(spark, d)
    known = ownership.resolved_owners(c, dr.memberships(spark, d))
    some = envelopes.of_candidates(c.where("ordinal % 2 = 0"), known, m, dr.ARCHIVE)
    out = envelopes.of_folders(f).unionByName(some).unionByName(envelopes.of_other_nodes(n, dr.ARCHIVE)).unionByName(envelopes.of_residual_messages(m, some))
    out = envelopes.related_folders(envelopes.rekeyed(out))
    kids = F.when(F.size("child_envelope_keys") > 0, F.array_join("child_envelope_keys", ","))
    return out.select("envelope_key", "record_kind", "parent_envelope_key", "folder_path", "item_kind", "provenance_status", "extraction_status", "routing_status", kids.alias("children"))


@query("W05_first_wins", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS turn FROM lineitem")
def first_wins(spark, d):
    li = dr.table(spark, d, "lineitem")
    out = ownership.first_wins(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("turn").cast("bigint").alias("turn"))


@query("J10_X24_X25_header_lists", tw.with_(tw.RECIPIENTS) + """SELECT order_key, string_agg(CASE WHEN role = 'to' THEN a END, ', ' ORDER BY n) AS to_list, string_agg(CASE WHEN role = 'cc' THEN a END, ', ' ORDER BY n) AS cc_list, count(*) AS recipients
 FROM (SELECT *, CASE WHEN display_name IS NULL THEN coalesce(smtp_address, raw_address) ELSE display_name || ' <' || coalesce(smtp_address, raw_address) || '>' END AS a FROM recipients) GROUP BY order_key""")  # fmt: skip
def header_lists(spark, d):
    r = dr.recipients(spark, d).withColumn("a", tx.format_address(F.col("display_name"), F.coalesce("smtp_address", "raw_address")))
    listed = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("n", "a")))), lambda x: x["a"]), ", ")
    out = r.groupBy("order_key").agg(listed("to").alias("to_list"), listed("cc").alias("cc_list"), F.count("*").alias("recipients"))
    return out.select("order_key", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("to_list", "cc_list")], "recipients")


@query("R02_embedded_depths", tw.with_(tw.LINKS, "walk(node, depth) AS (SELECT event_id, 0 FROM events WHERE event_id NOT IN (SELECT child FROM links) UNION SELECT child, depth + 1 FROM walk JOIN links ON node = parent WHERE depth < 9)", recursive=True) + "SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def depths(spark, d):
    return graph.depths(dr.table(spark, d, "events").select(F.col("event_id").alias("node")), dr.links(spark, d))


@query("R03_embedded_cycles", tw.with_(tw.LINKS, "walk(parent, child, spot) AS (SELECT parent, child, child FROM links UNION SELECT w.parent, w.child, l.child FROM walk w JOIN links l ON w.spot = l.parent WHERE w.spot <> w.parent)", recursive=True) + "SELECT DISTINCT parent, child FROM walk WHERE spot = parent")
def cycles(spark, d):
    return graph.on_cycles(dr.links(spark, d))


@query("P32_triage", tw.with_(tw.OBSERVED) + """SELECT message_key, tables + compact + utf16_compact + child_references AS supported, CAST(missing_payloads AS BIGINT) AS partial, CAST(unsupported + parse_errors AS BIGINT) AS unsupported, CAST((unsupported > 0) AS INTEGER) + CAST((parse_errors > 0) AS INTEGER) + CAST((missing_payloads > 0) AS INTEGER) AS follow_ups,
 CASE WHEN blocks = 0 AND subnode_blocks = 0 THEN 'observed_layouts_empty' WHEN unsupported + parse_errors > 0 THEN 'observed_layouts_need_parser_triage' WHEN missing_payloads > 0 THEN 'observed_layouts_need_payload_triage' ELSE 'observed_layouts_supported' END AS status FROM observed""")  # fmt: skip
def triage(spark, d):
    return batch.triage(dr.observed(spark, d)).select("message_key", "supported", "partial", "unsupported", "follow_ups", "status")


@query("A05_L06_backlog_review", tw.with_(tw.OBSERVED) + """SELECT count(*) AS total_items, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority NOT IN ('high', 'medium')) AS low, count(*) FILTER (backlog_status = 'payload_mapping_backlog_open') AS payload_mapping,
 count(DISTINCT candidate_key) AS unique_candidates, (SELECT candidate_key FROM items ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, candidate_key LIMIT 1) AS top_candidate_key, CASE WHEN count(*) = 0 THEN 'decoder_backlog_review_empty' WHEN count(*) FILTER (priority = 'high') > 0 THEN 'decoder_backlog_review_high_priority_open' ELSE 'decoder_backlog_review_medium_priority_open' END AS review_status FROM items""")  # fmt: skip
def review(spark, d):
    return batch.review(batch.backlog(batch.triage(dr.observed(spark, d))))


@query("A06_W06_selection", tw.with_(tw.OBSERVED) + """, g AS (SELECT candidate_key, min(category) AS category, min(priority) AS priority, min(backlog_status) AS backlog_status, count(DISTINCT message_key) AS affected_messages, CAST(sum(observed_count) AS BIGINT) AS observed_total, count(*) AS source_items FROM items GROUP BY candidate_key)
SELECT *, CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, observed_total DESC, affected_messages DESC, candidate_key) AS INTEGER) AS selection_rank FROM g""")  # fmt: skip
def selection(spark, d):
    return batch.selection(batch.issue_candidates(batch.backlog(batch.triage(dr.observed(spark, d)))))


@query("A03_A04_batch_counters", tw.with_(tw.RUNS) + """, c AS (SELECT CAST(1000000 AS BIGINT) AS discovered, count(*) FILTER (status NOT LIKE 'skipped%') AS attempted, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'partial_success') AS partial, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status LIKE 'skipped%') AS skipped, greatest(1000000 - count(*), 0) AS not_run FROM runs)
SELECT *, CASE WHEN failed > 0 THEN 'completed_with_failures' ELSE 'failed_stopped_early' END AS batch_status FROM c""")  # fmt: skip
def batch_counters(spark, d):
    return batch.counters(dr.runs(spark, d), F.lit(1000000)).withColumn("batch_status", batch.batch_status())


@query("W08_progress", tw.with_(tw.RUNS) + """SELECT event_id, user_id, status, count(*) OVER w AS seen, count(*) FILTER (status = 'completed') OVER w AS completed, count(*) FILTER (status = 'failed') OVER w AS failed, count(*) FILTER (status LIKE 'skipped%') OVER w AS skipped FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def progress(spark, d):
    return batch.progress(dr.runs(spark, d), "user_id", ["event_id"])


@query("M03_resume", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume(spark, d):
    return batch.to_run(dr.table(spark, d, "orders").select("o_orderkey"), dr.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("F16_L05_bounded", "SELECT event_id, user_id, CAST(k AS INTEGER) AS k, CASE WHEN n > 3 AND k = 3 THEN n - 3 END AS omitted FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 3")
def bounded(spark, d):
    return batch.bounded(dr.table(spark, d, "events").select("event_id", "user_id"), "user_id", ["event_id"], 3)


_TALK = r"""talk AS (SELECT '/box/' || (conv_id % 7) AS folder_path, 'c' || lpad(CAST(conv_id AS VARCHAR), 7, '0') || lpad(CAST(turn AS VARCHAR), 4, '0') AS message_key, CASE WHEN turn % 3 <> 0 THEN role || '@mail.example' END AS sender, CASE WHEN turn % 2 = 0 THEN 'Thu, 01 Jan 1970 00:00:00 +0000' END AS date,
 CASE WHEN turn % 4 = 0 THEN 'From: a' || chr(10) || 'From here' || chr(13) || chr(10) || '>From there ' || text ELSE text END AS content FROM conversations)"""


def _talk(spark, d):
    c = dr.table(spark, d, "conversations")
    t = F.col("turn")
    key = F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 7, "0"), F.lpad(t.cast("string"), 4, "0"))
    return c.select(
        F.concat(F.lit("/box/"), (F.col("conv_id") % 7).cast("string")).alias("folder_path"), key.alias("message_key"), F.when(t % 3 != 0, F.concat("role", F.lit("@mail.example"))).alias("sender"),
        F.when(t % 2 == 0, "Thu, 01 Jan 1970 00:00:00 +0000").alias("date"), F.when(t % 4 == 0, F.concat(F.lit("From: a\nFrom here\r\n>From there "), "text")).otherwise(F.col("text")).alias("content"),
    )


@query("K04_mbox_folders", tw.with_(_TALK) + r""", q AS (SELECT *, regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '(?m)^(>*From )', '>\1', 'g') AS m FROM talk)
SELECT folder_path, count(*) AS messages, string_agg('From ' || coalesce(sender, 'MAILER-DAEMON') || ' ' || coalesce(date, 'Thu Jan 1 00:00:00 1970') || chr(10) || m || CASE WHEN m LIKE '%' || chr(10) THEN '' ELSE chr(10) END || chr(10), '' ORDER BY message_key) AS mbox FROM q GROUP BY folder_path""")  # fmt: skip
def mbox(spark, d):
    return sinks.mbox_folders(_talk(spark, d))


@query("K08_F13_plain_eml", tw.with_(_TALK) + r""", e AS (SELECT message_key, sender, date, replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10)) AS body FROM talk), n AS (SELECT chr(13) || chr(10) AS n)
SELECT message_key, CASE WHEN sender IS NOT NULL AND date IS NOT NULL THEN 'From: Talk <' || sender || '>' || n || 'To: all@mail.example' || n || 'Subject: about ' || message_key || n || 'Date: ' || date || n || 'MIME-Version: 1.0' || n || 'Content-Type: text/plain; charset=utf-8' || n || 'Content-Transfer-Encoding: 8bit' || n || n || body || CASE WHEN body LIKE '%' || n THEN '' ELSE n END END AS eml FROM e, n""")  # fmt: skip
def plain_eml(spark, d):
    t = _talk(spark, d)
    return sinks.plain_eml(t.select("message_key", F.concat(F.lit("about "), "message_key").alias("subject"), F.lit("Talk").alias("sender_name"), F.col("sender").alias("sender_address"), F.lit("all@mail.example").alias("to_list"), F.lit(None).cast("string").alias("cc_list"), "date", F.lit(None).cast("string").alias("message_id"), F.col("content").alias("text")))


@query("K05_W02_numbered", tw.with_(_TALK) + "SELECT folder_path, message_key, row_number() OVER (PARTITION BY folder_path ORDER BY message_key) || '.eml' AS file_name FROM talk")
def numbered(spark, d):
    return sinks.numbered(_talk(spark, d), suffix=".eml").select("folder_path", "message_key", "file_name")


@query("K10_sidecars", tw.with_(_TALK) + "SELECT folder_path, count(*) || ' ' || CASE WHEN folder_path < '/box/5' THEN 11 ELSE count(*) END || chr(10) AS size_line FROM talk GROUP BY folder_path")
def sidecars(spark, d):
    t = _talk(spark, d)
    return sinks.sidecars(t, t.where("folder_path < '/box/5'").select("folder_path", F.lit(11).alias("item_count")).distinct())


@query("W03_X16_folder_directories", tw.with_(tw.FOLDERS) + ", s AS (SELECT folder_key, folder_path, trim(folder_path, '/') AS safe FROM folders), n AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY folder_path, folder_key) AS k FROM s) SELECT folder_key, safe || CASE WHEN k > 1 THEN '_' || lpad(CAST(k AS VARCHAR), 4, '0') ELSE '' END AS directory FROM n")
def directories(spark, d):
    return sinks.folder_directories(dr.folders(spark, d)).select("folder_key", "directory")


@query("P01_message_projection", tw.with_(tw.NBT) + f"""SELECT {tw.sid('msg', "'drv'", tw.node('node_id'))} AS message_key, CASE WHEN ordinal % 5 <> 0 THEN 'IPM.Note' || ordinal % 3 END AS message_class, CASE WHEN ordinal % 5 <> 0 AND ordinal % 2 = 0 THEN 'Subject ' || ordinal WHEN ordinal % 5 <> 0 AND ordinal % 3 = 0 THEN 'Old ' || ordinal END AS subject,
 CASE WHEN ordinal % 5 <> 0 THEN 'message_metadata' ELSE 'message_candidate' END AS item_type FROM nbt WHERE node_id & 31 IN (4, 8)""")  # fmt: skip
def message_projection(spark, d):
    n = dr.nbt(spark, d)
    o = F.col("ordinal")
    p = lambda tag, text, cond: F.when(cond, F.struct(F.lit(tag).cast("bigint").alias("tag"), text.alias("text")))
    parts = F.array_compact(F.array(p(0x001A001E, F.concat(F.lit("IPM.Note"), (o % 3).cast("string")), F.lit(True)), p(0x0037001F, F.concat(F.lit("Subject "), o.cast("string")), o % 2 == 0), p(0x0037001E, F.concat(F.lit("Old "), o.cast("string")), o % 3 == 0)))
    props = n.where("ordinal % 5 <> 0").select("node_id", F.inline(parts))
    return families.message_rows(n, props, dr.ARCHIVE).select("message_key", "message_class", "subject", "item_type")


@query("P04_P05_folder_projection", tw.with_(tw.NBT) + f""", f AS (SELECT {tw.node('node_id')} AS id, ordinal, CASE WHEN ordinal % 4 <> 0 THEN 'Box/' || ordinal ELSE {tw.node('node_id')} END AS name FROM nbt WHERE node_id & 31 IN (2, 3))
SELECT {tw.sid('folder', "'drv'", 'id')} AS folder_key, {tw.sid('folder', "'drv'", "'root'")} AS parent_folder_key, name, '/' || replace(name, '/', '_') AS folder_path FROM f UNION ALL SELECT {tw.sid('folder', "'drv'", "'root'")}, NULL, 'root', '/'""")  # fmt: skip
def folder_projection(spark, d):
    n = dr.nbt(spark, d)
    names = n.select("node_id", F.when(F.col("ordinal") % 4 == 0, "  ").otherwise(F.concat(F.lit(" Box/"), F.col("ordinal").cast("string"))).alias("display_name"))
    return families.folder_rows(n, names, dr.ARCHIVE).select("folder_key", "parent_folder_key", "name", "folder_path")


@query("P16_J17_table_recipients", f"""WITH r AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS roles, list('P' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS names FROM lineitem GROUP BY l_orderkey HAVING count(*) % 4 <> 0),
x AS (SELECT 'm' || l_orderkey AS message_key, unnest(roles) AS code, unnest(names) AS display_name, CAST(generate_subscripts(roles, 1) - 1 AS INTEGER) AS ordinal FROM r), y AS (SELECT *, CASE code WHEN 0 THEN 'originator' WHEN 1 THEN 'to' WHEN 2 THEN 'cc' WHEN 3 THEN 'bcc' ELSE 'unknown' END AS recipient_type FROM x)
SELECT message_key, {tw.sid('rcpt', 'message_key', 'recipient_type', 'ordinal')} AS recipient_key, recipient_type, display_name, ordinal, 'raw_address_preserved' AS status FROM y""")  # fmt: skip
def table_recipients(spark, d):
    li = dr.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    none, some = F.transform("x", lambda r: F.lit(None).cast("string")), F.transform("x", lambda r: F.lit("raw"))
    t = li.select(F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("message_key"), F.transform("x", lambda r: r["l_linenumber"]).alias("roles"), F.transform("x", lambda r: F.concat(F.lit("P"), r["l_partkey"].cast("string"))).alias("names"), none.alias("smtp"), F.when(F.size("x") % 4 != 0, some).otherwise(F.array().cast("array<string>")).alias("raw"))
    return families.recipient_rows(t).select("message_key", "recipient_key", "recipient_type", "display_name", "ordinal", "status")


@query("P27_X37_property_evidence", f"SELECT {tw.sid('evidence', chr(39) + 'drv' + chr(39), tw.node('page_id'), '26')} AS evidence_key, page_id AS node_id, CAST(octet_length(encode(html)) AS BIGINT) AS raw_size, sha256(html) AS raw_sha256, lower(substr(hex(encode(html)), 1, 131072)) AS raw_hex FROM pages")
def evidence(spark, d):
    p = dr.table(spark, d, "pages").select(F.col("page_id").alias("node_id"), F.lit(26).alias("tag"), F.col("html").cast("binary").alias("raw"), F.lit("x").alias("status"))
    return families.property_evidence(p, dr.ARCHIVE).select("evidence_key", "node_id", "raw_size", "raw_sha256", "raw_hex")


@query("P28_P29_U01_manifest", tw.with_(tw.TEXTS, tw.PAYLOADS, tw.BODIES) + """SELECT archive_path AS artifact, 'payload' AS kind, CAST(1 AS BIGINT) AS records, size_bytes, sha256 FROM bodies UNION ALL SELECT 'metadata/bodies.jsonl', 'family', count(*), NULL, NULL FROM bodies UNION ALL SELECT 'metadata/errors.jsonl', 'family', CAST(0 AS BIGINT), NULL, NULL
 UNION ALL SELECT 'metadata/evidence.jsonl', 'family', (SELECT count(*) FROM bodies) + (SELECT count(*) FROM part), NULL, NULL""")  # fmt: skip
def manifest(spark, d):
    b = content.body_records(content.body_payloads(dr.texts(spark, d)))
    a = content.attachment_records(dr.attachments(spark, d))
    ev = families.derived_evidence({"body": (b, "body_key"), "attachment": (a, "attachment_key")})
    return families.manifest({"bodies": b, "errors": b.where("false"), "contacts": b.where("false"), "evidence": ev}, b, always=("bodies", "errors"))


@query("R01_R04_R05_embedded_edges", tw.with_(
    "a AS (SELECT event_id, 'm' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS message_key, 'a' || (CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id END) AS attachment_key, CASE WHEN event_id % 10 <> 3 THEN 'm' || lpad(CAST(event_id // 2 AS VARCHAR), 8, '0') END AS child FROM events WHERE event_id % 2 = 1 OR event_id % 97 = 0)",
    "m AS (SELECT 'm' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS k, CASE WHEN event_id % 13 = 0 THEN 'other' ELSE 'message_metadata' END AS t FROM events WHERE event_id % 11 <> 5)",
    "walk(node, depth) AS (SELECT k, 0 FROM m WHERE k NOT IN (SELECT child FROM a WHERE child IS NOT NULL) UNION SELECT child, depth + 1 FROM walk JOIN a ON node = message_key WHERE depth < 9 AND child IS NOT NULL)", recursive=True)
    + f""", d AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), j AS (SELECT a.*, coalesce(d.depth, 0) AS depth, m.k IS NOT NULL AS ex, coalesce(m.t = 'message_metadata', FALSE) AS mail, count(*) OVER (PARTITION BY attachment_key) > 1 AS dup, CASE WHEN m.k IS NULL AND child IS NULL THEN 0 ELSE CASE WHEN event_id // 2 % 3 = 0 AND child IS NOT NULL THEN 70000000 ELSE 0 END END AS bytes, (SELECT count(*) FROM m) AS nodes, child = message_key AS selfy FROM a LEFT JOIN m ON child = k LEFT JOIN d ON child = node),
s AS (SELECT *, CASE WHEN nodes > 4096 THEN 'node_budget_exceeded' WHEN bytes > 67108864 THEN 'byte_budget_exceeded' WHEN depth > 8 THEN 'depth_budget_exceeded' ELSE 'within_limits' END AS budget_status, CASE WHEN child IS NULL THEN 'missing_child_reference' WHEN NOT ex THEN 'child_message_unavailable' WHEN NOT mail THEN 'child_non_email_item' WHEN dup THEN 'duplicate_attachment_owner' ELSE 'child_message_resolved' END AS resolution_status, CASE WHEN selfy THEN 'cycle_detected' ELSE 'acyclic' END AS cycle_status FROM j)
SELECT {tw.sid('edge', 'message_key', 'attachment_key')} AS edge_key, child AS child_message_key, depth, CAST(bytes AS BIGINT) AS raw_bytes_observed, budget_status, cycle_status, resolution_status,
 CASE WHEN ex AND cycle_status = 'acyclic' AND budget_status = 'within_limits' AND resolution_status = 'child_message_resolved' THEN 'embedded_child_resolved' WHEN cycle_status = 'cycle_detected' THEN 'embedded_child_cycle_rejected' WHEN budget_status <> 'within_limits' THEN 'embedded_child_budget_rejected' ELSE 'embedded_child_unavailable' END AS status FROM s""")  # fmt: skip
def embedded_edges(spark, d):
    e = dr.table(spark, d, "events").select("event_id")
    k = F.col("event_id")
    name = lambda n: F.concat(F.lit("m"), F.lpad(n.cast("string"), 8, "0"))
    half = F.call_function("div", k, F.lit(2))
    a = e.where("event_id % 2 = 1 or event_id % 97 = 0").select(name(k).alias("message_key"), F.concat(F.lit("a"), F.when(k % 97 == 0, 0).otherwise(k).cast("string")).alias("attachment_key"), k.alias("ordinal"), F.lit(5).alias("attachment_method"), F.when(k % 10 != 3, name(half)).alias("embedded_key"))
    m = e.where("event_id % 11 <> 5").select(name(k).alias("message_key"), F.when(k % 13 == 0, "other").otherwise("message_metadata").alias("item_type"))
    sizes = e.select(name(k).alias("message_key"), F.when(k % 3 == 0, 70000000).otherwise(0).cast("bigint").alias("bytes"))
    cyc = graph.on_cycles(a.select(F.col("message_key").alias("parent"), F.col("embedded_key").alias("child")))
    return graph.embedded_edges(m, a, sizes, cyc).select("edge_key", "child_message_key", "depth", "raw_bytes_observed", "budget_status", "cycle_status", "resolution_status", "status")


@query("W11_shards", tw.with_("f AS (SELECT source AS g, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)",
    "fold(g, k, path, size, used, shard) AS (SELECT g, k, path, size, size, 0 FROM f WHERE k = 1 UNION ALL SELECT f.g, f.k, f.path, f.size, CASE WHEN used > 0 AND used + f.size > 20000 THEN f.size ELSE used + f.size END, shard + CASE WHEN used > 0 AND used + f.size > 20000 THEN 1 ELSE 0 END FROM fold JOIN f ON f.g = fold.g AND f.k = fold.k + 1)", recursive=True)
    + "SELECT g AS source, path, size, CAST(shard AS INTEGER) AS shard FROM fold")
def shards(spark, d):
    f = dr.table(spark, d, "documents").select("source", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("n_chars").alias("size"))
    return sinks.shards(f, 20000, "source")


@query("F14_attachment_sets", "SELECT l_orderkey, bool_and(l_quantity > 2) AND coalesce(min(step) > 0, TRUE) AS valid FROM (SELECT l_orderkey, l_quantity, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS step FROM lineitem) GROUP BY l_orderkey")
def attachment_sets(spark, d):
    li = dr.table(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 2)
    return ownership.rising_sets(li, "l_orderkey", "l_linenumber", ["l_linenumber", "l_partkey", "l_suppkey"], "ok")


_STATUS = "'x=1; plausible:' || (event_id % 3) || ', suspicious:' || (event_id % 2) || '; heap_bth=' || (user_id % 2)"


@query("A10_A11_A12_A17_blockers", f"""WITH s AS (SELECT user_id, sum(event_id % 3) AS plausible, sum(event_id % 2) AS suspicious, sum(user_id % 2) AS heap_bth FROM events GROUP BY user_id) SELECT user_id, CASE WHEN suspicious > plausible THEN 'heap_bth_layout_traversal' WHEN plausible > 0 THEN 'selected_mapi_dictionary_expansion' ELSE 'property_context_signal_absent' END AS tag_shape,
 CASE WHEN heap_bth > 0 THEN 'heap_bth_index_or_external_hnid_resolution' ELSE 'property_context_traversal_signal_absent' END AS traversal, (SELECT CAST(sum(plausible) AS BIGINT) FROM s) AS total FROM s""")  # fmt: skip
def run_blockers(spark, d):
    e = dr.table(spark, d, "events")
    text = lambda x: x.cast("string")
    k, u = F.col("event_id"), F.col("user_id")
    e = e.select("user_id", F.concat(F.lit("x=1; plausible:"), text(k % 3), F.lit(", suspicious:"), text(k % 2), F.lit("; heap_bth="), text(u % 2)).alias("status"))
    sums = [F.sum(tx.status_counter(F.col("status"), c)).alias(c) for c in ("plausible", "suspicious", "heap_bth")]
    zero = {c: F.lit(0) for c in ("legacy_flat", "unknown_traversal")}
    by = e.groupBy("user_id").agg(*sums).withColumns(zero)
    rungs = reports.blockers()
    total = reports.status_sums(e, ["plausible"]).withColumnRenamed("plausible", "total")
    return by.select("user_id", rungs["tag_shape"].alias("tag_shape"), rungs["traversal"].alias("traversal")).crossJoin(F.broadcast(total))


_COLUMNS = """c AS (SELECT l_orderkey AS t, (CASE l_linenumber % 4 WHEN 0 THEN 872480771 WHEN 1 THEN 202702851 WHEN 2 THEN 972947487 ELSE 1743912963 END) AS tag, CAST(l_linenumber AS INTEGER) AS bit, list('v' || (l_partkey % 3)) AS vals, bool_and(l_quantity > 1) AS every FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _columns(spark, d):
    li = dr.table(spark, d, "lineitem")
    n = F.col("l_linenumber") % 4
    tag = F.when(n == 0, 872480771).when(n == 1, 202702851).when(n == 2, 972947487).otherwise(1743912963).cast("bigint")
    g = li.groupBy(F.col("l_orderkey").alias("table"), tag.alias("tag"), F.col("l_linenumber").alias("bit"))
    return g.agg(F.collect_list(F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string"))).alias("values"), F.collect_list(F.col("l_quantity") > 1).alias("mask")).withColumn("size", F.lit(4))


@query("W09_W10_A14_F10_F11_columns", tw.with_(_COLUMNS) + """, f AS (SELECT *, len(list_distinct(vals)) AS dv, row_number() OVER (PARTITION BY t ORDER BY len(list_distinct(vals)) DESC, bit) AS k FROM c WHERE every AND tag & 65535 = 3), i AS (SELECT t, arg_min(tag, bit) AS identity_tag FROM c WHERE every AND tag = 972947487 GROUP BY t),
 r AS (SELECT t, count(*) AS readable FROM c WHERE tag <> 1743912963 GROUP BY t)
 SELECT r.t AS "table", CAST(f.tag AS BIGINT) AS fixed_tag, f.bit AS fixed_bit, CAST(f.dv AS INTEGER) AS distinct_values, CAST(identity_tag AS BIGINT) AS identity_tag, readable FROM r LEFT JOIN f ON r.t = f.t AND f.k = 1 LEFT JOIN i ON r.t = i.t""")  # fmt: skip
def columns(spark, d):
    c = _columns(spark, d)
    fixed = reports.best_fixed_column(c).select("table", F.col("tag").alias("fixed_tag"), F.col("bit").alias("fixed_bit"), "distinct_values")
    named = reports.best_identity_column(c).select("table", F.col("tag").alias("identity_tag"))
    readable = reports.readable_columns(c).groupBy("table").agg(F.count("*").alias("readable"))
    return readable.join(fixed, "table", "left").join(named, "table", "left")


@query("K06_A13_attachment_decisions", tw.with_(tw.RAW_ATTACHMENTS, tw.ATTACHMENTS) + """, d AS (SELECT a.message_key, CASE WHEN extension IS NOT NULL AND extension NOT IN ('sta', 'eco') THEN 'filtered_attachment_extension' WHEN attachment_method = 5 THEN 'skipped_embedded_message_attachment' WHEN a.extraction_status <> 'extracted' THEN 'unavailable_attachment_payload' ELSE 'attachment_file_emitted' END AS decision FROM attachments a)
 SELECT message_key, count(*) AS attachments, count(*) FILTER (decision = 'attachment_file_emitted') AS emitted, CASE WHEN count(*) FILTER (decision = 'attachment_file_emitted') = 0 THEN 'mail_records_unavailable' WHEN count(*) FILTER (decision <> 'attachment_file_emitted') > 0 THEN 'mail_projection_partial' ELSE 'mail_projection_available' END AS status FROM d GROUP BY message_key""")  # fmt: skip
def decisions(spark, d):
    raw = dr.attachments(spark, d)
    a = content.attachment_records(raw).join(raw.select("message_key", "ordinal", "content"), ["message_key", "ordinal"])
    x = reports.attachment_decisions(a, ["sta", "eco"])
    done = F.count_if(F.col("decision") == "attachment_file_emitted")
    g = x.groupBy("message_key").agg(F.count("*").alias("attachments"), done.alias("emitted"))
    return g.withColumn("status", reports.profile_status(F.col("attachments"), F.col("emitted"), F.col("attachments") - F.col("emitted")))


@query("J09_materialized_children", tw.with_(
    "a AS (SELECT 'a' || event_id AS attachment_key, 'p' || event_id AS message_key, 'c' || (event_id % 700) AS child FROM events WHERE event_id % 2 = 0)",
    "m AS (SELECT 'c' || event_id AS k FROM events WHERE event_id < 700 UNION ALL SELECT 'c' || event_id FROM events WHERE event_id % 5 = 0 AND event_id < 700)",
    "b AS (SELECT 'c' || event_id AS k FROM events WHERE event_id % 3 <> 0 AND event_id < 700)")
    + """, u AS (SELECT child FROM a GROUP BY child HAVING count(*) = 1), um AS (SELECT k FROM m GROUP BY k HAVING count(*) = 1) SELECT attachment_key, child AS message_key, CAST(length('mail of ' || child) AS BIGINT) AS size_bytes, sha256('mail of ' || child) AS sha256, CASE WHEN length('mail of ' || child) = 11 THEN 'size_matched' ELSE 'size_mismatch' END AS size_status FROM a WHERE child IN (SELECT child FROM u) AND child IN (SELECT k FROM um) AND child IN (SELECT k FROM b)""")
def children(spark, d):
    e = dr.table(spark, d, "events").select("event_id")
    k = F.col("event_id")
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    a = e.where("event_id % 2 = 0").select(name("a", k).alias("attachment_key"), name("p", k).alias("message_key"), name("c", k % 700).alias("embedded_key"), F.lit(5).alias("attachment_method"), F.lit(11).cast("bigint").alias("declared_size_bytes"))
    low = e.where("event_id < 700").select(k, name("c", k).alias("message_key"))
    m = low.unionByName(low.where("event_id % 5 = 0"))
    b = low.where("event_id % 3 <> 0").withColumn("body_type", F.lit("text"))
    emls = low.select("message_key", F.concat(F.lit("mail of "), "message_key").alias("eml"))
    return reports.materialized_children(a, m, b, emls).drop("eml")


@query("J09_children_whole", tw.with_(
    "a AS (SELECT 'a' || (CASE WHEN event_id % 97 = 0 THEN event_id - 1 ELSE event_id END) AS attachment_key, (CASE WHEN event_id % 9 = 0 THEN 'c' ELSE 'p' END) || event_id AS message_key, 'c' || (CASE WHEN event_id % 10 = 3 THEN event_id - 1 ELSE event_id END) AS child, CASE WHEN event_id % 4 = 1 THEN 11 ELSE length('mail of c' || event_id) END AS declared FROM events)",
    "m AS (SELECT 'c' || event_id AS k FROM events WHERE event_id % 7 <> 1 UNION ALL SELECT 'c' || event_id FROM events WHERE event_id % 5 = 0)",
    "b AS (SELECT 'c' || event_id AS k FROM events WHERE event_id % 3 <> 0)",
    "e AS (SELECT 'c' || event_id AS k FROM events WHERE event_id % 11 <> 4)")
    + """, u AS (SELECT child FROM a GROUP BY child HAVING count(*) = 1), ua AS (SELECT attachment_key FROM a GROUP BY attachment_key HAVING count(*) = 1), um AS (SELECT k FROM m GROUP BY k HAVING count(*) = 1) SELECT attachment_key, child AS message_key, CAST(length('mail of ' || child) AS BIGINT) AS size_bytes, sha256('mail of ' || child) AS sha256, CASE WHEN length('mail of ' || child) = declared THEN 'size_matched' ELSE 'size_mismatch' END AS size_status
 FROM a WHERE child IN (SELECT child FROM u) AND attachment_key IN (SELECT attachment_key FROM ua) AND child IN (SELECT k FROM um) AND child IN (SELECT k FROM b) AND child IN (SELECT k FROM e) AND child NOT IN (SELECT message_key FROM a)""")  # fmt: skip
def children_whole(spark, d):
    """J09 over every event: gaps and duplicates are shares of the ids, so that rows grow with the table."""
    e = dr.table(spark, d, "events").select("event_id")
    k = F.col("event_id")
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    mail = lambda key: F.concat(F.lit("mail of "), key)
    owner = F.when(k % 9 == 0, name("c", k)).otherwise(name("p", k))
    declared = F.when(k % 4 == 1, 11).otherwise(F.length(mail(name("c", k)))).cast("bigint")
    a = e.select(name("a", F.when(k % 97 == 0, k - 1).otherwise(k)).alias("attachment_key"), owner.alias("message_key"), name("c", F.when(k % 10 == 3, k - 1).otherwise(k)).alias("embedded_key"), F.lit(5).alias("attachment_method"), declared.alias("declared_size_bytes"))
    c = e.select(k, name("c", k).alias("message_key"))
    m = c.where("event_id % 7 <> 1").unionByName(c.where("event_id % 5 = 0"))
    b = c.where("event_id % 3 <> 0").withColumn("body_type", F.lit("text"))
    emls = c.where("event_id % 11 <> 4").select("message_key", mail(F.col("message_key")).alias("eml"))
    return reports.materialized_children(a, m, b, emls).drop("eml")
