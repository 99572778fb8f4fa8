"""DuckDB SQL for the fixtures of driver.py and for the shared formulas, written independently."""

from __future__ import annotations


def sid(prefix: str, *parts: str) -> str:
    closed = " || ".join(f"coalesce(CAST({p} AS VARCHAR), '') || chr(31)" for p in parts)
    return f"('{prefix}_' || substr(sha256({closed}), 1, 16))"


def node(n: str) -> str:
    return f"('node_' || lower(to_hex({n})))"


KIND = """(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN NULL
 WHEN lower(trim({c})) = 'ipm.note' OR lower(trim({c})) LIKE 'ipm.note.%' THEN 'note'
 WHEN lower(trim({c})) LIKE 'ipm.schedule.meeting.%' THEN 'schedule'
 WHEN lower(trim({c})) = 'ipm.appointment' OR lower(trim({c})) LIKE 'ipm.appointment.%' THEN 'appointment'
 WHEN lower(trim({c})) = 'ipm.contact' OR lower(trim({c})) LIKE 'ipm.contact.%' THEN 'contact'
 WHEN regexp_matches(lower(trim({c})), '^ipm\\.(journal|activity)(\\.|$)') THEN 'journal'
 WHEN regexp_matches(lower(trim({c})), '^ipm\\.stickynote(\\.|$)') THEN 'sticky_note'
 WHEN regexp_matches(lower(trim({c})), '^ipm\\.task(\\.|$)') THEN 'task'
 WHEN regexp_matches(lower(trim({c})), '^report[./]') THEN 'report' ELSE 'other' END)"""


def kind(c: str) -> str:
    return KIND.format(c=c)


def confidence(k: str) -> str:
    return f"(CASE WHEN {k} IS NULL THEN 'message_class_missing' WHEN {k} = 'other' THEN 'message_class_unknown' ELSE 'message_class_normalized' END)"


def route(k: str, v: str, only: str | None = None) -> str:
    extra = f"WHEN {k} NOT IN ({only}) THEN 'filtered_item_type' " if only else ""
    return f"""(CASE WHEN {v} = 'deleted' THEN 'filtered_deleted' WHEN {v} = 'associated' THEN 'filtered_associated' WHEN {v} = 'unknown' THEN 'unavailable_unknown_visibility'
 WHEN {k} IS NULL THEN 'unavailable_missing_item_class' WHEN {k} IN ('task', 'sticky_note') THEN 'skipped_unsupported_by_readpst' WHEN {k} = 'other' THEN 'skipped_unknown_item_class' {extra}
 WHEN {k} = 'note' THEN 'routed_email' WHEN {k} = 'schedule' THEN 'routed_schedule_email' ELSE 'routed_' || {k} END)"""


CODE = "(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 8 WHEN '3' THEN 2 WHEN '4' THEN 14 ELSE 31 END)"
CLASS_LIST = "[NULL, 'IPM.Note', ' ipm.note.Custom', 'REPORT.IPM.Note.NDR', 'IPM.Schedule.Meeting.Request', 'IPM.Appointment', 'IPM.Contact', 'IPM.DistList', 'IPM.Task', 'IPM.StickyNote.x', 'IPM.Activity', 'IPM.Note.Encrypted', 'Custom.Thing']"

NBT = f"nbt AS (SELECT o_orderkey * 32 + {CODE} AS node_id, o_orderkey AS ordinal FROM orders)"
CANDIDATES = "candidates AS (SELECT *, CASE node_id & 31 WHEN 4 THEN 'normal_message' ELSE 'associated_message' END AS message_kind FROM nbt WHERE node_id & 31 IN (4, 8))"
FOLDERS = f"""folders AS (SELECT {sid('folder', "'drv'", "'nation_' || n_nationkey")} AS folder_key, 'nation_' || n_nationkey AS node_id, {sid('folder', "'drv'", "'region_' || r_regionkey")} AS parent_folder_key,
 '/' || r_name || '/' || CASE WHEN n_nationkey % 9 = 0 THEN 'SAME' ELSE n_name END AS folder_path, CAST(n_nationkey AS BIGINT) AS ordinal, 'folder_found' AS status FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT {sid('folder', "'drv'", "'region_' || r_regionkey")}, 'region_' || r_regionkey, NULL, '/' || r_name, CAST(r_regionkey + 100 AS BIGINT), 'folder_found' FROM region)"""
MESSAGES = f"""messages AS (SELECT {sid('msg', "'drv'", node('o_orderkey * 32 + ' + CODE))} AS message_key, {node('o_orderkey * 32 + ' + CODE)} AS message_node_id, folder_key, folder_path,
 {CLASS_LIST}[CAST(o_orderkey % 13 + 1 AS INTEGER)] AS message_class, 'message_metadata' AS item_type, CASE o_orderstatus WHEN 'F' THEN 'visible' WHEN 'O' THEN 'associated' ELSE 'deleted' END AS visibility,
 CASE WHEN o_orderkey % 7 <> 0 THEN 'Re: FW:  Order; no, ' || o_orderkey END AS subject, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS sender_name,
 CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) || '@mail.example' END AS sender_email, 'SMTP' AS sender_address_type, CASE WHEN o_orderkey % 2 = 0 THEN 'filetime:' || o_orderkey END AS created_at,
 CAST(NULL AS VARCHAR) AS modified_at, 'message_extracted' AS extraction_status, o_orderkey AS ordinal
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN folders ON folders.node_id = 'nation_' || c_nationkey)"""
MEMBERS = f"""members AS (SELECT c.node_id, CASE WHEN l_suppkey % 17 = 0 THEN 'normal_message' ELSE c.message_kind END AS message_kind,
 CASE WHEN l_returnflag = 'R' THEN 'search_contents_table' WHEN c.message_kind = 'normal_message' THEN 'contents_table' ELSE 'associated_contents_table' END AS table_kind, f.folder_key, f.folder_path
 FROM lineitem JOIN candidates c ON l_orderkey = c.ordinal JOIN folders f ON f.node_id = 'nation_' || (l_suppkey % 25) WHERE l_linenumber <= 2 AND l_partkey % 3 < 2)"""
OWNERS = """phys AS (SELECT c.node_id, c.message_kind, count(m.node_id) AS n, count(*) FILTER (m.table_kind <> 'search_contents_table') AS physical_rows,
 count(*) FILTER (m.table_kind <> 'search_contents_table' AND (m.message_kind <> c.message_kind OR (m.message_kind = 'normal_message') <> (m.table_kind = 'contents_table'))) AS bad,
 count(DISTINCT CASE WHEN m.table_kind <> 'search_contents_table' THEN m.folder_key || m.folder_path END) AS unique_owners,
 min(CASE WHEN m.table_kind <> 'search_contents_table' THEN m.folder_key END) AS fk, min(CASE WHEN m.table_kind <> 'search_contents_table' THEN m.folder_path END) AS fp, min(CASE WHEN m.table_kind <> 'search_contents_table' THEN m.table_kind END) AS tk
 FROM candidates c LEFT JOIN members m ON c.node_id = m.node_id GROUP BY c.node_id, c.message_kind),
owners AS (SELECT node_id, CASE WHEN physical_rows = 0 OR bad > 0 THEN 'unresolved' WHEN physical_rows = 1 AND unique_owners = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome,
 CASE WHEN physical_rows = 1 AND bad = 0 THEN fk END AS folder_key, CASE WHEN physical_rows = 1 AND bad = 0 THEN fp END AS folder_path, physical_rows, unique_owners,
 CASE WHEN n = 0 THEN 'message_table_membership_absent' WHEN physical_rows = 0 THEN 'message_table_membership_search_only_or_unsupported' WHEN bad > 0 THEN 'message_table_membership_node_type_mismatch'
 WHEN physical_rows = 1 THEN 'message_table_membership_exact; table_type=' || tk ELSE 'message_table_membership_ambiguous; physical_rows=' || physical_rows || '; unique_owners=' || unique_owners END AS owner_status FROM phys)"""
RECIPIENTS = """recipients AS (SELECT l_orderkey AS order_key, CASE l_returnflag WHEN 'A' THEN 'to' WHEN 'N' THEN 'cc' ELSE 'bcc' END AS role, CASE WHEN l_partkey % 4 <> 0 THEN 'Part ' || l_partkey END AS display_name,
 CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_suppkey || '@mail.example' END AS smtp_address, '/o=x/cn=p' || l_partkey AS raw_address,
 lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || ':' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || ':' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS n FROM lineitem)"""
TEXTS = f"""texts AS (SELECT {sid('msg', "'docs'", 'doc_id')} AS message_key, CASE WHEN doc_id % 3 <> 0 THEN text END AS text, CASE doc_id % 4 WHEN 1 THEN encode(text) WHEN 2 THEN encode('abcd') END AS html,
 CASE WHEN doc_id % 4 = 3 THEN '<p>' || text END AS html_text, CASE doc_id % 5 WHEN 0 THEN encode('rtf' || text) WHEN 1 THEN encode('') END AS rtf FROM documents)"""
PAYLOADS = """payloads AS (SELECT message_key, 'text' AS body_type, 'utf-8' AS encoding, encode(text) AS content FROM texts WHERE text IS NOT NULL
 UNION ALL SELECT message_key, 'html', CASE WHEN html IS NOT NULL AND octet_length(html) NOT IN (0, 4) THEN NULL ELSE 'utf-8' END, CASE WHEN html IS NOT NULL AND octet_length(html) NOT IN (0, 4) THEN html ELSE encode(html_text) END
 FROM texts WHERE (html IS NOT NULL AND octet_length(html) NOT IN (0, 4)) OR html_text IS NOT NULL
 UNION ALL SELECT message_key, 'rtf', NULL, rtf FROM texts WHERE rtf IS NOT NULL AND octet_length(rtf) NOT IN (0, 4))"""
BODIES = f"""bodies AS (SELECT message_key, {sid('body', 'message_key', 'body_type')} AS body_key, body_type, 'bodies/' || message_key || '.' || CASE body_type WHEN 'text' THEN 'txt' ELSE body_type END AS archive_path,
 encoding, CAST(octet_length(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256, 'extracted' AS status FROM payloads)"""
RAW_ATTACHMENTS = f"""raw AS (SELECT {sid('msg', "'parts'", 'p_partkey % 50')} AS message_key, p_partkey AS ordinal, CASE WHEN p_partkey % 7 <> 0 THEN p_name || '. ' || p_type || '.' || substr(p_type, 1, 3) END AS long_name,
 CASE WHEN p_partkey % 3 <> 0 THEN '.a/b: ' || p_brand END AS short_name, CASE WHEN p_partkey % 6 = 0 THEN 'cid' || p_partkey END AS content_id, p_size % 2 = 0 AS hidden,
 CASE p_partkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE CAST(p_partkey % 5 AS INTEGER) END AS method, CASE WHEN p_partkey % 8 <> 0 THEN length(p_name) + p_partkey % 3 - 1 END AS declared,
 CASE WHEN p_partkey % 4 <> 0 THEN encode(p_name) END AS content FROM part)"""
ATTACHMENTS = f"""named AS (SELECT *, coalesce(long_name, short_name) AS nm FROM raw),
cleaned AS (SELECT *, CASE WHEN nm IS NULL AND method = 5 THEN 'embedded_' || ordinal || '.eml' WHEN nm IS NULL THEN 'attachment_' || ordinal
 ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(nm), '[/:]', '_', 'g'), ' +', '_', 'g'), '^\\.+|\\.+$', '', 'g'), '^_+|_+$', '', 'g') END AS safe FROM named),
attachments AS (SELECT message_key, {sid('att', 'message_key', 'ordinal')} AS attachment_key, ordinal, nm AS filename_original, safe AS filename_safe, nullif(lower(regexp_extract(safe, '\\.([^.]+)$', 1)), '') AS extension,
 coalesce(CAST(octet_length(content) AS BIGINT), 0) AS size_bytes, CASE WHEN declared >= 0 THEN CAST(declared AS BIGINT) END AS declared_size_bytes,
 CASE WHEN declared IS NULL AND content IS NULL THEN 'payload_unavailable_size_unknown' WHEN declared IS NULL THEN 'declared_size_absent' WHEN content IS NULL THEN 'payload_unavailable_declared_size_present'
 WHEN declared = octet_length(content) THEN 'size_matched' ELSE 'size_mismatch' END AS size_status, sha256(coalesce(content, encode(''))) AS sha256, hidden OR content_id IS NOT NULL AS is_inline, content_id, method AS attachment_method,
 CASE WHEN method = 1 THEN 'mapi:PR_ATTACH_DATA_BIN/by_value' WHEN method = 5 THEN 'mapi:PR_ATTACH_DATA_OBJ/embedded_message' WHEN method IS NULL THEN 'attachment_table_or_property_context:method_absent' ELSE 'mapi:PR_ATTACH_METHOD=' || method END AS source_ref,
 'attachments/' || message_key || '/' || {sid('att', 'message_key', 'ordinal')} || '_' || safe AS archive_path,
 CASE WHEN content IS NOT NULL THEN 'extracted' WHEN method = 5 THEN 'embedded_message_payload_deferred' ELSE 'attachment_payload_unavailable' END AS extraction_status FROM cleaned)"""
LINKS = "links AS (SELECT event_id AS parent, event_id + 1 AS child FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, event_id - 3 FROM events WHERE event_id % 50 = 7)"
OBSERVED = """observed AS (SELECT 'm' || doc_id AS message_key, doc_id % 4 AS blocks, doc_id % 2 AS subnode_blocks, doc_id % 3 AS tables, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS compact, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS utf16_compact,
 doc_id % 2 AS child_references, CASE WHEN doc_id % 13 = 0 THEN 3 ELSE 0 END AS unsupported, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS parse_errors, CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 0 END AS missing_payloads FROM documents),
backlog AS (SELECT message_key, 'unsupported_subnode_layout' AS category, unsupported AS observed_count, 'high' AS priority, 'layout_needs_triage' AS st FROM observed WHERE unsupported > 0
 UNION ALL SELECT message_key, 'unparseable_attachment_table', parse_errors, 'high', 'table_needs_triage' FROM observed WHERE parse_errors > 0
 UNION ALL SELECT message_key, 'attachment_rows_without_payloads', missing_payloads, 'medium', 'payload_mapping_needs_triage' FROM observed WHERE missing_payloads > 0),
items AS (SELECT message_key, category || ':' || st AS candidate_key, category, CAST(observed_count AS BIGINT) AS observed_count, priority, CASE priority WHEN 'high' THEN 'decoder_backlog_open' ELSE 'payload_mapping_backlog_open' END AS backlog_status FROM backlog)"""
RUNS = "runs AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'completed' WHEN 'view' THEN 'partial_success' ELSE 'skipped_existing' END AS status FROM events)"


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
