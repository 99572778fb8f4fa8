"""Queries over operators that no query of core.py reaches, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions import dates
from postlake.functions import text as tx
from postlake.operators import content, ownership, reports, routing, typed
from postlake.plans import driver as dr
from postlake.plans import twins as tw
from postlake.plans.core import query

_ITEMS = tw.with_(tw.NBT, tw.FOLDERS, tw.MESSAGES)
_GIVEN = (
    "given AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN 'folder' ELSE 'item' END AS record_kind, "
    "CASE WHEN ordinal % 11 = 0 THEN 'failed_decode' WHEN ordinal % 2 = 0 THEN 'routed_email' ELSE 'skipped_unknown_item_class' END AS before FROM messages)"
)


def _given(spark, d):
    n = F.col("ordinal")
    status = F.when(n % 11 == 0, "failed_decode").when(n % 2 == 0, "routed_email").otherwise("skipped_unknown_item_class")
    return dr.messages(spark, d).withColumn("record_kind", F.when(n % 3 == 0, "folder").otherwise("item")).withColumn("routing_status", status)


@query(
    "F04_rerouted",
    tw.with_(tw.NBT, tw.FOLDERS, tw.MESSAGES, _GIVEN)
    + f"""SELECT message_key, record_kind, CASE WHEN record_kind = 'item' AND before NOT LIKE 'failed_%'
 THEN {tw.route(tw.kind('message_class'), "CASE WHEN visibility = 'associated' THEN 'x' ELSE visibility END", "'note','schedule','report'")} ELSE before END AS routing_status FROM given""",
)
def rerouted(spark, d):
    return routing.rerouted(_given(spark, d), only="email", associated=True).select("message_key", "record_kind", "routing_status")


@query(
    "F05_J13_routed_messages",
    tw.with_(tw.NBT, tw.FOLDERS, tw.MESSAGES, _GIVEN)
    + "SELECT message_key, subject, ordinal FROM messages WHERE message_key IN (SELECT message_key FROM given WHERE record_kind = 'item' AND before LIKE 'routed_%')",
)
def routed_messages(spark, d):
    items = _given(spark, d).withColumnRenamed("message_key", "envelope_key")
    return routing.only_routed(dr.messages(spark, d), items).select("message_key", "subject", "ordinal")


@query(
    "J01_J02_table_owners",
    tw.with_(tw.NBT, tw.FOLDERS)
    + """SELECT nbt.node_id AS table_node, 'nation_' || (nbt.ordinal % 30) AS owner_node, folder_key, folder_path,
 CASE WHEN folder_key IS NULL THEN 'message_table_owner_folder_absent' ELSE 'message_table_owner_found' END AS owner_status
 FROM nbt LEFT JOIN folders ON folders.node_id = 'nation_' || (nbt.ordinal % 30)""",
)
def table_owners(spark, d):
    t = dr.nbt(spark, d).select(F.col("node_id").alias("table_node"), F.concat(F.lit("nation_"), (F.col("ordinal") % 30).cast("string")).alias("owner_node"))
    return ownership.table_owners(t, dr.folders(spark, d))


@query(
    "J06_J07_J19_payloads",
    "SELECT p_partkey AS attachment_key, p_brand AS filename, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS content FROM part",
)
def payloads(spark, d):
    p = dr.table(spark, d, "part").withColumnRenamed("p_partkey", "attachment_key")
    stored = p.where("attachment_key % 4 <> 0").select("attachment_key", F.col("p_name").cast("binary").alias("content"))
    records = p.select("attachment_key", F.col("p_brand").alias("filename"))
    return content.with_payloads(records, stored, "attachment_key").withColumn("content", F.col("content").cast("string"))


@query(
    "A09_F17_message_counts",
    "SELECT conv_id AS message_key, count(*) AS n FROM conversations WHERE turn % 3 <> 0 GROUP BY conv_id",
)
def message_counts(spark, d):
    c = dr.table(spark, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "metadata_status").when(F.col("turn") % 3 == 1, "message_metadata")
    return reports.message_counts(reports.mail_only(c.select(F.col("conv_id").alias("message_key"), kind.alias("item_type"))))


@query(
    "K14_journals",
    _ITEMS
    + f"""SELECT {tw.sid('non-mail', 'message_key')} AS non_mail_key, 'BEGIN:VJOURNAL' || e || 'VERSION:1.0' || e || 'UID:' || {tw.sid('non-mail', 'message_key')} || e
 || 'DTSTAMP:19700101T000000Z' || e || 'X-MAIL-DTSTAMP-SYNTHETIC:TRUE' || e || coalesce('SUMMARY:' || replace(replace(subject, ';', '\\;'), ',', '\\,') || e, '')
 || coalesce('X-MAIL-SOURCE-CREATED-AT:' || created_at || e, '') || coalesce('X-MAIL-SOURCE-MODIFIED-AT:' || modified_at || e, '')
 || 'X-MAIL-STATUS:' || CASE WHEN coalesce(subject, sender_name, created_at, modified_at) IS NULL THEN 'journal_fields_unavailable' ELSE 'journal_partial_source_fields' END || e || 'END:VJOURNAL' || e AS vjournal
 FROM messages, (SELECT chr(13) || chr(10) AS e) WHERE {tw.kind('message_class')} = 'journal'""",
)
def journals(spark, d):
    m = dr.messages(spark, d)
    none = m.where("false").select("message_key", F.lit("b").alias("body_key"))
    return typed.journals(typed.non_mail(m, none))


@query(
    "X11_X12_threading",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN [] WHEN 1 THEN ['<' || conv_id || '@x>'] WHEN 2 THEN ['<a' || turn || '>', '<b>'] ELSE [] END AS refs,
 CASE WHEN turn % 4 IN (1, 2) OR conv_id % 3 = 0 OR turn % 5 = 0 THEN 'threading_metadata_available' ELSE 'threading_metadata_absent' END AS status FROM conversations""",
)
def threading(spark, d):
    n, k = F.col("turn"), F.col("conv_id").cast("string")
    raw = F.when(n % 4 == 1, F.concat(F.lit("junk ,<"), k, F.lit("@x>;"))).when(n % 4 == 2, F.concat(F.lit(";<a"), n.cast("string"), F.lit(">\t,,<b>,\n<>"))).when(n % 4 == 3, "none <open close>")
    c = dr.table(spark, d, "conversations").withColumn("refs", tx.split_references(raw))
    status = tx.threading_status(F.when(F.col("conv_id") % 3 == 0, k), F.when(n % 5 == 0, k), F.col("refs"), F.lit(None))
    return c.select("conv_id", "turn", "refs", status.alias("status"))


@query(
    "X30_X31_X32_headers",
    """SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'u' || user_id END AS sender, CASE event_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'a/b' ELSE 'application/octet-stream' END AS media,
 CASE WHEN event_id % 2 = 0 THEN '8bit' ELSE 'base64' END AS encoding FROM events""",
)
def headers(spark, d):
    n = F.col("event_id")
    h = F.concat(F.lit("Received: x\r\nX-Kind:  "), "event_type", F.when(n % 3 == 0, "\r\n").otherwise(F.concat(F.lit("\r\nfrom: u"), F.col("user_id").cast("string"), F.lit(" \r\nFrom: second\r\n"))))
    media = F.when(n % 4 == 0, " text/plain ").when(n % 4 == 1, "a/b").when(n % 4 == 2, "text/plain; charset=x").otherwise("plain")
    body = F.when(n % 2 == 0, F.encode("props", "UTF-8")).when(n % 4 == 1, F.lit(b"a\x00b")).otherwise(F.lit(b"\xff\xfe"))
    e = dr.table(spark, d, "events")
    return e.select(n, tx.header_value(h, "X-Kind").alias("kind"), tx.header_value(h, "From").alias("sender"), tx.safe_media_type(media).alias("media"), tx.transfer_encoding(body).alias("encoding"))


@query(
    "X52_first_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Mon, 1 Jan 2024' WHEN o_orderkey % 3 = 0 THEN 'filetime:' || o_custkey WHEN o_orderkey % 2 = 0 THEN 'filetime:' || o_orderkey END AS date FROM orders",
)
def first_date(spark, d):
    k = F.col("o_orderkey")
    sent, received = F.when(k % 3 == 0, dates.filetime_text(F.col("o_custkey"))), F.when(k % 2 == 0, dates.filetime_text(k))
    return dr.table(spark, d, "orders").select(k, dates.first_date(F.when(k % 5 == 0, "Mon, 1 Jan 2024"), sent, received).alias("date"))


@query(
    "X19_run_directories",
    f"""WITH p AS (SELECT c_custkey, '/in/' || c_mktsegment || '/' || CASE c_custkey % 3 WHEN 0 THEN '__' WHEN 1 THEN c_name || '.old' ELSE ' ' || c_name END || '.pst' AS path FROM customer),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM p)
SELECT c_custkey, CASE WHEN safe = '' THEN 'pst' ELSE safe END || '_' || substr({tw.sid('pstout', 'path')}, 8, 16) AS directory FROM s""",
)
def run_directories(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "__").when(k % 3 == 1, F.concat("c_name", F.lit(".old"))).otherwise(F.concat(F.lit(" "), "c_name"))
    return dr.table(spark, d, "customer").select(k, tx.run_directory(F.concat(F.lit("/in/"), "c_mktsegment", F.lit("/"), name, F.lit(".pst"))).alias("directory"))


@query(
    "J15_J16_L01_folder_children",
    tw.with_(tw.FOLDERS) + "SELECT c.folder_key, c.folder_path, p.folder_path AS parent_path, row_number() OVER (ORDER BY c.folder_path, c.folder_key) - 1 AS place FROM folders c LEFT JOIN folders p ON c.parent_folder_key = p.folder_key",
)
def folder_children(spark, d):
    # some thirty folders at any scale factor: one ordered task is enough here
    from pyspark.sql import Window

    f = dr.folders(spark, d)
    p = f.select(F.col("folder_key").alias("up"), F.col("folder_path").alias("parent_path"))
    place = F.row_number().over(Window.orderBy("folder_path", "folder_key")) - 1
    return f.join(p, F.col("parent_folder_key") == F.col("up"), "left").select("folder_key", "folder_path", "parent_path", place.cast("bigint").alias("place"))
