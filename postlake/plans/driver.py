"""The driver's tables as mail families. The rules are fixtures: they only have to be easy to state
in SQL again, and say nothing about mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import identity as ids

ARCHIVE = "drv"
CLASSES = (None, "IPM.Note", " ipm.note.Custom", "REPORT.IPM.Note.NDR", "IPM.Schedule.Meeting.Request", "IPM.Appointment", "IPM.Contact", "IPM.DistList", "IPM.Task", "IPM.StickyNote.x", "IPM.Activity", "IPM.Note.Encrypted", "Custom.Thing")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chosen(c: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (c % len(values) + 1).cast("int"))


def _code() -> Column:
    p = F.substring("o_orderpriority", 1, 1)
    return F.when(p == "1", 4).when(p == "2", 8).when(p == "3", 2).when(p == "4", 14).otherwise(31)


def nbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("node_id", F.col("o_orderkey") * 32 + _code())
    return o.select("node_id", F.col("o_orderkey").alias("ordinal"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbt(spark, sf_dir).withColumn("message_kind", ids.message_kind(F.col("node_id"))).where("message_kind is not null")


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("node_id"), F.col("r_regionkey").alias("rk"), F.concat(F.lit("/"), "r_name").alias("folder_path"))
    n = table(spark, sf_dir, "nation").join(r.select("rk", F.col("folder_path").alias("up")), F.col("n_regionkey") == F.col("rk"))
    n = n.select(F.concat(F.lit("nation_"), "n_nationkey").alias("node_id"), ids.folder_key(ARCHIVE, F.concat(F.lit("region_"), "rk")).alias("parent_folder_key"), F.concat("up", F.lit("/"), F.when(F.col("n_nationkey") % 9 == 0, "SAME").otherwise(F.col("n_name"))).alias("folder_path"), F.col("n_nationkey").cast("bigint").alias("ordinal"))
    r = r.select("node_id", F.lit(None).cast("string").alias("parent_folder_key"), "folder_path", (F.col("rk") + 100).cast("bigint").alias("ordinal"))
    return n.unionByName(r).select(ids.folder_key(ARCHIVE, F.col("node_id")).alias("folder_key"), "*", F.lit("folder_found").alias("status"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = folders(spark, sf_dir).select(F.col("node_id").alias("fnode"), "folder_key", "folder_path")
    # the folders are the nations: 25 rows at any scale factor, which the scan's size shows
    o = o.join(f, F.concat(F.lit("nation_"), "c_nationkey") == F.col("fnode"))
    node = ids.node_identity(F.col("o_orderkey") * 32 + _code())
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    return o.select(
        ids.message_key(ARCHIVE, node).alias("message_key"), node.alias("message_node_id"), "folder_key", "folder_path", _chosen(k, CLASSES).alias("message_class"), F.lit("message_metadata").alias("item_type"),
        F.when(F.col("o_orderstatus") == "F", "visible").when(F.col("o_orderstatus") == "O", "associated").otherwise("deleted").alias("visibility"),
        F.when(k % 7 != 0, F.concat(F.lit("Re: FW:  Order; no, "), k.cast("string"))).alias("subject"), F.when(c % 5 != 0, F.col("c_name")).alias("sender_name"),
        F.when(c % 3 != 0, F.concat(F.lower("c_mktsegment"), F.lit("@mail.example"))).alias("sender_email"), F.lit("SMTP").alias("sender_address_type"),
        F.when(k % 2 == 0, F.concat(F.lit("filetime:"), k.cast("string"))).alias("created_at"), F.lit(None).cast("string").alias("modified_at"), F.lit("message_extracted").alias("extraction_status"), k.alias("ordinal"),
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 and l_partkey % 3 < 2")
    c = candidates(spark, sf_dir)
    f = folders(spark, sf_dir).select(F.col("node_id").alias("fnode"), "folder_key", "folder_path")
    own = F.when(F.col("message_kind") == "normal_message", "contents_table").otherwise("associated_contents_table")
    d = li.join(c, F.col("l_orderkey") == F.col("ordinal")).join(f, F.concat(F.lit("nation_"), F.col("l_suppkey") % 25) == F.col("fnode"))
    kind = F.when(F.col("l_suppkey") % 17 == 0, "normal_message").otherwise(F.col("message_kind"))
    return d.select("node_id", kind.alias("message_kind"), F.when(F.col("l_returnflag") == "R", "search_contents_table").otherwise(own).alias("table_kind"), "folder_key", "folder_path")


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_key, role, display_name, smtp_address, raw_address, n): n orders them totally."""
    li = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_returnflag") == "A", "to").when(F.col("l_returnflag") == "N", "cc").otherwise("bcc")
    raw = F.concat(F.lit("/o=x/cn=p"), F.col("l_partkey").cast("string"))
    smtp = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("@mail.example")))
    order = F.concat_ws(":", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    return li.select(F.col("l_orderkey").alias("order_key"), role.alias("role"), F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("display_name"), smtp.alias("smtp_address"), raw.alias("raw_address"), order.alias("n"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        ids.message_key("docs", k).alias("message_key"), F.when(k % 3 != 0, F.col("text")).alias("text"),
        F.when(k % 4 == 1, F.col("text").cast("binary")).when(k % 4 == 2, F.lit("abcd").cast("binary")).alias("html"),
        F.when(k % 4 == 3, F.concat(F.lit("<p>"), "text")).alias("html_text"), F.when(k % 5 == 0, F.concat(F.lit("rtf"), "text").cast("binary")).when(k % 5 == 1, F.lit("").cast("binary")).alias("rtf"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        ids.message_key("parts", k % 50).alias("message_key"), k.alias("ordinal"), F.when(k % 7 != 0, F.concat("p_name", F.lit(". "), "p_type", F.lit("."), F.substring("p_type", 1, 3))).alias("long_name"),
        F.when(k % 3 != 0, F.concat(F.lit(".a/b: "), "p_brand")).alias("short_name"), F.when(k % 6 == 0, F.concat(F.lit("cid"), k.cast("string"))).alias("content_id"), (F.col("p_size") % 2 == 0).alias("hidden"),
        F.when(k % 5 == 0, 5).when(k % 5 == 1, 1).when(k % 5 == 2, F.lit(None).cast("int")).otherwise((k % 5).cast("int")).alias("method"),
        F.when(k % 8 != 0, F.length("p_name") + k % 3 - 1).alias("declared_size"), F.when(k % 4 != 0, F.col("p_name").cast("binary")).alias("content"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    on = e.where("event_type <> 'error'").select(F.col("event_id").alias("parent"), (F.col("event_id") + 1).alias("child"))
    return on.unionByName(e.where("event_id % 50 = 7").select(F.col("event_id").alias("parent"), (F.col("event_id") - 3).alias("child")))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("m"), n.cast("string")).alias("message_key"), (n % 4).alias("blocks"), (n % 2).alias("subnode_blocks"), (n % 3).alias("tables"), F.when(n % 7 == 0, 2).otherwise(0).alias("compact"),
        F.when(n % 11 == 0, 1).otherwise(0).alias("utf16_compact"), (n % 2).alias("child_references"), F.when(n % 13 == 0, 3).otherwise(0).alias("unsupported"), F.when(n % 17 == 0, 1).otherwise(0).alias("parse_errors"), F.when(n % 5 == 0, 4).otherwise(0).alias("missing_payloads"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    status = F.when(t == "error", "failed").when(t == "click", "completed").when(t == "view", "partial_success").otherwise("skipped_existing")
    return e.select("event_id", "user_id", status.alias("status"))
