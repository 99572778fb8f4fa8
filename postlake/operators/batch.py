"""Batch accounting, decoder triage and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(not_extracted_messages: Column, not_extracted_attachments: Column, status: Column) -> Column:
    """M04."""
    partial = (not_extracted_messages > 0) | (not_extracted_attachments > 0) | status.contains("metadata_unavailable") | status.contains("partial")
    return F.when(partial, "partial_success").otherwise("completed")


def counters(items: DataFrame, discovered: Column) -> DataFrame:
    """One row. discovered is a number or a scalar that the input doesn't carry."""
    s = F.col("status")
    skipped = F.count_if(s.startswith("skipped"))
    return items.agg(
        discovered.cast("bigint").alias("discovered"), (F.count("*") - skipped).alias("attempted"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "partial_success").alias("partial"),
        F.count_if(s == "failed").alias("failed"), skipped.alias("skipped"), F.greatest(discovered.cast("bigint") - F.count("*"), F.lit(0)).alias("not_run"),
    )


def batch_status(goes_on: bool = True) -> Column:
    """Over counters' columns."""
    clean = (F.col("failed") == 0) & (F.col("not_run") == 0)
    return (
        F.when(F.col("discovered") == 0, "no_pst_files_found").when(clean & (F.col("partial") == 0), "completed").when(clean, "completed_with_partial_success")
        .when((F.col("failed") > 0) & F.lit(goes_on), "completed_with_failures").otherwise("failed_stopped_early")
    )


def progress(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The running number of rows of each status within a group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = lambda cond: F.count_if(cond).over(w)
    s = F.col("status")
    return events.select("*", F.count("*").over(w).alias("seen"), running(s == "completed").alias("completed"), running(s == "failed").alias("failed"), running(s.startswith("skipped")).alias("skipped"))


def to_run(files: DataFrame, completed: DataFrame, key: str = "path") -> DataFrame:
    """What no completed run covers."""
    return files.join(completed.select(key).distinct(), key, "left_anti")


def bounded(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """F16: at most ``most`` rows of a group; beyond, the first most-1 and the number of all beyond ``most``."""
    w = Window.partitionBy(group)
    d = rows.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(*order)))
    over = F.col("n") > most
    d = d.where((F.col("k") < most) | ((F.col("k") == most)))
    return d.withColumn("omitted", F.when(over & (F.col("k") == most), F.col("n") - most)).drop("n")


def priority_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


_CASES = (
    ("table_context_layout", "tables", "supported", "layout_supported"),
    ("compact_attachment_table_layout", "compact", "supported", "fixture_backed_decoder_supported"),
    ("utf16_compact_attachment_table_layout", "utf16_compact", "supported", "fixture_backed_decoder_supported"),
    ("known_child_reference_layout", "child_references", "supported", "layout_supported"),
    ("unsupported_subnode_layout", "unsupported", "needs_parser_work", "layout_needs_triage"),
    ("unparseable_attachment_table", "parse_errors", "needs_parser_work", "table_needs_triage"),
    ("attachment_rows_without_payloads", "missing_payloads", "partial", "payload_mapping_needs_triage"),
)


def triage(observed: DataFrame) -> DataFrame:
    """P32. observed(message_key, blocks, subnode_blocks and a count for each case) to a row a
    message: cases, counts by severity and a status."""
    case = lambda cat, col, sev, st: F.when(F.col(col) > 0, F.struct(F.lit(cat).alias("category"), F.col(col).cast("bigint").alias("observed_count"), F.lit(sev).alias("severity"), F.lit(st).alias("status")))
    of = lambda sev: sum((F.col(c[1]).cast("bigint") for c in _CASES if c[2] == sev), F.lit(0).cast("bigint"))
    d = observed.select("message_key", "blocks", "subnode_blocks", F.array_compact(F.array(*[case(*c) for c in _CASES])).alias("cases"), of("supported").alias("supported"), of("partial").alias("partial"), of("needs_parser_work").alias("unsupported"))
    status = (
        F.when((F.col("blocks") == 0) & (F.col("subnode_blocks") == 0), "observed_layouts_empty").when(F.col("unsupported") > 0, "observed_layouts_need_parser_triage")
        .when(F.col("partial") > 0, "observed_layouts_need_payload_triage").otherwise("observed_layouts_supported")
    )
    return d.withColumn("follow_ups", F.size(F.filter("cases", lambda c: c["severity"] != "supported"))).withColumn("status", status)


def backlog(triaged: DataFrame) -> DataFrame:
    """A row for each case that isn't supported."""
    d = triaged.select("message_key", F.inline("cases")).where("severity <> 'supported'")
    first = F.col("severity") == "needs_parser_work"
    return d.select(
        "message_key", F.concat("category", F.lit(":"), "status").alias("candidate_key"), "category", "observed_count", F.when(first, "high").otherwise("medium").alias("priority"),
        F.when(first, "decoder_backlog_open").otherwise("payload_mapping_backlog_open").alias("backlog_status"),
    )


def review(items: DataFrame) -> DataFrame:
    """One row over the whole backlog."""
    count = lambda c: F.count_if(c)
    d = items.agg(
        F.count("*").alias("total_items"), count(F.col("priority") == "high").alias("high"), count(F.col("priority") == "medium").alias("medium"), count(~F.col("priority").isin("high", "medium")).alias("low"),
        count(F.col("backlog_status") == "payload_mapping_backlog_open").alias("payload_mapping"), F.count_distinct("candidate_key").alias("unique_candidates"),
        F.min(F.struct(priority_rank(F.col("priority")), "candidate_key"))["candidate_key"].alias("top_candidate_key"),
    )
    name = lambda x: f"decoder_backlog_review_{x}"
    status = F.when(F.col("total_items") == 0, name("empty")).when(F.col("high") > 0, name("high_priority_open")).when(F.col("medium") > 0, name("medium_priority_open")).otherwise(name("low_priority_open"))
    return d.withColumn("review_status", status)


def issue_candidates(items: DataFrame) -> DataFrame:
    """Backlog items by candidate; category and priority are those of the first by message."""
    lead = F.min(F.struct("message_key", "category", "priority", "backlog_status"))
    return items.groupBy("candidate_key").agg(
        lead["category"].alias("category"), lead["priority"].alias("priority"), lead["backlog_status"].alias("backlog_status"), F.count_distinct("message_key").alias("affected_messages"),
        F.sum("observed_count").alias("observed_total"), F.count("*").alias("source_items"),
    )


def selection(candidates: DataFrame) -> DataFrame:
    """Adds a rank. There are as many candidates as kinds of finding, so one task ranks them."""
    order = [priority_rank(F.col("priority")), F.col("observed_total").desc(), F.col("affected_messages").desc(), F.col("candidate_key")]
    return candidates.withColumn("selection_rank", F.row_number().over(Window.orderBy(*order)))
