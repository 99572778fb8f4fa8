"""Evidence over table columns, run counters, blockers and profile statuses (A09-A15, A17, F10, F11,
F17, J09, K06, W09, W10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import text as tx
from postlake.operators.content import EMBEDDED, extension_allowed, size_status

_FIXED = {0x0002: 2, 0x0003: 4, 0x000B: 2, 0x0014: 8}
_INTERNAL = (0x67F2, 0x67F3)
_IDENTITY = {0x39FE: 0, 0x3003: 1, 0x3001: 2}


def readable_columns(columns: DataFrame) -> DataFrame:
    """F10. columns(table, tag, bit, size, mask: array of booleans, one a row): without row ids and
    versions, the bits numbered anew in their old order."""
    kept = columns.where(~F.shiftright("tag", 16).isin(*_INTERNAL))
    return kept.withColumn("bit", F.row_number().over(Window.partitionBy("table").orderBy("bit", "tag")) - 1)


def in_every_row() -> Column:
    """over mask."""
    return (F.size("mask") > 0) & F.forall("mask", lambda b: F.coalesce(b, F.lit(False)))


def best_fixed_column(columns: DataFrame) -> DataFrame:
    """W09, A14. columns also has values, an array of texts: of each table the fixed-width column,
    set in every row, with the most distinct values, the lowest bit among equals."""
    kind = F.col("tag").bitwiseAND(0xFFFF)
    fits = F.lit(False)
    for code, size in _FIXED.items():
        fits = fits | ((kind == code) & (F.col("size") == size))
    d = columns.where(fits & in_every_row()).withColumn("distinct_values", F.size(F.array_distinct("values")))
    best = Window.partitionBy("table").orderBy(F.col("distinct_values").desc(), "bit")
    return d.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("table", "tag", "bit", "distinct_values")


def best_identity_column(columns: DataFrame) -> DataFrame:
    """SMTP address before e-mail address before display name, strings set in every row."""
    ident, kind = F.shiftright("tag", 16), F.col("tag").bitwiseAND(0xFFFF)
    rank = F.when(ident == 0x39FE, 0).when(ident == 0x3003, 1).otherwise(2)
    d = columns.where(ident.isin(*_IDENTITY) & kind.isin(0x1E, 0x1F) & (F.col("size") == 4) & in_every_row())
    return d.groupBy("table").agg(F.min_by("tag", F.struct(rank, F.col("bit"))).alias("tag"))


def message_counts(messages: DataFrame) -> DataFrame:
    """A09."""
    return messages.groupBy("message_key").agg(F.count("*").alias("n"))


def status_sums(statuses: DataFrame, keys: list[str], column: str = "status") -> DataFrame:
    """The sums of counters that status texts carry, 0 where none does."""
    return statuses.agg(*[F.coalesce(F.sum(tx.status_counter(F.col(column), k)), F.lit(0)).alias(k) for k in keys])


def ladder(rungs: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rung whose condition holds."""
    out = F.lit(otherwise)
    for name, cond in reversed(rungs):
        out = F.when(cond, name).otherwise(out)
    return out


def some(*columns: str) -> Column:
    cond = F.lit(False)
    for c in columns:
        cond = cond | (F.col(c) > 0)
    return cond


#: What stands in the way of more properties, payloads and subnodes, by counters of a run.
def blockers() -> dict[str, Column]:
    c = F.col
    return {
        "tag_shape": ladder([("heap_bth_layout_traversal", c("suspicious") > c("plausible")), ("selected_mapi_dictionary_expansion", some("plausible"))], "property_context_signal_absent"),
        "traversal": ladder([("heap_hn_header_or_bth_root_detection", some("legacy_flat")), ("property_context_traversal_status_missing", some("unknown_traversal")), ("heap_bth_index_or_external_hnid_resolution", some("heap_bth"))], "property_context_traversal_signal_absent"),
        "probe": ladder([("selected_property_or_external_hnid_resolution", some("offset_heap")), ("heap_bth_root_or_index_decode", some("bth_failed")), ("heap_page_map_or_allocation_decode", some("heap_failed")), ("heap_signature_or_block_payload_prefix_detection", some("not_found"))], "heap_probe_signal_absent"),
        "boundary": ladder([("heap_bth_root_or_index_decode", some("bth_failed")), ("payload_prefix_or_heap_page_map_decode", some("heap_failed", "no_page_map")), ("payload_block_selection_or_subnode_resolution", some("no_signature"))], "payload_boundary_signal_absent"),
        "subnodes": ladder([("message_subnode_payload_selection", (c("references") > c("attempts")) | (c("plans") > c("attempts"))), ("subnode_payload_interpretation", some("attempts")), ("non_subnode_payload_source_selection", (c("references") == 0) & (c("plans") == 0))], "payload_source_signal_absent"),
    }


def mail_only(messages: DataFrame) -> DataFrame:
    """F17."""
    return messages.where("item_type is distinct from 'metadata_status'")


def profile_status(messages: Column, emitted: Column, left_out: Column) -> Column:
    """left_out counts what was unavailable, skipped or filtered."""
    return F.when((messages == 0) | (emitted == 0), "mail_records_unavailable").when(left_out > 0, "mail_projection_partial").otherwise("mail_projection_available")


def attachment_decisions(attachments: DataFrame, allowed: list[str]) -> DataFrame:
    """K06. attachments(attachment_key, message_key, extension, attachment_method, content): adds decision."""
    d = (
        F.when(~extension_allowed(F.col("extension"), allowed), "filtered_attachment_extension").when(F.col("attachment_method") == EMBEDDED, "skipped_embedded_message_attachment")
        .when(F.col("content").isNull(), "unavailable_attachment_payload").when(F.octet_length("content") == 0, "unavailable_zero_length_attachment").otherwise("attachment_file_emitted")
    )
    return attachments.withColumn("decision", d)


def materialized_children(attachments: DataFrame, messages: DataFrame, bodies: DataFrame, emls: DataFrame) -> DataFrame:
    """J09. Embedded messages that can be written as mail of their own: one attachment names them,
    the message and its text body are there once, it has no attachments, and emls(message_key, eml)
    has its mail. (attachment_key, message_key, size_bytes, sha256, size_status, eml)"""
    once = lambda df, key: df.groupBy(key).agg(F.count("*").alias("__n")).where("__n = 1").select(key)
    a = attachments.where(F.col("attachment_method") == EMBEDDED).where("embedded_key is not null")
    a = a.join(once(attachments, "attachment_key"), "attachment_key", "left_semi").join(once(a, "embedded_key"), "embedded_key", "left_semi")
    child = lambda df: df.withColumnRenamed("message_key", "embedded_key")
    a = a.join(child(once(messages, "message_key")), "embedded_key", "left_semi").join(child(once(bodies.where("body_type = 'text'"), "message_key")), "embedded_key", "left_semi")
    a = a.join(child(attachments.select("message_key").distinct()), "embedded_key", "left_anti")
    d = a.join(child(emls.where("eml is not null").select("message_key", "eml")), "embedded_key")
    content = F.col("eml").cast("binary")
    size = F.octet_length(content).cast("bigint")
    return d.select("attachment_key", F.col("embedded_key").alias("message_key"), size.alias("size_bytes"), F.sha2(content, 256).alias("sha256"), size_status(F.col("declared_size_bytes"), size).alias("size_status"), "eml")
