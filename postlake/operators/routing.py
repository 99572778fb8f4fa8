"""Message classes, routing decisions and routing counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import trim

#: kind: exact classes, dotted prefixes. The first that fits is taken.
_KINDS = (
    ("note", ("ipm.note",), ("ipm.note.",)),
    ("schedule", (), ("ipm.schedule.meeting.",)),
    ("appointment", ("ipm.appointment",), ("ipm.appointment.",)),
    ("contact", ("ipm.contact",), ("ipm.contact.",)),
    ("journal", ("ipm.journal", "ipm.activity"), ("ipm.journal.", "ipm.activity.")),
    ("sticky_note", ("ipm.stickynote",), ("ipm.stickynote.",)),
    ("task", ("ipm.task",), ("ipm.task.",)),
    ("report", (), ("report.", "report/")),
)
_MAIL = ("note", "schedule", "report")
_FILTERS = {"email": _MAIL, "appointment": ("appointment",), "journal": ("journal",), "contact": ("contact",)}
_ROUTED = {"note": "routed_email", "schedule": "routed_schedule_email", "appointment": "routed_appointment", "contact": "routed_contact", "journal": "routed_journal", "report": "routed_report"}
OUTCOMES = {"emitted": "routed_", "filtered": "filtered_", "skipped": "skipped_", "unavailable": "unavailable_", "failed": "failed_"}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_kind(message_class: Column) -> Column:
    """null where the class is missing, which is not the same as one that is unknown."""
    c = ascii_lower(trim(message_class))
    out = F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
    for kind, exact, prefixes in _KINDS:
        hit = F.lit(False)
        for x in exact:
            hit = hit | (c == x)
        for x in prefixes:
            hit = hit | c.startswith(x)
        out = out.when(hit, kind)
    return out.otherwise("other")


def class_confidence(kind: Column) -> Column:
    return F.when(kind.isNull(), "message_class_missing").when(kind == "other", "message_class_unknown").otherwise("message_class_normalized")


def routing_status(kind: Column, visibility: Column, only: str = "all", deleted: bool = False, associated: bool = False) -> Column:
    """the first reason that keeps an item back, or the route that it takes."""
    if only != "all" and only not in _FILTERS:
        raise ValueError(f"no such item filter: {only}")
    out = F.when((visibility == "deleted") & F.lit(not deleted), "filtered_deleted")
    out = out.when((visibility == "associated") & F.lit(not associated), "filtered_associated")
    out = out.when(F.coalesce(visibility, F.lit("unknown")) == "unknown", "unavailable_unknown_visibility")
    out = out.when(kind.isNull(), "unavailable_missing_item_class")
    out = out.when(kind.isin("sticky_note", "task"), "skipped_unsupported_by_readpst")
    out = out.when(kind == "other", "skipped_unknown_item_class")
    if only != "all":
        out = out.when(~kind.isin(*_FILTERS[only]), "filtered_item_type")
    for name, status in _ROUTED.items():
        out = out.when(kind == name, status)
    return out


def rerouted(items: DataFrame, only: str = "all", deleted: bool = False, associated: bool = False) -> DataFrame:
    """another policy for items; what failed stays failed, folders stay as they are."""
    again = routing_status(item_kind(F.col("message_class")), F.col("visibility"), only, deleted, associated)
    return items.withColumn("routing_status", F.when((F.col("record_kind") == "item") & ~F.col("routing_status").startswith("failed_"), again).otherwise(F.col("routing_status")))


def routed_keys(items: DataFrame) -> DataFrame:
    return items.where((F.col("record_kind") == "item") & F.col("routing_status").startswith("routed_")).select("envelope_key").distinct()


def only_routed(messages: DataFrame, items: DataFrame) -> DataFrame:
    """the messages whose item takes a route."""
    keys = routed_keys(items).withColumnRenamed("envelope_key", "message_key")
    return messages.join(keys, "message_key", "left_semi")


def routing_counts(folders: DataFrame, items: DataFrame) -> DataFrame:
    """(folder_key, folder_path, item_count, <outcome>_count): a row for each folder, zeros
    included, and one for each parent that is no folder, null among them, under the smallest path
    of its items."""
    status = F.col("routing_status")
    sums = [F.count_if(status.startswith(prefix)).alias(f"{name}_count") for name, prefix in OUTCOMES.items()]
    counted = items.where("record_kind = 'item'").groupBy(F.col("parent_envelope_key").alias("parent")).agg(F.count("*").alias("item_count"), *sums, F.min("folder_path").alias("item_path"))
    both = folders.select("folder_key", "folder_path").join(counted, F.col("folder_key").eqNullSafe(F.col("parent")), "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("item_count", *(f"{n}_count" for n in OUTCOMES))]
    return both.select(F.coalesce("folder_key", "parent").alias("folder_key"), F.coalesce("folder_path", "item_path").alias("folder_path"), *counts)
