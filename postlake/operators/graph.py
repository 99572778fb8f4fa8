"""Embedded messages as a graph: edges, depths, cycles, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import identity as ids
from postlake.lineage import settled
from postlake.operators.content import EMBEDDED

MAX_NODES, MAX_DEPTH, MAX_BYTES = 4096, 8, 64 << 20


def budget_status(nodes: Column, size: Column, depth: Column) -> Column:
    """R04."""
    return F.when(nodes > MAX_NODES, "node_budget_exceeded").when(size > MAX_BYTES, "byte_budget_exceeded").when(depth > MAX_DEPTH, "depth_budget_exceeded").otherwise("within_limits")


def resolution_status(has_child: Column, exists: Column, is_mail: Column, ambiguous: Column, duplicate: Column) -> Column:
    """The first rung that fails."""
    return (
        F.when(~has_child, "missing_child_reference").when(~exists, "child_message_unavailable").when(~is_mail, "child_non_email_item")
        .when(ambiguous, "ambiguous_child_owner").when(duplicate, "duplicate_attachment_owner").otherwise("child_message_resolved")
    )


def depths(nodes: DataFrame, edges: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """R02. nodes(node), edges(parent, child) to (node, depth): the shortest way from a node that is
    nobody's child, up to one step past ``most``; what no root reaches has no row.

    The number of joins is bounded by ``most``, a constant; every level is distinct, so a level is
    never larger than the nodes."""
    e = edges.select("parent", "child").distinct()
    level = nodes.select("node").distinct().join(e.select(F.col("child").alias("node")), "node", "left_anti")
    seen = level.withColumn("depth", F.lit(0))
    for d in range(1, most + 2):
        level = level.join(e, level["node"] == e["parent"]).select(F.col("child").alias("node")).distinct()
        seen = seen.unionByName(level.withColumn("depth", F.lit(d)))
    return seen.groupBy("node").agg(F.min("depth").alias("depth"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """The distinct edges (parent, child) whose child reaches their parent; an edge to itself
    counts.

    Nodes without a way in or without a way out lie on no cycle and are peeled off first, which
    leaves little of a mail archive. What is left is followed a step a round, every (edge, place)
    once, and each round is cut by a checkpoint, so the plan doesn't grow with the cycles' length."""
    e = settled(edges.select("parent", "child").where("parent is not null and child is not null").distinct())
    size = e.count()
    while size:
        e = settled(e.join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"))
        before, size = size, e.count()
        if size == before:
            break
    step = e.select(F.col("parent").alias("at"), F.col("child").alias("to"))
    new = seen = e.select("parent", "child", F.col("child").alias("at"))
    while size:
        onward = new.where(F.col("at") != F.col("parent")).join(step, "at").select("parent", "child", F.col("to").alias("at")).distinct()
        new = settled(onward.join(seen, ["parent", "child", "at"], "left_anti"))
        size = new.count()
        seen = settled(seen.unionByName(new)) if size else seen
    return seen.where(F.col("at") == F.col("parent")).select("parent", "child")


def embedded_edges(messages: DataFrame, attachments: DataFrame, sizes: DataFrame, cycles: DataFrame) -> DataFrame:
    """R01. messages(message_key, item_type); attachments(message_key, attachment_key, ordinal,
    attachment_method, embedded_key); sizes(message_key, bytes); cycles of on_cycles. One row for
    every embedded attachment."""
    a = attachments.where(F.col("attachment_method") == EMBEDDED)
    known = messages.groupBy(F.col("message_key").alias("mk")).agg(F.count("*").alias("owners"), F.max(F.col("item_type").isin("message_metadata", "embedded_message_metadata")).alias("is_mail"))
    total = known.agg(F.count("*").alias("nodes"))
    links = a.where("embedded_key is not null").select(F.col("message_key").alias("parent"), F.col("embedded_key").alias("child"))
    d = depths(messages.select(F.col("message_key").alias("node")), links)
    dup = a.groupBy(F.col("attachment_key").alias("ak")).agg((F.count("*") > 1).alias("dup"))
    c = cycles.select(F.col("parent").alias("cp"), F.col("child").alias("cc"), F.lit(True).alias("cyclic"))
    j = a.join(known, a["embedded_key"] == known["mk"], "left").join(d, a["embedded_key"] == d["node"], "left").join(sizes.select(F.col("message_key").alias("sk"), "bytes"), a["embedded_key"] == F.col("sk"), "left")
    j = j.join(dup, a["attachment_key"] == F.col("ak")).join(c, (a["message_key"] == F.col("cp")) & (a["embedded_key"] == F.col("cc")), "left").crossJoin(F.broadcast(total))
    cyclic, depth, size = F.coalesce("cyclic", F.lit(False)), F.coalesce("depth", F.lit(0)), F.coalesce("bytes", F.lit(0))
    budget = budget_status(F.col("nodes"), size, depth)
    exists = F.col("mk").isNotNull()
    resolution = resolution_status(F.col("embedded_key").isNotNull(), exists, F.coalesce("is_mail", F.lit(False)), F.coalesce(F.col("owners") > 1, F.lit(False)), F.col("dup"))
    sure = exists & ~cyclic & (budget == "within_limits") & (resolution == "child_message_resolved")
    status = F.when(sure, "embedded_child_resolved").when(cyclic, "embedded_child_cycle_rejected").when(budget != "within_limits", "embedded_child_budget_rejected").otherwise("embedded_child_unavailable")
    return j.select(
        ids.stable_id("edge", F.col("message_key"), F.col("attachment_key")).alias("edge_key"), F.col("message_key").alias("parent_message_key"), "attachment_key", F.col("embedded_key").alias("child_message_key"),
        "ordinal", depth.alias("depth"), size.alias("raw_bytes_observed"), budget.alias("budget_status"), F.when(cyclic, "cycle_detected").otherwise("acyclic").alias("cycle_status"),
        resolution.alias("resolution_status"), status.alias("status"), sure.alias("authoritative"),
    )
