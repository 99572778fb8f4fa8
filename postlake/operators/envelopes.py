"""The item stream: folders, candidates, other nodes and residual messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import identity as ids
from postlake.operators.routing import class_confidence, item_kind, routing_status

COLUMNS = (
    "envelope_key", "record_kind", "node_id", "ordinal", "parent_envelope_key", "folder_path", "visibility", "item_kind", "message_class",
    "classification_confidence", "provenance_status", "extraction_status", "routing_status", "raw_evidence_refs",
)


def _null() -> Column:
    return F.lit(None).cast("string")


def _shaped(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[c].alias(c) for c in COLUMNS])


def of_folders(folders: DataFrame) -> DataFrame:
    """P18. folders(folder_key, node_id, parent_folder_key, folder_path, status, ordinal)."""
    return _shaped(
        folders, envelope_key=F.col("folder_key"), record_kind=F.lit("folder"), node_id=F.col("node_id"), ordinal=F.col("ordinal"), parent_envelope_key=F.col("parent_folder_key"),
        folder_path=F.col("folder_path"), visibility=F.lit("visible"), item_kind=_null(), message_class=_null(), classification_confidence=F.lit("folder_source_record"),
        provenance_status=F.col("status"), extraction_status=F.lit("folder_discovered"), routing_status=F.lit("not_applicable_folder"),
        raw_evidence_refs=F.array(F.concat(F.lit("folder_record:"), "folder_key")),
    )


def class_of(message_class: Column, item_type: Column) -> Column:
    """A message's class, or its item type where that looks like one."""
    t = F.trim(item_type)
    return F.coalesce(message_class, F.when(t.startswith("IPM.") | t.startswith("ipm.") | t.startswith("REPORT."), t))


def of_candidates(candidates: DataFrame, owners: DataFrame, messages: DataFrame, archive: str, **policy) -> DataFrame:
    """P19. candidates(node_id number, ordinal); owners of resolved_owners; messages(message_node_id,
    message_class, item_type, extraction_status, ordinal), of which the last of a node counts (J12)."""
    # shuffled first: the strings are aggregated by sorting, which before the shuffle takes a whole split of the scan
    last = messages.repartition("message_node_id").groupBy("message_node_id").agg(F.max_by(F.struct("message_class", "item_type", "extraction_status"), "ordinal").alias("msg"))
    node = ids.node_identity(F.col("c.node_id"))
    d = candidates.alias("c").join(owners.alias("o"), F.col("c.node_id") == F.col("o.node_id"), "left").join(last.alias("l"), node == F.col("l.message_node_id"), "left")
    resolved, ambiguous = F.col("o.outcome") == "resolved", F.col("o.outcome") == "ambiguous"
    d = d.select("c.node_id", "c.ordinal", "o.folder_key", "o.folder_path", "o.owner_status", resolved.alias("resolved"), ambiguous.alias("ambiguous"), class_of(F.col("msg.message_class"), F.col("msg.item_type")).alias("cls"), F.col("msg.extraction_status").alias("extracted"))
    kind = item_kind(F.col("cls"))
    state = F.when(F.col("resolved"), F.coalesce("extracted", F.lit("item_metadata_unavailable"))).when(F.col("ambiguous"), "unavailable_ambiguous_owner").otherwise("unavailable_unresolved_owner")
    seen = F.coalesce(F.when(ids.message_kind(F.col("node_id")) == "associated_message", "associated").when(ids.message_kind(F.col("node_id")) == "normal_message", "visible"), F.lit("unknown"))
    identity = ids.node_identity(F.col("node_id"))
    return _shaped(
        d, envelope_key=ids.message_key(archive, identity), record_kind=F.lit("item"), node_id=identity, ordinal=F.col("ordinal"), parent_envelope_key=F.col("folder_key"),
        folder_path=F.coalesce("folder_path", F.lit("")), visibility=seen, item_kind=F.coalesce(kind, F.lit("other")), message_class=F.col("cls"), classification_confidence=class_confidence(kind),
        provenance_status=F.coalesce("owner_status", F.lit("message_table_membership_absent")),
        extraction_status=F.when(kind.isNull() & (state == "item_metadata_unavailable"), "unavailable_missing_item_class").otherwise(state), routing_status=routing_status(kind, seen, **policy),
        raw_evidence_refs=F.array(F.concat(F.lit("nbt:"), identity), F.concat(F.lit("message_candidate:"), identity)),
    )


def of_other_nodes(nbt: DataFrame, archive: str) -> DataFrame:
    """P20. nbt(node_id, ordinal): nodes that are neither message, folder nor message table."""
    n = F.col("node_id")
    rest = nbt.where(ids.message_kind(n).isNull() & ids.folder_kind(n).isNull() & ids.table_kind(n).isNull())
    identity = ids.node_identity(n)
    return _shaped(
        rest, envelope_key=ids.stable_id("item", archive, identity), record_kind=F.lit("item"), node_id=identity, ordinal=F.col("ordinal"), parent_envelope_key=_null(), folder_path=F.lit(""),
        visibility=F.lit("unknown"), item_kind=F.lit("other"), message_class=_null(), classification_confidence=F.lit("node_type_unclassified"),
        provenance_status=F.lit("source_nbt_entry_not_message_or_folder"), extraction_status=F.lit("skipped_unclassified_source_entry"),
        routing_status=F.lit("unavailable_unclassified_source_entry"), raw_evidence_refs=F.array(F.concat(F.lit("nbt:"), identity)),
    )


def of_residual_messages(messages: DataFrame, seen: DataFrame, **policy) -> DataFrame:
    """Messages with a node whose key no envelope has yet."""
    m = messages.where("message_node_id is not null").join(seen.select(F.col("envelope_key").alias("message_key")).distinct(), "message_key", "left_anti")
    m = m.withColumn("cls", class_of(F.col("message_class"), F.col("item_type")))
    kind = item_kind(F.col("cls"))
    parent = F.when(F.col("folder_key") != "", F.col("folder_key"))
    return _shaped(
        m, envelope_key=F.col("message_key"), record_kind=F.lit("item"), node_id=F.col("message_node_id"), ordinal=F.col("ordinal"), parent_envelope_key=parent, folder_path=F.col("folder_path"),
        visibility=F.lit("visible"), item_kind=F.coalesce(kind, F.lit("other")), message_class=F.col("cls"), classification_confidence=class_confidence(kind),
        provenance_status=F.lit("message_record_source"), extraction_status=F.when(kind.isNull(), "unavailable_missing_item_class").otherwise(F.col("extraction_status")),
        routing_status=routing_status(kind, F.lit("visible"), **policy), raw_evidence_refs=F.array(F.concat(F.lit("message_record:"), "message_key")),
    )


def rekeyed(envelopes: DataFrame) -> DataFrame:
    """The first row of a key, by ordinal and node, keeps it; the others get keys of their own
    and a failed status."""
    turn = F.row_number().over(Window.partitionBy("envelope_key").orderBy("ordinal", F.col("node_id").asc_nulls_first(), "provenance_status"))
    d = envelopes.withColumn("__turn", turn)
    again = F.col("__turn") > 1
    failed = F.lit("failed_duplicate_source_identity")
    key = ids.stable_id("item_duplicate", F.col("envelope_key"), F.col("ordinal"), F.coalesce("node_id", F.lit("none")))
    for name, value in {"provenance_status": F.lit("duplicate_source_identity"), "extraction_status": failed, "routing_status": failed, "envelope_key": key}.items():
        d = d.withColumn(name, F.when(again, value).otherwise(F.col(name)))
    return d.drop("__turn")


def related_folders(envelopes: DataFrame) -> DataFrame:
    """Folders with their children's keys; those that share parent and path are marked. Items pass
    by: a window over all envelopes would hold the items of one parent and path in one task. A folder
    goes to its own key and its key to its parent's, so the envelopes aren't worked out for a join again."""
    folder = F.coalesce(F.col("record_kind") == "folder", F.lit(False))
    clash = F.count("*").over(Window.partitionBy("parent_envelope_key", "folder_path")) > 1
    f = envelopes.where(folder).withColumn("__clash", clash)
    f = f.withColumn("provenance_status", F.when(F.col("__clash"), F.concat("provenance_status", F.lit("; folder_path_collision"))).otherwise(F.col("provenance_status")))
    f = f.withColumn("extraction_status", F.when(F.col("__clash"), "failed_folder_path_collision").otherwise(F.col("extraction_status"))).drop("__clash")
    row = F.struct(*envelopes.columns)
    own = F.struct(F.col("envelope_key").alias("key"), row.alias("row"), F.lit(None).cast("string").alias("child"))
    up = F.struct(F.col("parent_envelope_key").alias("key"), F.when(F.lit(False), row).alias("row"), F.col("envelope_key").alias("child"))
    sent = f.select(F.explode(F.array(own, up)).alias("s")).select("s.*").where("row is not null or key is not null")
    met = sent.groupBy("key").agg(F.collect_list("row").alias("rows"), F.array_sort(F.collect_list("child")).alias("child_envelope_keys"))
    d = met.select(F.explode("rows").alias("r"), "child_envelope_keys").select("r.*", "child_envelope_keys")
    return d.unionByName(envelopes.where(~folder).withColumn("child_envelope_keys", F.array().cast("array<string>")))
