"""Which folder holds a message, and joins that refuse to guess."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PHYSICAL = ("contents_table", "associated_contents_table")


def table_owners(tables: DataFrame, folders: DataFrame) -> DataFrame:
    """tables(table_node, table_kind, owner_node) with their folder's key and path; a
    table without a folder has nulls and the status of that."""
    f = folders.select(F.col("node_id").alias("owner_node"), "folder_key", "folder_path")
    status = F.when(F.col("folder_key").isNull(), "message_table_owner_folder_absent").otherwise("message_table_owner_found")
    return tables.join(f, "owner_node", "left").withColumn("owner_status", status)


def resolved_owners(candidates: DataFrame, memberships: DataFrame) -> DataFrame:
    """A02. candidates(node_id, message_kind); memberships(node_id, message_kind, table_kind,
    folder_key, folder_path). One row a candidate: (node_id, outcome, folder_key, folder_path,
    physical_rows, unique_owners, owner_status); outcome is resolved, unresolved or ambiguous."""
    fits = ((F.col("m.message_kind") == "normal_message") & (F.col("m.table_kind") == "contents_table")) | ((F.col("m.message_kind") == "associated_message") & (F.col("m.table_kind") == "associated_contents_table"))
    physical = F.col("m.table_kind").isin(*_PHYSICAL)
    joined = candidates.alias("c").join(memberships.alias("m"), F.col("c.node_id") == F.col("m.node_id"), "left")
    grouped = joined.groupBy(F.col("c.node_id").alias("node_id"), F.col("c.message_kind").alias("message_kind")).agg(
        F.count("m.node_id").alias("rows"),
        F.count_if(physical).alias("physical_rows"),
        F.count_if(physical & ((F.col("m.message_kind") != F.col("c.message_kind")) | ~fits)).alias("mismatches"),
        F.count_distinct(F.when(physical, F.struct("m.folder_key", "m.folder_path"))).alias("unique_owners"),
        F.min(F.when(physical, F.struct("m.folder_key", "m.folder_path", "m.table_kind"))).alias("owner"),
    )
    one = (F.col("unique_owners") == 1) & (F.col("physical_rows") == 1)
    status = (
        F.when(F.col("rows") == 0, "message_table_membership_absent")
        .when(F.col("physical_rows") == 0, "message_table_membership_search_only_or_unsupported")
        .when(F.col("mismatches") > 0, "message_table_membership_node_type_mismatch")
        .when(~one, F.concat(F.lit("message_table_membership_ambiguous; physical_rows="), "physical_rows", F.lit("; unique_owners="), "unique_owners"))
        .otherwise(F.concat(F.lit("message_table_membership_exact; table_type="), "owner.table_kind"))
    )
    settled = (F.col("physical_rows") > 0) & (F.col("mismatches") == 0)
    outcome = F.when(settled & one, "resolved").when(settled, "ambiguous").otherwise("unresolved")
    found = F.col("outcome") == "resolved"
    return grouped.withColumn("owner_status", status).withColumn("outcome", outcome).select(
        "node_id", "outcome", F.when(found, F.col("owner.folder_key")).alias("folder_key"), F.when(found, F.col("owner.folder_path")).alias("folder_path"), "physical_rows", "unique_owners", "owner_status"
    )


def unmatched(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't on the other side."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def exactly_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of the left with its single match; without one the match is unavailable and
    with several ambiguous, and the right's columns are null."""
    fields = [c for c in right.columns if c != key]
    grouped = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("match_count"), F.min(F.struct(*fields)).alias("only"))
    n = F.coalesce("match_count", F.lit(0))
    status = F.when(n == 0, "unavailable").when(n > 1, "ambiguous").otherwise("matched")
    out = left.join(grouped, key, "left").withColumn("match_status", status)
    return out.select(*left.columns, *[F.when(F.col("match_status") == "matched", F.col(f"only.{c}")).alias(c) for c in fields], n.alias("match_count"), "match_status")


def zipped(rows: DataFrame, *arrays: str) -> DataFrame:
    """Elements by position; rows whose arrays differ in length give none."""
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & (F.size(a) == F.size(arrays[0]))
    rest = [c for c in rows.columns if c not in arrays]
    return rows.where(same).select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("ordinal", "z")).select(*rest, "ordinal", *[F.col(f"z.{a}").alias(a) for a in arrays])


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``turn``, 1 for a key's first row by ``order``, which has to be total."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def paired(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """One-use matches by key; the k-th row of either side meets the k-th of the other, what
    is left over on either side is reported."""
    number = lambda d: F.row_number().over(Window.partitionBy(key).orderBy(d))
    a = left.select(F.col(key), F.col(order).alias("left_row")).withColumn("k", number("left_row"))
    b = right.select(F.col(key), F.col(order).alias("right_row")).withColumn("k", number("right_row"))
    status = F.when(F.col("left_row").isNull(), "only_right").when(F.col("right_row").isNull(), "only_left").otherwise("paired")
    return a.join(b, [key, "k"], "full").withColumn("pair_status", status)


def rising_sets(rows: DataFrame, key: str, ordinal: str, order: list[str], valid: str) -> DataFrame:
    """(key, valid): whether all of a key's rows are valid and their ordinals strictly rise."""
    step = F.col(ordinal) - F.lag(ordinal).over(Window.partitionBy(key).orderBy(*order))
    g = rows.select(key, valid, step.alias("step")).groupBy(key)
    return g.agg((F.bool_and(valid) & F.coalesce(F.min("step") > 0, F.lit(True))).alias("valid"))
