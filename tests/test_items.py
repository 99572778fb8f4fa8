"""The item stream's folder step on items of one parent and path."""

from collections import Counter

from pyspark.sql import functions as F

from postlake.operators import envelopes

FIELDS = "envelope_key string, record_kind string, parent_envelope_key string, folder_path string, provenance_status string, extraction_status string"


def test_items_of_one_folder_stay_spread(spark):
    there = F.col("id") >= 0  # no constants, or the optimizer takes the step out
    items = spark.range(0, 4000, 1, 4).select(
        F.concat(F.lit("i"), "id").alias("envelope_key"), F.when(there, "item").alias("record_kind"), F.when(~there, "x").alias("parent_envelope_key"),
        F.when(there, "").alias("folder_path"), F.when(there, "p").alias("provenance_status"), F.when(there, "e").alias("extraction_status"),
    )
    out = envelopes.related_folders(items).withColumn("part", F.spark_partition_id())
    per_task = Counter(r.part for r in out.collect()).values()
    assert sum(per_task) == 4000 and max(per_task) <= 1000


def test_children_and_clashes(spark):
    rows = [
        ("a", "folder", None, "/A", "p", "e"), ("b2", "folder", "a", "/A/x", "p", "e"), ("b1", "folder", "a", "/A/x", "p", "e"), ("c", "folder", "a", "/A/y", "p", "e"),
        ("c", "folder", "gone", "/z", "p", "e"), ("d", "folder", "c", "/A/y", "p", "e"), ("i", "item", "a", "/A/x", "p", "e"), ("j", None, "a", "/A/x", "p", "e"),
    ]
    got = sorted((r.envelope_key, r.folder_path, r.provenance_status, r.extraction_status, r.child_envelope_keys) for r in envelopes.related_folders(spark.createDataFrame(rows, FIELDS)).collect())
    both = ("p; folder_path_collision", "failed_folder_path_collision")
    assert got == [
        ("a", "/A", "p", "e", ["b1", "b2", "c"]), ("b1", "/A/x", *both, []), ("b2", "/A/x", *both, []), ("c", "/A/y", "p", "e", ["d"]), ("c", "/z", "p", "e", ["d"]),
        ("d", "/A/y", "p", "e", []), ("i", "/A/x", "p", "e", []), ("j", "/A/x", "p", "e", []),
    ]
