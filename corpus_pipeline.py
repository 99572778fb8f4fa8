"""The corpus pipeline: filtering, deduplication, decontamination and mixing, one after another.

Every stage works on all rows that its predecessor kept and returns the columns of documents, but
for the last, which returns what is taken of which document. Rows with a null doc_id can't be told
apart: the quality classifier judges them, the deduplications let them pass, and mixing leaves them
out. A repeated row is one document to every stage up to mixing, which counts it as often as it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import line_dedup, mixing, quality
from postlake.llm.common import settled, table
from postlake.llm.decontaminate import contaminated
from postlake.llm.simhash_dups import near_duplicates


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id isn't in gone(doc_id)."""
    ids = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["__gone"], "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_lines(docs, line_dedup.removed_lines(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays. Line dedup takes what a later near copy
    shares with its original, and what is left of it resembles nothing any more; so a document is
    held against the others both as it is now and as it stands in the table of documents."""
    now = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    was = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    both = now.unionByName(was.join(now.select("doc_id").distinct(), "doc_id", "left_semi"))
    found = near_duplicates(both).groupBy("doc_id").agg((F.min("group_id") == F.col("doc_id")).alias("kept"))
    return _without(docs, found.where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.target_weights(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The classifier's training and the fingerprints have no SQL form; the tests hold every stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
