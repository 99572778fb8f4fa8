"""A batch run: mailbox files to families, with resume and a summary a file.

    extract(spark, "/mail", "/out")

writes /out/<family>/ as Parquet, partitioned by run, and a row a file to /out/summaries. A later
run leaves out files that a summary covers, unless ``overwrite``. A file that can't be read has a
failed summary and no rows elsewhere; it is tried again by the next run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import identity as ids
from postlake.operators import batch, content, families, typed
from postlake.operators.routing import class_confidence, item_kind, routing_status
from postlake.sources.readers import read_store

_BY = ("path",)
ITEM_TYPES = ("all", "email", "appointment", "journal", "contact")


@dataclass(frozen=True)
class Options:
    """refused here if they make no sense."""

    item_type: str = "all"
    include_deleted: bool = False
    include_associated: bool = False
    overwrite: bool = False

    def __post_init__(self):
        if self.item_type not in ITEM_TYPES:
            raise ValueError(f"item_type is one of {', '.join(ITEM_TYPES)}")


def decoded(spark: SparkSession, path: str, options: Options = Options()) -> dict[str, DataFrame]:
    """The families of all files under a path, each with its file."""
    nodes, props = (read_store(spark, path, t) for t in ("nodes", "properties"))
    archive = ids.archive_id(F.col("path"))
    names = props.where(F.col("name") == "display_name").groupBy("path", "node_id").agg(F.min("text").alias("display_name"))
    messages = families.message_rows(nodes, props, archive, _BY)
    kind = item_kind(F.col("message_class"))
    seen = F.when(ids.message_kind(F.expr("cast(conv(substring(message_node_id, 6), 16, 10) as bigint)")) == "associated_message", "associated").otherwise("visible")
    routed = messages.withColumn("item_kind", kind).withColumn("classification_confidence", class_confidence(kind)).withColumn("visibility", seen)
    routed = routed.withColumn("routing_status", routing_status(F.col("item_kind"), F.col("visibility"), options.item_type, options.include_deleted, options.include_associated)).withColumn("folder_path", F.lit(""))
    raw = lambda ident: F.max(F.when(F.col("tag") == ident, F.col("raw")))
    texts = props.groupBy("path", "node_id").agg(*[F.max(F.when(F.col("tag").isin(*t), F.col("text"))).alias(n) for n, t in {"text": (0x1000001F, 0x1000001E), "html_text": (0x1013001F, 0x1013001E)}.items()], raw(0x10130102).alias("html"), raw(0x10090102).alias("rtf"))
    texts = texts.withColumn("message_key", ids.message_key(archive, ids.node_identity(F.col("node_id"))))
    payloads = content.body_payloads(texts)
    return {
        "files": read_store(spark, path, "files"),
        "folders": families.folder_rows(nodes, names, archive, _BY),
        "messages": routed,
        "headers": families.header_rows(messages),
        "bodies": content.body_records(payloads),
        "body_payloads": payloads,
        "contacts": typed.contacts(routed),
        "calendars": typed.calendars(routed),
        "evidence": families.property_evidence(props, archive),
    }


def summaries(found: dict[str, DataFrame]) -> DataFrame:
    """A row a file: what it holds, what wasn't extracted and how it ended."""
    m = found["messages"].groupBy("path").agg(F.count("*").alias("messages"), F.count_if(F.col("extraction_status") == "message_properties_unavailable").alias("messages_not_extracted"))
    f = found["folders"].groupBy("path").agg((F.count("*") - 1).alias("folders"))
    d = found["files"].select("path", "size", "readiness", "message").join(m, "path", "left").join(f, "path", "left").na.fill(0, ["messages", "messages_not_extracted", "folders"])
    done = batch.outcome(F.col("messages_not_extracted"), F.lit(0), F.lit(""))
    return d.withColumn("status", F.when(F.col("readiness") == "ready", done).otherwise("failed"))


def completed(spark: SparkSession, out: str) -> DataFrame | None:
    """Earlier summaries; null where there are none."""
    try:
        return spark.read.parquet(f"{out}/summaries").where("status <> 'failed'")
    except AnalysisException:
        return None


def extract(spark: SparkSession, path: str, out: str, options: Options = Options()) -> DataFrame:
    """Runs, writes and returns the run's one-row report: counters and a status."""
    run = uuid.uuid4().hex
    found = decoded(spark, path, options)
    earlier = None if options.overwrite else completed(spark, out)
    every = found["files"].select("path")
    done = earlier.select("path").distinct() if earlier is not None else every.where("false")
    for name, rows in found.items():
        if "path" in rows.columns:
            rows = rows.join(done, "path", "left_anti")
        rows.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{out}/{name}")
    new = summaries(found).join(done, "path", "left_anti").withColumn("run", F.lit(run))
    new.write.mode("append").partitionBy("run").parquet(f"{out}/summaries")
    mine = spark.read.parquet(f"{out}/summaries").where(F.col("run") == run).select("path", "status")
    skipped = every.join(done, "path", "left_semi").withColumn("status", F.lit("skipped_existing"))
    total = every.agg(F.count("*").alias("total"))
    report = batch.counters(mine.unionByName(skipped).crossJoin(F.broadcast(total)), F.coalesce(F.max("total"), F.lit(0)))
    return report.withColumn("batch_status", batch.batch_status()).withColumn("run", F.lit(run))


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """What each file is, as one JSON text."""
    return read_store(spark, path, "files").select("path", F.to_json(F.struct("size", "variant", "version", "crypt", "readiness", "bbt_entries", "nbt_entries", "message")).alias("report"))
