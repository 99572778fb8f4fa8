"""Routing counts over items as they arrive, by event-time window. An extension of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.operators.routing import OUTCOMES, item_kind, routing_status


def arrival_counts(items: DataFrame, window: str = "10 minutes", late: str = "1 hour", **policy) -> DataFrame:
    """items(arrived timestamp, folder_key, message_class, visibility), streaming or not, to
    (begins, folder_key, item_count, <outcome>_count). Items later than ``late`` are left out of a
    stream; state is kept for open windows only."""
    s = F.col("s")
    d = items.withColumn("s", routing_status(item_kind(F.col("message_class")), F.col("visibility"), **policy))
    if items.isStreaming:
        d = d.withWatermark("arrived", late)
    g = d.groupBy(F.window("arrived", window).alias("w"), "folder_key")
    return g.agg(F.count("*").alias("item_count"), *[F.count_if(s.startswith(p)).alias(f"{n}_count") for n, p in OUTCOMES.items()]).select(F.col("w.start").alias("begins"), "folder_key", "item_count", *[f"{n}_count" for n in OUTCOMES])
