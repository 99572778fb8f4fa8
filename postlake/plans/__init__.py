"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.plans import core, more  # noqa: F401 - registers its queries with core


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.QUERIES["m1_routing_counts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.ORACLE)
