"""What the corpus operators share: reading tables, cutting lineage, checked sizes."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder that the cluster names
    in spark.checkpoint.dir. Only in a session on this one machine, as in tests, is a folder made
    where none is named; anywhere else other machines couldn't read it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="postlake-checkpoint-"))
    return df.checkpoint(eager=True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under fixed names: whatever else the input carries, and however
    it is called, can't clash with an operator's own columns."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in columns.items()])


def back_ticked(name: str) -> Column:
    return F.col(f"`{name}`")
