"""Cutting lineage where a loop would grow it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of spark.checkpoint.dir. Only in a session on this one
    machine, as in tests, is a folder made where none is named."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="postlake-checkpoint-"))
    return df.checkpoint(eager=True)
