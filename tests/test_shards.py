"""Shards of files by size against a plain loop."""

import random

from pyspark.sql import functions as F

from postlake.operators import sinks


def _loop(rows, target):
    out, last = [], ...
    for g, path, size in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2] is not None, r[2])):
        if g != last:
            last, used, shard = g, 0, 0
        if used is None or size is None:
            used = None
        elif used > 0 and used + size > target:
            used, shard = size, shard + 1
        else:
            used += size
        out.append((g, path, size, shard))
    return out


def test_shards_follow_the_loop(spark):
    rnd = random.Random(5)
    rows = [(g, f"d{k:05d}", rnd.choice([0, 0, 7, 40, 99, 100, 101, 250])) for g in ("a", "b", None) for k in range(400)]
    rows += [("n", "d1", 60), ("n", "d2", 60), ("n", "d3", None), ("n", "d4", 900), ("n", "d4", 90), ("z", "d1", 0), ("z", "d2", 500)]
    rnd.shuffle(rows)
    got = sinks.shards(spark.createDataFrame(rows, "source string, path string, size bigint").repartition(7), 100, "source").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, _loop(rows, 100)))
    one = [r for r in rows if r[0] == "a"]
    got = sinks.shards(spark.createDataFrame(one, "source string, path string, size bigint").select("path", "size"), 100).collect()
    assert sorted(tuple(r) for r in got) == [r[1:] for r in _loop(one, 100)]


def test_a_group_is_gone_through_once(spark):
    """The plan gathers no group in a row and copies no list a file."""
    files = spark.range(3_000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("path"), (F.col("id") % 90).alias("size"), F.lit("s").alias("source"))
    out = sinks.shards(files, 1000, "source")
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3_000
