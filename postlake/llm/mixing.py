"""Operator 5, mixing sources to target weights by Sainte-Lague apportionment.

Every source's documents are laid end to end in a seeded order and cut into blocks of
``block_tokens`` tokens (white-space separated words); a document may lie in several blocks, and
only a source's last block is shorter, so every token is in a block and the smallest source has one.
Blocks go to shards in turn, in a seeded order. Each shard has ``shard_blocks`` seats, or the part
``share`` of its blocks, given one by one to the source with the highest quotient
weight / (2 * seats so far + 1), ties to the smaller name, among sources that have a block left in
that shard. Of each source's blocks in a shard as many as it has seats are then taken, by a seeded
order. Shards thus get integer quotas that follow the weights as closely as whole blocks can.

What a mix leaves out is its purpose: with ``share`` 1 every block is taken and the weights mean
nothing. The production share is a half.

Plan: a source may hold half of all tokens, so every order is cut into 4096 lanes by the first digits
of its hash; lanes are summed, their starts come from the sums, and one task orders only lanes.
Blocks are made lane by lane, and ranked lane by lane. The quotas come from one number a source and
shard, its blocks: the quotient at which the seats end is found by bisection, and only what lies
about it is given out seat by seat. A shard's task holds as many rows as there are weighted sources.

Defined results: a null source is a source of its own, shown as null; null and wordless texts have
no tokens and are in no block; rows with a null doc_id are ignored; repeated rows count as often as
they occur; texts of any length are laid out in whole; equal quotients go to the smaller name, null
first; sources without a target weight, and weights that are null, zero or below, get no seat;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import only, settled

BLOCK_TOKENS = 2000
SHARDS = 8
SHARE = 0.5
SEED = 17


def target_weights(docs: DataFrame) -> DataFrame:
    """The production mix: a source's weight is the square root of its share of the documents, so
    that large sources are dampened; per-mille integers keep quotients exact to compare."""
    n = only(docs, source="source").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", F.floor(F.sqrt(F.col("n").cast("double")) * 1000).cast("bigint").alias("weight"))


def _key(*parts):
    """The first 60 bits of an md5 over the parts: the same number in any SQL engine."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else F.lit(str(p)) for p in parts]))


def _lanes(d: DataFrame, keys: list[str], amount) -> DataFrame:
    """(*keys, l, start, t): where each lane of a group begins, and what it holds. Keys are null-safe."""
    lane = d.groupBy(*keys, F.col("lane").alias("l")).agg(amount.alias("t"))
    before = Window.partitionBy(*keys).orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    return lane.withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0)))


def _documents(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, tokens, txt, k, lane): a few numbers a document, settled, so the texts are read once."""
    d = only(docs, doc_id="doc_id", source="source", text="text").where("doc_id is not null and text is not null")
    d = d.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")).cast("bigint").alias("tokens"), F.xxhash64("text").alias("txt"))
    d = d.where("tokens > 0").withColumn("k", _key(seed, "doc_id"))
    return settled(d.withColumn("lane", F.substring("k", 1, 3)))


def _placed(d: DataFrame, lanes: DataFrame) -> DataFrame:
    own = Window.partitionBy("source", "lane").orderBy("k", "doc_id", "tokens", "txt").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    lanes = lanes.select(F.col("source").alias("s"), "l", "start")
    j = d.join(lanes, d["source"].eqNullSafe(lanes["s"]) & (d["lane"] == lanes["l"]))
    return j.select("source", "doc_id", "tokens", (F.col("start") + F.col("within")).alias("first"))


def laid_out(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, tokens, first): where each document's tokens begin in its source."""
    d = _documents(docs, seed)
    return _placed(d, _lanes(d, ["source"], F.sum("tokens")))


def apportioned(weight: np.ndarray, name: list, n: np.ndarray, seats: int) -> np.ndarray:
    """How many seats each source has, of at most n, by highest quotients weight/(2k-1)."""
    seats = min(seats, int(n.sum()))
    if not seats:
        return np.zeros(len(n), np.int64)

    def above(q: float) -> np.ndarray:
        # one less than the formula says, so that rounding never counts a quotient below q
        return np.clip(np.floor((weight / q + 1) / 2) - 1, 0, n).astype(np.int64)

    low, high = weight.min() / (2.0 * n.max() + 1), weight.max() * 2.0
    for _ in range(200):
        middle = (low * high) ** 0.5
        # of quotients above ``high`` there are never more than seats
        low, high = (middle, high) if np.minimum(above(middle) + 2, n).sum() > seats else (low, middle)
    took = above(high)
    place = {i: r for r, i in enumerate(sorted(range(len(name)), key=lambda i: (name[i] is not None, name[i] or "")))}
    heap = [(-(weight[i] / (2 * took[i] + 1)), place[i], i) for i in range(len(n)) if took[i] < n[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(took.sum())):
        _, r, i = heapq.heappop(heap)
        took[i] += 1
        if took[i] < n[i]:
            heapq.heappush(heap, (-(weight[i] / (2 * took[i] + 1)), r, i))
    return took


def _quotas(group, shard_blocks: int | None, share: float):
    """The quotas of one shard; a source without weight adds to the blocks alone (pa.Table to pa.Table)."""
    n, weight, name = group.column("n").to_numpy(), group.column("weight"), group.column("source").to_pylist()
    seats = int(np.floor(n.sum() * share)) if shard_blocks is None else shard_blocks
    has = np.flatnonzero(weight.is_valid().to_numpy())
    took = apportioned(weight.take(pa.array(has)).to_numpy().astype(np.float64), [name[i] for i in has], n[has], seats) if len(has) else np.zeros(0, np.int64)
    return pa.table([group.column("shard").take(pa.array(has)), pa.array([name[i] for i in has], pa.string()), pa.array(took)], ["qs", "qn", "quota"])


def mixed(docs: DataFrame, weights: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, shard_blocks: int | None = None, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(shard, source, block, doc_id, first_token, end_token): the parts of documents that are
    taken; tokens count from the document's beginning."""
    d = _documents(docs, seed)
    lanes = _lanes(d, ["source"], F.sum("tokens"))
    laid = _placed(d, lanes)
    w = only(weights, source="source", weight="weight").where("weight > 0").groupBy("source").agg(F.max("weight").alias("weight"))
    # a block belongs to the lane in which it begins
    blocks = lanes.select("source", F.expr(f"start div {block_tokens} + if(start % {block_tokens} = 0, 0, 1)").alias("a"), F.expr(f"(start + t - 1) div {block_tokens}").alias("b"))
    blocks = blocks.where("a <= b").select("source", F.explode(F.sequence("a", "b")).alias("block")).withColumn("k", _key(seed, "source", "block"))
    blocks = blocks.withColumn("shard", F.conv(F.substring("k", 1, 6), 16, 10).cast("bigint") % shards).withColumn("lane", F.substring("k", 1, 3))
    places = settled(_lanes(blocks, ["shard", "source"], F.count("*")))
    counts = places.groupBy("shard", "source").agg(F.sum("t").alias("n"))
    w = w.select(F.col("source").alias("ws"), F.col("weight").cast("double").alias("weight"))
    counts = counts.join(w, counts["source"].eqNullSafe(w["ws"]), "left").select("shard", "source", "n", "weight")
    quota = counts.groupBy("shard").applyInArrow(lambda group: _quotas(group, shard_blocks, share), "qs bigint, qn string, quota bigint")
    # lanes that begin beyond the quota are left before anything is ranked
    open_ = places.join(quota, (F.col("shard") == F.col("qs")) & F.col("source").eqNullSafe(F.col("qn"))).where("start < quota").select("qs", "qn", "l", "start", "quota")
    own = blocks.join(open_, (F.col("shard") == F.col("qs")) & F.col("source").eqNullSafe(F.col("qn")) & (F.col("lane") == F.col("l")))
    seat = F.row_number().over(Window.partitionBy("shard", "source", "lane").orderBy("k", "block")) + F.col("start")
    taken = own.withColumn("seat", seat).where("seat <= quota").select(F.col("source").alias("bs"), "block", "shard")
    parts = laid.select("source", "doc_id", "tokens", "first", F.explode(F.sequence(F.expr(f"first div {block_tokens}"), F.expr(f"(first + tokens - 1) div {block_tokens}"))).alias("b"))
    out = parts.join(taken, parts["source"].eqNullSafe(taken["bs"]) & (parts["b"] == taken["block"]))
    start = F.greatest(F.col("block") * block_tokens - F.col("first"), F.lit(0))
    return out.select("shard", "source", "block", "doc_id", start.alias("first_token"), F.least((F.col("block") + 1) * block_tokens - F.col("first"), "tokens").alias("end_token"))


def oracle(block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, share: float = SHARE, seed: int = SEED, documents: str = "documents") -> str:
    """The same, independently, as one DuckDB statement over ``documents``."""
    return f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, CAST(floor(sqrt(CAST(n AS DOUBLE)) * 1000) AS BIGINT) AS weight FROM n),
d0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS tokens, text,
       md5('{seed}:' || CAST(doc_id AS VARCHAR)) AS k FROM {documents} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT * FROM d0 WHERE tokens > 0),
laid AS (SELECT source, doc_id, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS BIGINT) AS first FROM d),
blocks0 AS (SELECT source, unnest(range(CAST(ceil(sum(tokens) / {block_tokens}) AS BIGINT))) AS block FROM d GROUP BY source),
blocks AS (SELECT source, block, md5('{seed}:' || coalesce(source, '') || ':' || CAST(block AS VARCHAR)) AS k FROM blocks0),
ranked0 AS (SELECT *, CAST(('0x' || substr(k, 1, 6)) AS BIGINT) % {shards} AS shard FROM blocks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shard, source ORDER BY k, block) AS seat FROM ranked0),
size AS (SELECT shard, CAST(floor(count(*) * {share}) AS BIGINT) AS seats FROM ranked GROUP BY shard),
won AS (SELECT r.shard, r.source, r.block, row_number() OVER (PARTITION BY r.shard ORDER BY CAST(w.weight AS DOUBLE) / (2 * r.seat - 1) DESC, r.source ASC NULLS FIRST, r.seat) AS place
        FROM ranked r JOIN w ON r.source IS NOT DISTINCT FROM w.source WHERE w.weight > 0),
taken AS (SELECT won.shard, source, block FROM won JOIN size ON won.shard = size.shard WHERE place <= seats)
SELECT t.shard, t.source, t.block, l.doc_id, greatest(t.block * {block_tokens} - l.first, 0) AS first_token, least((t.block + 1) * {block_tokens} - l.first, l.tokens) AS end_token
FROM laid l JOIN taken t ON l.source IS NOT DISTINCT FROM t.source AND l.first < (t.block + 1) * {block_tokens} AND l.first + l.tokens > t.block * {block_tokens}
"""
