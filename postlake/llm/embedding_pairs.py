"""Operator 7, embedding near-dedup by int8 tile products with error bounds.

Every vector x is scaled to length 1 and quantised to x^ = s*q, q of int8; the length e of what is
lost, x - x^, is measured and rounded up. For two vectors

    |x.y - x^.y^| <= |x^|*e_y + e_x

so a pair whose quantised product plus that bound stays below the threshold can't reach it. Blocks
of vectors meet once a pair of blocks. A tile of q.q products is an exact integer matrix product
(in float32 arithmetic, where sums below 2**24 are exact), compared with one bound a row; what
passes is held against the pair's own bound, and only what passes that too is recomputed from the
full-precision vectors. No pair at or above the threshold is lost.

Copies are one class first: equal vectors are compared once, under their smallest vec_id, and what is
returned is a row a vector, with its class and the number of different vectors it is linked with, or
the pairs between classes; copies aren't expanded into pairs.

Blocks hold about ``block`` vectors. They are laid out in a grid of super-tiles of up to 8 by 8
blocks, so a block is sent once a row of super-tiles and not once a partner block, and a task holds
16 blocks of bytes and one tile, whatever the table's size. All pairs of different vectors are
compared, so the arithmetic grows with the square of their number.

Defined results: a null vector, one with a null, NaN or infinite element and one of length 0 has no
row and no link; vectors of different dimension are never compared; a null vec_id is ignored; a
repeated row counts once, a vec_id with several vectors has a row for each; equal similarities need no
order, a pair counts if it is at or above the threshold; vectors of any dimension are compared in
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import only, settled

THRESHOLD = 0.9
BLOCK = 8192
TILE = 2048
#: Above the rounding errors of float64 sums and of the float32 scales in the bounds.
SLACK = 1e-6


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error bound, length of the quantised vector) of rows of length 1."""
    s = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    return q, s, np.sqrt(((x - back) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12, np.sqrt((back**2).sum(axis=1))


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _block(group):
    """One block's vectors, packed (pa.Table to pa.Table)."""
    dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
    x = _rows(group.column("v").combine_chunks(), dim)
    x = x / np.sqrt((x**2).sum(axis=1))[:, None]
    q, s, e, a = quantised(x)
    values = [group.column("k").combine_chunks().to_numpy().tobytes(), q.tobytes(), np.stack([s, e, a]).tobytes()]
    return pa.table([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], ["dim", "block", "ids", "q", "f"])


def possible(qa, fa, qb, fb, threshold: float, same: bool, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two blocks that may reach the threshold; of one block with itself, i < j."""
    sa, ea, la = fa
    sb, eb, lb = fb
    for j in range(0, len(qb), tile):
        right = qb[j : j + tile].astype(np.float32).T
        top_e, top_s = eb[j : j + tile].max(), sb[j : j + tile].max()
        for i in range(0, min(len(qa), j + tile) if same else len(qa), tile):
            need = threshold - SLACK - la[i : i + tile] * top_e - ea[i : i + tile]
            # a need of 0 or less excludes nothing
            bound = np.where(need > 0, need / (sa[i : i + tile] * top_s), -np.inf)
            g = qa[i : i + tile].astype(np.float32) @ right
            x, y = np.nonzero(g >= (np.floor(bound) - 1)[:, None].astype(np.float32))
            dot, x, y = g[x, y].astype(np.float64), x + i, y + j
            ok = dot * sa[x] * sb[y] + la[x] * eb[y] + ea[x] >= threshold - SLACK
            if same:
                ok &= x < y
            yield x[ok], y[ok]


def _super_tile(group, threshold: float):
    """The pairs of a super-tile's blocks that may reach the threshold (pa.Table to pa.Table)."""
    dim, i, j = (group.column(k)[0].as_py() for k in ("dim", "i", "j"))
    view = lambda v, t, *shape: np.frombuffer(v.as_buffer(), t).reshape(*shape)
    cols = [group.column(k).combine_chunks() for k in ("block", "own", "ids", "q", "f")]
    blocks = sorted(((b.as_py(), o.as_py(), view(d, np.int64, -1), view(q, np.int8, -1, dim), view(f, np.float64, 3, -1)) for b, o, d, q, f in zip(*cols)), key=lambda x: x[0])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m, (a, own, ids, q, f) in enumerate(blocks):
        # of a super-tile on the diagonal every pair of blocks, else those of one side with the other's
        for b, other, ids2, q2, f2 in blocks[m:]:
            if i == j or own != other:
                for x, y in possible(q, f, q2, f2, threshold, a == b):
                    left.append(ids[x])
                    right.append(ids2[y])
    return pa.table([np.concatenate(left), np.concatenate(right)], ["a", "b"])


def _verify_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x, y = _rows(part.column("va"), dim), _rows(part.column("vb"), dim)
            cos = (x * y).sum(axis=1) / np.sqrt((x**2).sum(axis=1) * (y**2).sum(axis=1))
            ok = pa.array(cos >= threshold)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok), pa.array(np.round(cos, 6)).filter(ok)], ["a", "b", "cosine"])


def _sound(embeddings: DataFrame) -> DataFrame:
    """(id, v, dim): the vectors that can be compared, each once an id."""
    v = only(embeddings, id="vec_id", v="embedding").where("id is not null and v is not null")
    v = v.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    sound = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < 1e150) and exists(v, x -> abs(x) > 1e-150)"
    return v.where(sound).distinct().withColumn("dim", F.size("v"))


def _classes(v: DataFrame) -> DataFrame:
    """(k, class_id, copies, v, dim): the different vectors, numbered; settled, so a number stays."""
    c = v.groupBy("v").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"))
    return settled(c.withColumn("k", F.monotonically_increasing_id()))


def _class_pairs(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b, cosine): the pairs of classes at or above the threshold, each once."""
    # the sizes by dimension are a handful of numbers
    sizes = classes.groupBy("dim").count().select(F.col("dim").alias("d"), F.ceil(F.col("count") / block).cast("bigint").alias("blocks"))
    # up to 8 blocks a side of a super-tile, as long as 16 sides are left
    sizes = sizes.withColumn("side", F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.col("blocks") / 16))).cast("bigint"))
    placed = classes.join(F.broadcast(sizes), F.col("dim") == F.col("d")).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))
    packed = settled(placed.select("dim", "block", "k", "v").groupBy("dim", "block").applyInArrow(_block, "dim int, block bigint, ids binary, q binary, f binary"))
    own = F.floor(F.col("block") / F.col("side")).cast("bigint")
    last = F.floor((F.col("blocks") - 1) / F.col("side")).cast("bigint")
    sent = packed.join(F.broadcast(sizes), F.col("dim") == F.col("d")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    sent = sent.select("dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "block", "own", "ids", "q", "f")
    pairs = sent.groupBy("dim", "i", "j").applyInArrow(lambda group: _super_tile(group, threshold), "a bigint, b bigint")
    one = classes.select(F.col("k").alias("ka"), F.col("v").alias("va"), F.col("dim"))
    two = classes.select(F.col("k").alias("kb"), F.col("v").alias("vb"))
    full = pairs.join(one, F.col("a") == F.col("ka")).join(two, F.col("b") == F.col("kb")).select("a", "b", "dim", "va", "vb")
    return full.mapInArrow(partial(_verify_batches, threshold=threshold), "a bigint, b bigint, cosine double")


def _checked(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")


def near_pairs(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_a, vec_b, cosine) of the pairs of classes at or above the threshold, a class by its
    smallest vec_id, vec_a < vec_b; the highest similarity where such ids have several vectors."""
    _checked(threshold)
    c = _classes(_sound(embeddings))
    a, b = c.select(F.col("k").alias("a"), F.col("class_id").alias("ca")), c.select(F.col("k").alias("b"), F.col("class_id").alias("cb"))
    p = _class_pairs(c, threshold, block).join(a, "a").join(b, "b").where("ca <> cb")
    return p.groupBy(F.least("ca", "cb").alias("vec_a"), F.greatest("ca", "cb").alias("vec_b")).agg(F.max("cosine").alias("cosine"))


def linked(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, copies, links): a row for each vector. class_id is the smallest vec_id of
    the equal vectors, copies how many vec_ids these have, links how many other different vectors
    are at or above the threshold."""
    _checked(threshold)
    v = _sound(embeddings)
    c = _classes(v)
    p = _class_pairs(c, threshold, block)
    counts = p.select(F.explode(F.array("a", "b")).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    c = c.join(counts, F.col("k") == F.col("e"), "left").select(F.col("v").alias("cv"), "class_id", "copies", F.coalesce("n", F.lit(0)).alias("links"))
    return v.join(c, F.col("v") == F.col("cv")).select(F.col("id").alias("vec_id"), "class_id", "copies", "links")


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
c AS (SELECT *, row_number() OVER () AS k FROM (SELECT v, min(vec_id) AS class_id, count(*) AS copies FROM v GROUP BY v)),
l AS (SELECT a.k, count(*) AS links FROM c a JOIN c b ON a.k <> b.k WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD} GROUP BY a.k)
SELECT vec_id, class_id, copies, coalesce(links, 0) AS links FROM v JOIN c USING (v) LEFT JOIN l USING (k)
"""
