"""Operator 2, LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; the decisions before it in the byte name one of 255 nodes. Each
such node has a context tree of its own that branches on the preceding bytes, up to ``depth`` of
them (before a document's beginning stand zero bytes). A tree node keeps how often its decision came
out 0 and 1 over the whole corpus, and weighs

    P_e = Krichevsky-Trofimov estimate of those counts
    P_w = P_e at the full depth, else (P_e + product of the children's P_w) / 2

The chance of the next decision mixes the KT predictions of all depths: at a node, the weight
P_e / (2 P_w) goes to its own prediction (a+1/2)/(a+b+1) and the rest to the deeper node on the
path; where that was never seen, and so has P_w = 1 and no counts, its prediction is 1/2. A
document's code length is the sum of -log2 over its bytes, and its score that by byte.

Plan: nothing that grows with the corpus is broadcast or held whole. A gram is a byte and the
``depth`` bytes before it.

1. Texts are put together in batches of about ``BATCH`` bytes, each one compressed value, and
   settled; so a batch is the same in every later step, however the input was made.
2. Each batch sends its distinct grams and their counts to buckets, which are cut by the nearest
   ROOT bytes: a bucket holds whole subtrees. How many there are follows from the counted bytes.
3. Each bucket adds its grams up and weighs its subtrees' roots; the levels above (at most 256**2
   contexts of 255 nodes, by the alphabet) are aggregated and broadcast.
4. Each bucket goes down from there, prices its distinct grams and answers each batch with the
   prices of the grams it sent, in their order; the batch adds them up by document.

Defined results: null and empty texts have no bytes, their bits are 0 and their score null; rows with
a null doc_id are scored but not counted apart (their id stays null); a repeated row counts and is
scored as often as it occurs, and equal texts get equal scores, so there are no ties to break; a text
of any length is scored in whole, as a batch of its own if need be; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import textvec as tv
from postlake.llm.common import only, settled

DEPTH = 6
#: A bucket holds all contexts that share so many of the nearest bytes.
ROOT = 3
#: Bytes of text that are counted together, and bytes of text a bucket.
BATCH, BUCKET = 1 << 24, 1 << 25
_LOG2 = np.log(2.0)
_LOG_PI = 1.1447298858494002
_SMALL = 1 << 16
_tables: list[np.ndarray] = []
_CODEC = pa.Codec("zstd", compression_level=1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2, by Stirling's series above 8 and the recurrence below."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    i = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of a zeros and b ones; small counts by table."""
    if not _tables:
        _tables.extend((log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)))
    half, one = _tables
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    small = a + b < _SMALL
    out = np.empty(len(a))
    x, y = (a, b) if small.all() else (a[small], b[small])
    x, y = x.astype(np.int64), y.astype(np.int64)
    out[small] = half[x] + half[y] - one[x + y] - _LOG_PI
    if not small.all():
        x, y = a[~small], b[~small]
        out[~small] = log_gamma(x + 0.5) + log_gamma(y + 0.5) - log_gamma(x + y + 1.0) - _LOG_PI
    return out


def _zip(x: np.ndarray) -> bytes:
    """Its bytes in planes, compressed: sorted numbers have nearly the same high bytes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unzip(blob: bytes, kind) -> np.ndarray:
    n, kind = int.from_bytes(blob[:8], "little"), np.dtype(kind)
    raw = np.frombuffer(_CODEC.decompress(blob[8:], n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel()


def grams(data: np.ndarray, offs: np.ndarray, depth: int) -> np.ndarray:
    """For each byte, its context and itself: the byte in the low 8 bits, above it the bytes before
    it, the nearest highest."""
    out = data.astype(tv.U)
    since = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, depth + 1):
        back = np.zeros(len(data), tv.U)
        back[k:] = data[:-k] if k < len(data) else []
        back[since < k] = 0
        out |= back << tv.U(8 * (depth - k + 1))
    return out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    g = np.concatenate([p[0] for p in parts])
    order = np.argsort(g, kind="stable")
    g = g[order]
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[: len(g)])
    n = np.concatenate([p[1] for p in parts])[order]
    return g[at], np.add.reduceat(n, at) if len(at) else n


def _batch_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(batch, bytes, docs): rows of (doc_id, text) put together; a batch is one row."""
    own, held, total = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal own
        table = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        own += 1
        cols = [pa.array([own - 1]), pa.array([total]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["batch", "bytes", "docs"])

    for batch in batches:
        text = tv.column(batch, "text")
        for i, j, data, _ in tv.pieces(text, size=size):
            held.append(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), text.slice(i, j - i)], ["doc_id", "text"]))
            total += len(data)
            if total >= size // 2:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()


def _docs(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def _buckets(u: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    return (tv.mix(u >> tv.U(8 * (depth - min(ROOT, depth) + 1))) % tv.U(buckets)).astype(np.int64)


def _pack_batches(batches: Iterator[pa.RecordBatch], depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, batch, grams, n): each batch's distinct grams and counts, for each bucket."""
    for batch in batches:
        for number, blob in zip(batch.column("batch").to_pylist(), batch.column("docs")):
            held = [np.unique(grams(data, offs, depth), return_counts=True) for _, _, data, offs in tv.pieces(_docs(blob.as_py()).column("text").combine_chunks()) if len(data)]
            if not held:
                continue
            u, n = _added(held)
            to = _buckets(u, depth, buckets)
            order = np.argsort(to, kind="stable")
            u, n, to = u[order], n[order], to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            ends = np.append(cut[1:], len(to))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cut]), pa.array([number] * len(cut), pa.int64()), *[pa.array([_zip(x[a:b]) for a, b in zip(cut, ends)], pa.binary()) for x in (u, n.astype(np.uint32))]],
                ["bucket", "batch", "grams", "n"],
            )


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, grams, n): the distinct grams of each bucket; rows come ordered by bucket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now, size, last = None, 0, 0

    def flush() -> pa.RecordBatch:
        u, n = _added(held)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_zip(u)], pa.binary()), pa.array([_zip(n)], pa.binary())], ["bucket", "grams", "n"])

    for batch in batches:
        for bucket, g, n in zip(*[batch.column(k).to_pylist() for k in ("bucket", "grams", "n")]):
            if held and bucket != now:
                yield flush()
                held, size, last = [], 0, 0
            now = bucket
            u = _unzip(g, np.uint64)
            held.append((u, np.zeros(len(u), np.int64) if n is None else _unzip(n, np.uint32).astype(np.int64)))
            size += len(u)
            if size > 1_000_000 + 2 * last:  # what is held is at most about three times what is distinct
                held = [_added(held)]
                size = last = len(held[0][0])
    if held:
        yield flush()


class Subtrees:
    """The subtrees over the distinct grams of a bucket, by levels from the deepest up to ``root``."""

    def __init__(self, u: np.ndarray, n: np.ndarray, depth: int, root: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = [(u, n.astype(np.float64), None)]
        for _ in range(depth - root):
            keys, counts, _ = self.levels[-1]
            up, inverse = np.unique(((keys >> tv.U(16)) << tv.U(8)) | (keys & tv.U(255)), return_inverse=True)
            self.levels.append((up, np.bincount(inverse, counts, len(up)), inverse))

    def nodes(self, k: int) -> list[tuple[np.ndarray, ...]]:
        """Of decision k at each level: (first gram of each node, node of each gram, a, b, ln P_w, weight that stays, bit of each gram)."""
        out: list[tuple[np.ndarray, ...]] = []
        for keys, counts, inverse in self.levels:
            prefix = keys >> tv.U(8 - k)
            fresh = np.concatenate([[True], prefix[1:] != prefix[:-1]])[: len(keys)]
            at, own = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            bit = ((keys >> tv.U(7 - k)) & tv.U(1)).astype(bool)
            b = np.add.reduceat(np.where(bit, counts, 0.0), at)
            a = np.add.reduceat(counts, at) - b
            pe = log_kt(a, b)
            if inverse is None:
                pw, stay = pe, np.ones(len(pe))
            else:
                below = np.bincount(own[inverse[out[-1][0]]], out[-1][4], len(at))
                pw = np.logaddexp(pe, below) - _LOG2
                stay = np.exp(pe - _LOG2 - pw)
            out.append((at, own, a, b, pw, stay, bit))
        return out

    def roots(self) -> list[np.ndarray]:
        """(context, node, a, b, ln P_w) at the root level."""
        parts = []
        keys = self.levels[-1][0]
        for k in range(8):
            at, _, a, b, pw, _, _ = self.nodes(k)[-1]
            parts.append(((keys[at] >> tv.U(8)).astype(np.int64), (keys[at] & tv.U(255) | tv.U(256)).astype(np.int64) >> (8 - k), a, b, pw))
        return [np.concatenate(x) for x in zip(*parts)]

    def costs(self, top: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """-log2 of the chance of each gram's byte. top: (keys, a, b, weight that stays) of the levels above, from the empty context on."""
        keys = self.levels[-1][0]
        byte = (keys & tv.U(255)).astype(np.int64)
        context = (keys >> tv.U(8)).astype(np.int64)
        total = np.zeros(len(self.levels[0][0]))
        for k in range(8):
            nodes = self.nodes(k)
            node, bit = (256 | byte) >> (8 - k), nodes[-1][6]
            p, left = np.zeros(len(keys)), np.ones(len(keys))
            for d, (names, a, b, stay) in enumerate(top):
                at = np.searchsorted(names, ((context >> 8 * (len(top) - d)) << 8) | node)
                # the outcome's own ratio, (a+1/2) or (b+1/2) over a+b+1: a rare one's would be lost in 1 - p
                p += left * stay[at] * (np.where(bit, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
                left *= 1 - stay[at]
            for x in range(len(nodes) - 1, -1, -1):
                _, own, a, b, _, stay, bit = nodes[x]
                if x < len(nodes) - 1:
                    inverse = self.levels[x + 1][2]
                    p, left = p[inverse], left[inverse]
                p += left * stay[own] * (np.where(bit, b[own], a[own]) + 0.5) / (a + b + 1)[own]
                left *= 1 - stay[own]
            total -= np.log2(p)
        return total


def _root_batches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g, n in zip(batch.column("grams"), batch.column("n")):
            cols = Subtrees(_unzip(g.as_py(), np.uint64), _unzip(n.as_py(), np.int64), depth, min(ROOT, depth)).roots()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["ctx", "node", "a", "b", "pw"])


def _weigh_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ln P_w and the weight that stays at a node to (ctx, node, a, b, below)."""
    for batch in batches:
        pe = log_kt(np.asarray(batch.column("a")), np.asarray(batch.column("b")))
        pw = np.logaddexp(pe, np.asarray(batch.column("below"))) - _LOG2
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("ctx", "node", "a", "b")], pa.array(pw), pa.array(np.exp(pe - _LOG2 - pw))], ["ctx", "node", "a", "b", "pw", "stay"])


def _top(roots: DataFrame, root: int) -> list[tuple[np.ndarray, ...]]:
    """The levels above the buckets' roots, from the empty context on: at most 65,536 contexts of
    255 nodes, whatever the corpus, come to the driver."""
    out: list[tuple[np.ndarray, ...]] = []
    level = roots
    for _ in range(root):
        level = level.groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("below"))
        # each level is read here and by the level above
        level = settled(level.mapInArrow(_weigh_batches, "ctx bigint, node bigint, a double, b double, pw double, stay double"))
        t = level.select(((F.col("ctx") * 256) + F.col("node")).alias("key"), "a", "b", "stay").toArrow()
        cols = [np.asarray(t.column(k).combine_chunks()) for k in ("key", "a", "b", "stay")]
        order = np.argsort(cols[0])
        out.insert(0, tuple(c[order] for c in cols))
    return out


def _answer_batches(batches: Iterator[pa.RecordBatch], top, depth: int) -> Iterator[pa.RecordBatch]:
    """(batch, bucket, costs): rows come by bucket, its distinct grams first and then what the batches sent."""
    u, cost = np.zeros(0, tv.U), np.zeros(0, np.float32)
    for batch in batches:
        for bucket, number, g, n in zip(*[batch.column(k).to_pylist() for k in ("bucket", "batch", "grams", "n")]):
            if number is None:
                u = _unzip(g, np.uint64)
                cost = Subtrees(u, _unzip(n, np.int64), depth, min(ROOT, depth)).costs(top.value).astype(np.float32)
            else:
                blob = _zip(cost[np.searchsorted(u, _unzip(g, np.uint64))])
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([bucket]), pa.array([blob], pa.binary())], ["batch", "bucket", "costs"])


def _total_batches(batches: Iterator[pa.RecordBatch], depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, bits): rows come by batch, its answers by bucket first and then its texts."""
    held: list[np.ndarray] = []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            if bucket < buckets:
                held.append(_unzip(blob.as_py(), np.float32))
                continue
            docs = _docs(blob.as_py())
            parts = []
            for i, j, data, offs in tv.pieces(docs.column("text").combine_chunks()):
                own, inverse = np.unique(grams(data, offs, depth), return_inverse=True)
                parts.append((i, j, offs, own, inverse.astype(np.int32)))
            u = np.unique(np.concatenate([p[3] for p in parts])) if parts else np.zeros(0, tv.U)
            cost = np.empty(len(u))
            cost[np.argsort(_buckets(u, depth, buckets), kind="stable")] = np.concatenate([*held, np.zeros(0, np.float32)])
            held = []
            for i, j, offs, own, inverse in parts:
                c = np.concatenate([[0.0], np.cumsum(cost[np.searchsorted(u, own)][inverse])])
                ids = docs.column("doc_id").combine_chunks().slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offs)), pa.array(c[offs[1:]] - c[offs[:-1]])], ["doc_id", "n_bytes", "bits"])


_PACKS = "bucket bigint, batch bigint, grams binary, n binary"


def _batched(texts: DataFrame, size: int) -> DataFrame:
    return settled(texts.mapInArrow(partial(_batch_batches, size=size), "batch bigint, bytes bigint, docs binary"))


def scored(docs: DataFrame, corpus: DataFrame | None = None, depth: int = DEPTH, batch_bytes: int = BATCH, bucket_bytes: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every document, by a tree over all of ``corpus``,
    which is the documents themselves unless given."""
    if not 0 <= depth <= 7:
        raise ValueError("contexts have 0 to 7 bytes")
    spark = docs.sparkSession
    texts = _batched(only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), batch_bytes)
    counted = texts if corpus is None else _batched(only(corpus, text="text").select(F.lit(None).cast("bigint").alias("doc_id"), "text"), batch_bytes)
    total = counted.agg(F.sum("bytes")).first()[0] or 0
    buckets = -(-total // bucket_bytes) or 1
    pack = partial(_pack_batches, depth=depth, buckets=buckets)
    packs = settled(texts.select("batch", "docs").mapInArrow(pack, _PACKS))
    adding = packs
    if corpus is not None:
        # the documents' own grams have a node, without counts; the corpus asks for no answer
        adding = packs.withColumn("n", F.lit(None).cast("binary")).unionByName(counted.select("batch", "docs").mapInArrow(pack, _PACKS))
    merged = settled(adding.select("bucket", "grams", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge_batches, "bucket bigint, grams binary, n binary"))
    root = min(ROOT, depth)
    roots = merged.select("grams", "n").mapInArrow(partial(_root_batches, depth=depth), "ctx bigint, node bigint, a double, b double, pw double")
    top = spark.sparkContext.broadcast(_top(roots, root))
    asked = merged.select("bucket", F.lit(None).cast("bigint").alias("batch"), "grams", "n").unionByName(packs.withColumn("n", F.lit(None).cast("binary")))
    answers = asked.repartition("bucket").sortWithinPartitions("bucket", F.col("batch").asc_nulls_first()).mapInArrow(partial(_answer_batches, top=top, depth=depth), "batch bigint, bucket bigint, costs binary")
    both = answers.select("batch", "bucket", F.col("costs").alias("blob")).unionByName(texts.select("batch", F.lit(buckets).cast("bigint").alias("bucket"), F.col("docs").alias("blob")))
    out = both.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(partial(_total_batches, depth=depth, buckets=buckets), "doc_id bigint, n_bytes bigint, bits double")
    return out.select("doc_id", "n_bytes", F.round("bits", 4).alias("bits"), F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 6)).alias("bits_per_byte"))
