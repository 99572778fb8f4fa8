"""Operator 4, line dedup by an exact set-similarity join.

A line's tokens are its distinct lower-case runs of letters and digits. Two lines match when the
Jaccard similarity of their token sets is at least ``num/den``. Lines are ordered by (doc_id, line
number), then by their set's hash; a line goes when any earlier line matches it.

Plan: equal sets are one set with an earliest place, so a line that isn't at its set's earliest
place goes, however often it is repeated. For the rest:

1. Tokens are ordered by rarity: occurrences in all lines are counted in 2**20 hashed counters (a
   fixed size, whatever the corpus), and ties go by hash.
2. Each set emits its prefix tokens. Sets that match share a prefix token; one shuffle by token
   brings them together. Length and positional filters, and a parity sketch of 128 bits, whose
   difference is at most the sets' symmetric difference, leave the candidates. None of these loses
   a match.
3. Jaccard is verified on the token hashes themselves. One earlier match is enough, so each set's
   likeliest candidate is verified first; all the others follow for sets that are still unmatched.

Sizes: how many buckets the prefix entries go to follows from the counted tokens. The rarity counters
and the map of wanted sets are of a fixed size; beyond some 10**8 wanted sets the map lets most sets
through, and the join behind it drops them: that costs a larger shuffle and changes no result.

Defined results: null texts have no line; a text or line of any length is read in whole; lines without letters or digits match nothing and stay; a
null doc_id takes no part and its row stays as it is; rows with equal doc_id count as one document:
where they have the same set at the same line number, each keeps or loses it; an empty table gives
no rows; further columns are kept by ``without_lines`` and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm import textvec as tv
from postlake.llm.common import only, settled

NUM, DEN = 4, 5
_COUNTER_BITS = 20
_SLICES = 32
_ENTRY = np.dtype([("key", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("sig", "<i8"), ("p0", "<u8"), ("p1", "<u8")])
_PAIRS = 1 << 21
#: Bytes of prefix entries a bucket.
BUCKET = 1 << 24
_MAP_SLICES, _MAP_BITS = 6, 21


def counter(h: np.ndarray) -> np.ndarray:
    return (h >> tv.U(64 - _COUNTER_BITS)).astype(np.int64)


def line_sets(data: np.ndarray, offs: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, line number, hash of the set, token offsets, tokens) of the lines that have tokens.
    A set's tokens are in ascending order of (rank of their counter, hash)."""
    h, s, _, wo = tv.words(data, offs)
    doc = tv.owners(wo)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, s) - np.searchsorted(breaks, offs[:-1])[doc]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    own = np.cumsum(fresh) - 1
    at = np.flatnonzero(fresh)
    low = np.zeros(len(h), tv.U) if rank is None else rank[counter(h)].astype(tv.U)
    if len(at) < 1 << 22:
        key = (own.astype(tv.U) << tv.U(42)) | (low << tv.U(34)) | (h >> tv.U(30))
        order = np.argsort(key, kind="stable")
        key, g = key[order], h[order]
        if ((key[1:] == key[:-1]) & (g[1:] != g[:-1])).any():
            order = np.lexsort((h, low, own))
    else:
        order = np.lexsort((h, low, own))
    g, o = h[order], own[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[keep], o[keep]
    lo = np.searchsorted(o, np.arange(len(at) + 1))
    total = np.concatenate([np.zeros(1, tv.U), np.cumsum(tv.mix(g + tv.U(0x632BE59BD9B4E019)), dtype=tv.U)])
    sig = tv.mix(total[lo[1:]] - total[lo[:-1]] + np.diff(lo).astype(tv.U)).view(np.int64)
    return doc[at], line[at], sig, lo, g


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line's place (slice -1), and the task's token counts in slices."""
    counts = np.zeros(1 << _COUNTER_BITS, np.int64)
    names = ["slice", "counts", "sig", "doc", "line"]
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offs in tv.pieces(tv.column(batch, 1), lower=True):
            doc, line, sig, _, g = line_sets(data, offs)
            counts += np.bincount(counter(g), minlength=len(counts))
            none = pa.nulls(len(sig), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), -1, np.int32)), none, pa.array(sig), ids.slice(i, j - i).take(pa.array(doc)), pa.array(line.astype(np.int32))], names)
    if counts.any():
        blobs = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in counts.reshape(_SLICES, -1)]
        nothing = [pa.nulls(_SLICES, t) for t in (pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array(blobs, pa.binary()), *nothing], names)


def _add_up(group):
    total = sum(np.frombuffer(zlib.decompress(b), "<i8") for b in group.column("counts").to_pylist())
    return pa.table([group.column("slice").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])


def ranks(counts: list[tuple[int, bytes]]) -> np.ndarray:
    """A rarity rank of each counter: eight steps a doubling."""
    total = np.zeros(1 << _COUNTER_BITS, np.int64)
    for k, blob in counts:
        total.reshape(_SLICES, -1)[k] = np.frombuffer(blob, "<i8")
    return np.minimum(np.round(8 * np.log2(1 + total.astype(np.float64))), 255).astype(np.uint8)


def probe_prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tokens that a set has to share one of with any match that isn't longer."""
    return n - -(-num * n // den) + 1


def index_prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The same with any match that isn't shorter."""
    return n - -(-2 * num * n // (num + den)) + 1


def _entry_batches(batches: Iterator[pa.RecordBatch], rank, buckets: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Prefix entries; those of one batch for one bucket travel as one value."""
    for batch in batches:
        for _, _, data, offs in tv.pieces(tv.column(batch, 0), lower=True):
            _, _, sig, lo, g = line_sets(data, offs, rank.value)
            if not len(sig):
                continue
            n = np.diff(lo)
            bit = (tv.mix(g ^ tv.U(0x2545F4914F6CDD1D)) & tv.U(127)).astype(np.uint8)
            flag = tv.U(1) << (bit & 63).astype(tv.U)
            p = [np.bitwise_xor.reduceat(np.where((bit >> 6) == k, flag, tv.U(0)), lo[:-1]) for k in (0, 1)]
            _, first = np.unique(sig, return_index=True)
            size = probe_prefix(n[first], num, den)
            at = tv.ranges(lo[first], size)
            own = np.repeat(first, size)
            e = np.empty(len(at), _ENTRY)
            e["key"] = g[at] & tv.U(0xFFFFFFFF)
            e["n"], e["pos"], e["sig"], e["p0"], e["p1"] = n[own], at - lo[own], sig[own], p[0][own], p[1][own]
            to = (tv.mix(e["key"].astype(tv.U)) % tv.U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            e, to = e[order], to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array([e[x:y].tobytes() for x, y in zip(cut, np.append(cut[1:], len(to)))], pa.binary())], ["bucket", "packed"])


def candidates(e: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, other, parity distance) as indices into e, which is sorted by key, n and pos."""
    n, pos, key = e["n"].astype(np.int64), e["pos"].astype(np.int64), e["key"].astype(np.int64)
    # the shorter set of a pair comes first and needs to match within its index prefix
    left = np.flatnonzero(pos < index_prefix(n, num, den))
    wide = int(n.max(initial=0)) + 2
    end = np.searchsorted(key * wide + n, key[left] * wide + np.minimum(n[left] * den // num, wide - 1), "right")
    count = np.maximum(end - left - 1, 0)
    total = np.cumsum(count)
    out = []
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _PAIRS, "right")))
        j = tv.ranges(left[a:b] + 1, count[a:b])
        i = np.repeat(left[a:b], count[a:b])
        a = b
        need = -(-num * (n[i] + n[j]) // (num + den))
        most = np.minimum(pos[i], pos[j]) + 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
        ok = most >= need
        i, j, need = i[ok], j[ok], need[ok]
        apart = np.bitwise_count(e["p0"][i] ^ e["p0"][j]).astype(np.int64) + np.bitwise_count(e["p1"][i] ^ e["p1"][j])
        ok = (apart <= n[i] + n[j] - 2 * need) & (e["sig"][i] != e["sig"][j])
        i, j, apart = i[ok], j[ok], apart[ok]
        out.append((i, j, apart))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*out))


def _meet(group, num: int, den: int):
    """The candidate pairs of a bucket, each once, the smaller hash first."""
    e = np.frombuffer(b"".join(group.column(1).to_pylist()), _ENTRY)
    e = e[np.lexsort((e["sig"], e["pos"], e["n"], e["key"]))]
    fresh = np.ones(len(e), bool)  # what several tasks emit of one set is the same
    fresh[1:] = (e["key"][1:] != e["key"][:-1]) | (e["sig"][1:] != e["sig"][:-1])
    e = e[fresh]
    i, j, apart = candidates(e, num, den)
    a, b = np.minimum(e["sig"][i], e["sig"][j]), np.maximum(e["sig"][i], e["sig"][j])
    order = np.lexsort((b, a))
    a, b, apart = a[order], b[order], apart[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table([pa.array(a[keep]), pa.array(b[keep]), pa.array(apart[keep].astype(np.int32))], ["a", "b", "apart"])


def _spot(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slice and bit of a set in the map of wanted sets."""
    u = sig.view(tv.U)
    return (u >> tv.U(64 - _MAP_SLICES)).astype(np.int64), ((u >> tv.U(64 - _MAP_SLICES - _MAP_BITS)) & tv.U((1 << _MAP_BITS) - 1)).astype(np.int64)


def _mark(group):
    bits = np.zeros(1 << _MAP_BITS, bool)
    part, at = _spot(group.column("sig").to_numpy())
    bits[at] = True
    return pa.table([pa.array(part[:1].astype(np.int32)), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["slice", "bits"])


def _token_batches(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """The token sets that the map of wanted sets lets through; it never keeps back a wanted one."""
    for batch in batches:
        for _, _, data, offs in tv.pieces(tv.column(batch, 0), lower=True):
            _, _, sig, lo, g = line_sets(data, offs)
            _, one = np.unique(sig, return_index=True)
            part, at = _spot(sig[one])
            one = one[(wanted.value[part, at >> 3] >> (7 - (at & 7))) & 1 == 1]
            yield pa.RecordBatch.from_arrays([pa.array(sig[one]), pa.array([g[lo[k] : lo[k + 1]].tobytes() for k in one], pa.binary())], ["sig", "tokens"])


def common(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each a, of each b, tokens in both) of two columns of packed token sets."""
    flat, own, size = [], [], []
    for col in (a, b):
        data, offs = tv.raw(col)
        size.append(np.diff(offs) // 8)
        flat.append(np.frombuffer(data.tobytes(), tv.U))
        own.append(np.repeat(np.arange(len(col)), size[-1]))
    token, pair = np.concatenate(flat), np.concatenate(own)
    order = np.lexsort((token, pair))
    token, pair = token[order], pair[order]
    # a set has a token once, so equal neighbours are one of each
    both = np.flatnonzero((token[1:] == token[:-1]) & (pair[1:] == pair[:-1]))
    return size[0], size[1], np.bincount(pair[both], minlength=len(a))


def _verify_batches(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m, both = common(batch.column("ty"), batch.column("tx"))
        yield pa.RecordBatch.from_arrays([batch.column("y").filter(pa.array((num + den) * both >= num * (n + m)))], ["y"])


def _token_sets(pairs: DataFrame, src: DataFrame) -> DataFrame:
    """(sig, tokens) of every set in a pair. Which sets are wanted is told to the tasks by a map of
    2**27 bits, a fixed 16 MB: what it lets through by chance is dropped by the join, and the texts
    themselves aren't shuffled."""
    wanted = pairs.select(F.explode(F.array("y", "x")).alias("sig")).distinct()
    marks = np.zeros((1 << _MAP_SLICES, 1 << (_MAP_BITS - 3)), np.uint8)
    rows = wanted.groupBy(F.shiftrightunsigned("sig", 64 - _MAP_SLICES).alias("k")).applyInArrow(_mark, "slice int, bits binary")
    for r in rows.collect():
        marks[r.slice] = np.frombuffer(bytes(r.bits), np.uint8)
    sent = src.sparkSession.sparkContext.broadcast(marks)
    found = src.select("text").mapInArrow(partial(_token_batches, wanted=sent), "sig bigint, tokens binary")
    return found.join(wanted, "sig", "left_semi").dropDuplicates(["sig"])


def _verified(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """The sets y of the pairs that match."""
    y, x = tokens.select(F.col("sig").alias("sy"), F.col("tokens").alias("ty")), tokens.select(F.col("sig").alias("sx"), F.col("tokens").alias("tx"))
    both = pairs.select("y", "x").join(y, F.col("y") == F.col("sy")).join(x, F.col("x") == F.col("sx")).select("y", "ty", "tx")
    return both.mapInArrow(partial(_verify_batches, num=num, den=den), "y bigint").distinct()


def removed_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, line): the lines that go, counted from 0 in their document."""
    if not 0 < num <= den:
        raise ValueError("the threshold num/den is above 0 and at most 1")
    spark = docs.sparkSession
    src = only(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    places = settled(src.mapInArrow(_place_batches, "slice int, counts binary, sig bigint, doc bigint, line int"))
    counts = places.where("slice >= 0").select("slice", "counts").groupBy("slice").applyInArrow(_add_up, "slice int, counts binary")
    # 2**20 counters, of a size that doesn't depend on the input
    tokens_seen = counts.collect()
    rank = spark.sparkContext.broadcast(ranks([(r.slice, bytes(r.counts)) for r in tokens_seen]))
    # a set's prefix has at most a fifth of its tokens and one more at the production threshold; most have a token
    # or two, so twice that is close to the entries: a bucket holds about BUCKET bytes of them at every size
    total = sum(int(np.frombuffer(bytes(r.counts), "<i8").sum()) for r in tokens_seen)
    buckets = int(2 * (1 - num / den) * total * _ENTRY.itemsize) // BUCKET + 1
    entries = src.select("text").mapInArrow(partial(_entry_batches, rank=rank, buckets=buckets, num=num, den=den), "bucket bigint, packed binary")
    pairs = entries.groupBy("bucket").applyInArrow(lambda group: _meet(group, num, den), "a bigint, b bigint, apart int")
    # one shuffle by a serves the distinct pairs and the join
    pairs = pairs.repartition("a").dropDuplicates(["a", "b"])
    spots = places.where("slice < 0").select("sig", F.struct("doc", "line").alias("spot"))
    firsts = spots.groupBy("sig").agg(F.min("spot").alias("first"))
    one = firsts.select(F.col("sig").alias("a"), F.struct("first", F.col("sig").alias("sig")).alias("pa"))
    two = firsts.select(F.col("sig").alias("b"), F.struct("first", F.col("sig").alias("sig")).alias("pb"))
    # the later set of a pair is y, and its candidates are ordered by likelihood
    met = pairs.join(one, "a").join(two, "b").select(F.greatest("pa", "pb").alias("y"), F.least("pa", "pb").alias("x"), "apart")
    met = met.select(F.col("y.sig").alias("y"), F.col("x.sig").alias("x"), "apart")
    met = settled(met.withColumn("turn", F.row_number().over(Window.partitionBy("y").orderBy("apart", "x"))))
    tokens = settled(_token_sets(met, src))
    sure = settled(_verified(met.where("turn = 1"), tokens, num, den))
    more = settled(met.where("turn > 1").join(sure, "y", "left_anti"))
    matched = sure.unionByName(_verified(more, tokens, num, den)).select(F.col("y").alias("sig"), F.lit(True).alias("matched"))
    all_ = spots.join(firsts, "sig").join(matched, "sig", "left").where("matched or spot <> first")
    return all_.select(F.col("spot.doc").alias("doc_id"), F.col("spot.line").alias("line")).distinct()


def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, gone = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1)
        texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
        for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
            drop = set(gone[k].as_py())
            texts[k] = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in drop)
            keep[k] = bool(texts[k].strip())
        cols = batch.columns[:-1]
        cols[at] = pa.array(texts, batch.column(at).type)
        yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1]).filter(pa.array(keep))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without those lines, with all their columns. A document that lost lines and
    has only white space left is left out: it holds nothing that isn't earlier in the corpus."""
    gone = removed.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    both = docs.join(gone, docs["doc_id"] == gone["__doc"], "left").select(*[docs[f"`{c}`"] for c in docs.columns], "__gone")
    return both.mapInArrow(_strip_batches, docs.schema)


def oracle(num: int = NUM, den: int = DEN) -> str:
    """The same by counting every pair's common tokens, as one DuckDB statement."""
    return f"""
WITH lines AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
               FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
places AS (SELECT doc_id, CAST(line AS INTEGER) AS line, list_sort(list_distinct(regexp_extract_all(t, '[0-9a-zA-Z\\x{{80}}-\\x{{10FFFF}}]+'))) AS s FROM lines),
firsts AS (SELECT s, min((doc_id, line)) AS f, CAST(len(s) AS BIGINT) AS n FROM places WHERE len(s) > 0 GROUP BY s),
sets AS (SELECT *, row_number() OVER () AS k FROM firsts),
tokens AS (SELECT k, f, n, unnest(s) AS w FROM sets),
pairs AS (SELECT a.k, a.n, b.n AS m, count(*) AS common FROM tokens a JOIN tokens b ON a.w = b.w AND b.f < a.f AND {num} * b.n <= {den} * a.n AND {num} * a.n <= {den} * b.n GROUP BY a.k, b.k, a.n, b.n),
hit AS (SELECT DISTINCT k FROM pairs WHERE {num + den} * common >= {num} * (n + m))
SELECT DISTINCT p.doc_id, p.line FROM places p JOIN sets USING (s) WHERE (p.doc_id, p.line) <> sets.f OR k IN (SELECT k FROM hit)
"""
