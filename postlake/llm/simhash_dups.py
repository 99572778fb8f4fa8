"""Operator 10, SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint has ``BLOCKS`` words of ``WIDTH`` bits: bit b is the sign of the sum, over
the document's distinct words, of +1 or -1 by bit b of the word's hash. Two fingerprints are near when
they differ in at most ``radius_share`` of their bits.

Search: each block is a fingerprint of its own with radius 2. It emits all 33 variants within half
that radius (itself and each single flip); two blocks at distance 2 or less share a variant, so the
shuffle on (block number, variant) brings them together. A pair meets if any block is that close.
Before that each document is held against the first one with an equal block, and what is connected
has one label. A set of one label adds nothing and ends where it is found; across labels all is
verified on the whole fingerprint. The verified pairs' connected components are the groups.

Guarantee: any pair at Hamming distance up to 3*BLOCKS-1 = 59 is found for sure (pigeonhole). Beyond,
up to the verified radius of 96, a pair is met with a chance that falls to 0.93 at the radius itself;
the tests hold both, by distance. A ball of half of 96 around a whole fingerprint of 640 bits has
more members than there are documents, so the whole radius can't be covered for sure. Blocks are as
wide as they are because documents of one language share bits: narrower ones collide without being near.

Sizes: variants are shuffled by block number and first bits; how many bits follows from the counted
fingerprints, so a bucket holds about ``BUCKET`` bytes of variants at every size. Variants that share
these bits are made from their block where they meet, and don't travel one by one. Documents with one
block and one label are one class there. A set goes on as its pairs across labels where these are few
(a large family and a stranger), else as a whole, a row a member, in buckets of counted size. In a set,
a family of mutually near fingerprints is joined from its first member on, each step against what isn't
joined yet, and not by all its pairs.

Defined results: a null or wordless text has no fingerprint and joins no group; a null doc_id is
ignored; a doc_id that is repeated counts once (under each text it has); documents with equal
fingerprints are always grouped, whatever their number; the kept document of a group is the one
with the smallest doc_id, so ties can't be; texts of any length are read in whole. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import textvec as tv
from postlake.llm.common import only, settled

BLOCKS, WIDTH = 20, 32
RADIUS_SHARE = 0.15
#: Bytes of variants a bucket.
BUCKET = 1 << 25
#: Pairs a member, up to which a set that shares a variant goes on as pairs.
FEW = 4
_ENTRY = np.dtype([("key", "<u4"), ("label", "<i8"), ("id", "<i8")])


def _unique_words(h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each document (56 bits of them), with offsets."""
    who = tv.owners(wo)
    out, cuts = [], [0]
    for a in range(0, len(wo) - 1, 256):  # the row takes the 8 bits that the hash leaves
        b = min(a + 256, len(wo) - 1)
        x = (h[wo[a] : wo[b]] >> tv.U(8)) | ((who[wo[a] : wo[b]] - a).astype(tv.U) << tv.U(56))
        x = np.unique(x)
        n = np.bincount((x >> tv.U(56)).astype(np.int64), minlength=b - a)
        out.append(x & tv.U((1 << 56) - 1))
        cuts += (cuts[-1] + np.cumsum(n)).tolist()
    return (np.concatenate(out) if out else np.zeros(0, tv.U)), np.array(cuts, np.int64)


def fingerprints(data: np.ndarray, offs: np.ndarray, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(has words, fingerprints as uint32 of shape (rows, blocks), of which WIDTH bits are used)."""
    h, _, _, wo = tv.words(data, offs)
    u, uo = _unique_words(h, wo)
    has = np.diff(uo) > 0
    out = np.zeros((len(offs) - 1, blocks), np.uint32)
    if not len(u):
        return has, out
    rows = np.flatnonzero(has)
    begins = uo[:-1][rows]
    sizes = np.diff(uo)[rows]
    lanes = (blocks + 1) // 2
    for k in range(lanes):
        bits = tv.mix(u * tv.U(2 * k + 1) + tv.U(0xA0761D6478BD642F + k)).view(np.uint8)
        # counts of set bits by document: 64 columns at a time keep the array small
        ones = np.add.reduceat(np.unpackbits(bits.reshape(-1, 8), axis=1, bitorder="little"), begins, axis=0, dtype=np.int32)
        words = np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u4")
        out[rows, 2 * k : 2 * k + 2] = words[:, : blocks - 2 * k]
    return has, out & np.uint32((1 << WIDTH) - 1)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offs in tv.pieces(tv.column(batch, 1), lower=True):
            has, fp = fingerprints(data, offs, blocks)
            at = np.flatnonzero(has)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i).take(pa.array(at)), pa.array([x.tobytes() for x in fp[at]], pa.binary())], ["doc_id", "fp"]
            )


def fingerprint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp): the fingerprint of each document that has words."""
    src = only(docs, doc_id=doc_id, text=text).where("doc_id is not null and text is not null")
    return src.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(partial(_fingerprint_batches, blocks=blocks), "doc_id bigint, fp binary")


def _ball_batches(batches: Iterator[pa.RecordBatch], blocks: int, cut: int, flips: bool = True) -> Iterator[pa.RecordBatch]:
    """Sends each block to every bucket that holds one of its variants. A bucket is a block number
    and a variant's first ``cut`` bits: the flips of the other bits are in the block's own bucket and
    are made there, so a block travels once for all of these, and once for each of the first bits
    (without ``flips`` not for these). Blocks of one batch for one bucket travel as one value."""
    own = np.array([0, *(1 << np.arange(cut if flips else 0))], np.uint32)
    for batch in batches:
        if not len(batch):
            continue
        ids, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, blocks)
        for k in range(blocks):
            e = np.empty(len(ids) * len(own), _ENTRY)
            e["key"], e["id"], e["label"] = np.repeat(fp[:, k], len(own)), np.repeat(ids, len(own)), np.repeat(labels, len(own))
            to = ((fp[:, k : k + 1] >> np.uint32(WIDTH - cut)) ^ own).ravel().astype(np.int64)
            order = np.argsort(to, kind="stable")
            e, to = e[order], to[order]
            at = np.flatnonzero(np.diff(to, prepend=-1))
            packed = pa.array([e[x:y].tobytes() for x, y in zip(at, np.append(at[1:], len(to)))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to[at] + (k << cut)), packed], ["bucket", "packed"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of the columns, sorted by the first, then the second and so on."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    at = _starts(*columns)
    return [c[at] for c in columns]


def _entries(group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, label, id) of what a bucket was sent."""
    e = np.frombuffer(b"".join(group.column(1).to_pylist()), _ENTRY)
    return tuple(_distinct(*(np.ascontiguousarray(e[x]) for x in ("key", "label", "id"))))


def _lead(group):
    """(src, dst): each document of a bucket with the first one that has the same block."""
    key, _, ids = _entries(group)  # a document is its own label here
    first = _starts(key)
    lead = np.repeat(ids[first], np.diff(np.append(first, len(key))))
    other = ids != lead
    return pa.table([pa.array(x) for x in _distinct(ids[other], lead[other])], ["src", "dst"])


def _variants(key: np.ndarray, bucket: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """(variant, which key) of what a bucket was sent: all variants within half the radius that lie in it."""
    low, mine = WIDTH - cut, np.uint32(bucket & ((1 << cut) - 1))
    flips = np.array([0, *(1 << np.arange(low))], np.uint32)
    inside = key >> np.uint32(low) == mine
    other = (key[~inside] & np.uint32((1 << low) - 1)) | (mine << np.uint32(low))
    return np.concatenate([(key[inside][:, None] ^ flips).ravel(), other]), np.concatenate([np.repeat(np.flatnonzero(inside), len(flips)), np.flatnonzero(~inside)])


def _collide(group, cut: int):
    """The documents of a bucket that share a variant and not all the label: as pairs (src, dst) of
    different labels where these are few for the set's size, else as whole sets (a signature as src,
    ids), each once in this bucket. The documents of one block and one label are one class, which
    makes its variants once."""
    key, label, ids = _entries(group)
    first = _starts(key, label)
    n = np.diff(np.append(first, len(ids)))
    label = label[first]
    v, c = _variants(key[first], group.column(0)[0].as_py(), cut)
    order = np.lexsort((c, label[c], v))
    v, c = v[order], c[order]
    begin = _starts(v)
    end = np.append(begin[1:], len(v))
    # equal sets of classes are looked at once, those of one label not at all
    mixed = np.concatenate([np.zeros(1, tv.U), np.cumsum(tv.mix(c.astype(tv.U) + tv.U(1)), dtype=tv.U)])
    sig = tv.mix((mixed[end] - mixed[begin]) + (end - begin).astype(tv.U))
    keep = np.unique(sig, return_index=True)[1]
    keep = keep[label[c[begin[keep]]] != label[c[end[keep] - 1]]]
    begin, end = begin[keep], end[keep]
    # members of each set, and pairs of them across labels
    total = np.concatenate([[0], np.cumsum(n[c])])
    part = _starts(v, label[c])
    a, b = np.searchsorted(part, begin), np.searchsorted(part, end)
    width = np.diff(np.append(total[part], total[-1])).astype(np.float64)
    size = total[end] - total[begin]
    cross = (size.astype(np.float64) ** 2 - np.array([np.sum(width[x:y] ** 2) for x, y in zip(a, b)])) / 2
    few = cross <= FEW * size
    two = few & (end - begin == 2)
    left, right = [c[begin[two]]], [c[begin[two] + 1]]
    for k in np.flatnonzero(few & ~two):
        edge = np.append(part[a[k] : b[k]], end[k])
        for x, y in zip(edge[1:-1], edge[2:]):  # each label with those before it
            left.append(np.tile(c[begin[k] : x], y - x))
            right.append(np.repeat(c[x:y], x - begin[k]))
    left, right = np.concatenate(left), np.concatenate(right)
    left, right = _distinct(np.minimum(left, right), np.maximum(left, right))
    count = n[left] * n[right]
    k = np.repeat(np.arange(len(left)), count)
    at = tv.ranges(np.zeros(len(left), np.int64), count)
    src, dst = ids[first[left[k]] + at // n[right[k]]], ids[first[right[k]] + at % n[right[k]]]
    src, dst = _distinct(np.maximum(src, dst), np.minimum(src, dst))
    sets = [np.unique(ids[tv.ranges(first[c[x:y]], n[c[x:y]])]) for x, y in zip(begin[~few], end[~few])]
    sigs = np.array([np.sum(tv.mix(x.astype(tv.U) + tv.U(1)), dtype=tv.U) + tv.U(len(x)) for x in sets], tv.U)
    lists = pa.array([None] * len(src) + sets, pa.list_(pa.int64()))
    return pa.table([pa.array(np.concatenate([src, tv.mix(sigs).view(np.int64)])), pa.concat_arrays([pa.array(dst), pa.nulls(len(sets), pa.int64())]), lists], ["src", "dst", "ids"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of bytes or words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def families(part: np.ndarray, radius: int) -> np.ndarray:
    """The first row that each row is connected with by pairs within the radius. A row is held
    against those alone that no family has taken yet."""
    label = np.arange(len(part))
    rest = label.copy()
    while len(rest):
        lead, rest = rest[0], rest[1:]
        queue = [lead]
        while queue and len(rest):
            hit = near(part[queue.pop()], part[rest]) <= radius
            new, rest = rest[hit], rest[~hit]
            label[new] = lead
            queue.extend(new.tolist())
    return label


def _verify_pairs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their fingerprints, those within the radius."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(len(batch), -1) for k in (2, 3))
            yield batch.select(["src", "dst"]).filter(pa.array(near(a, b) <= radius))


def _verify_sets(group, radius: int):
    """Of the sets of a bucket, a row a member, edges that join what is connected by verified pairs."""
    sig, ids = group.column(1).to_numpy(), group.column(2).to_numpy()
    fp = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint32).reshape(len(ids), -1)
    order = np.lexsort((ids, sig))
    begin = _starts(sig[order])
    src, dst = [], []
    for x, y in zip(begin, np.append(begin[1:], len(order))):
        own = order[x:y]
        label = families(fp[own], radius)
        move = np.flatnonzero(label != np.arange(y - x))
        src.append(ids[own][move])
        dst.append(ids[own][label[move]])
    return pa.table([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])


def connected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of an edge list is connected with.

    Large-star and small-star rounds over the edge table; every round is cut by a checkpoint and
    the number of rounds grows with the logarithm of a component's size, not with its diameter.
    """
    def clean(e: DataFrame) -> DataFrame:
        return e.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()

    e = settled(clean(only(edges, src=src, dst=dst)))
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        # large star: a node's larger neighbours point to the smallest node it knows
        large = clean(both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")))
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(low, "src")
        e = settled(clean(joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst")))))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy("src").agg(F.min("dst").alias("component")).withColumnRenamed("src", "node").unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS, radius_share: float = RADIUS_SHARE) -> DataFrame:
    """(doc_id, group_id, kept): the documents that have near duplicates, by group. group_id is
    the group's smallest doc_id and kept marks that document."""
    return grouped(fingerprint_table(docs, doc_id, text, blocks), blocks, radius_share)


def grouped(fingerprints_: DataFrame, blocks: int = BLOCKS, radius_share: float = RADIUS_SHARE, bucket_bytes: int = BUCKET) -> DataFrame:
    """The same from (doc_id, fp)."""
    fps = settled(fingerprints_)
    reps = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count_distinct("doc_id").alias("n")))
    size = reps.count() * (WIDTH + 1) * _ENTRY.itemsize
    cut = min(WIDTH, (-(-size // bucket_bytes) or 1).bit_length())
    radius = int(radius_share * WIDTH * blocks)
    fp_of = reps.select("id", "fp")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(fp_of.toDF("src", "a"), "src").join(fp_of.toDF("dst", "b"), "dst")
        return both.select("src", "dst", "a", "b").mapInArrow(partial(_verify_pairs, radius=radius), "src bigint, dst bigint")

    # each document with the first of an equal block: from here on a large family has one label
    balls = fp_of.withColumn("label", F.col("id")).mapInArrow(partial(_ball_batches, blocks=blocks, cut=cut, flips=False), "bucket bigint, packed binary")
    first = connected(verified(balls.groupBy("bucket").applyInArrow(_lead, "src bigint, dst bigint")))
    labelled = fp_of.join(first, fp_of["id"] == first["node"], "left").select("id", "fp", F.coalesce("component", "id").alias("label"))
    balls = labelled.mapInArrow(partial(_ball_batches, blocks=blocks, cut=cut), "bucket bigint, packed binary")
    met = settled(balls.groupBy("bucket").applyInArrow(lambda group: _collide(group, cut), "src bigint, dst bigint, ids array<bigint>"))
    across = verified(met.where("ids is null").select("src", "dst"))
    # what goes on as whole sets is verified in buckets of counted size: a set is never one row with its fingerprints
    sets = met.where("ids is not null").select(F.col("src").alias("sig"), "ids").dropDuplicates(["sig"])
    members = sets.agg(F.sum(F.size("ids"))).first()[0] or 0
    buckets = -(-members * (4 * blocks + 16) // bucket_bytes) or 1
    held = sets.select("sig", F.explode("ids").alias("id")).join(fp_of, "id").select(F.pmod("sig", F.lit(buckets)).alias("bucket"), "sig", "id", "fp")
    within = held.groupBy("bucket").applyInArrow(lambda group: _verify_sets(group, radius), "src bigint, dst bigint")
    comp = connected(first.toDF("src", "dst").unionByName(across).unionByName(within))
    rep_group = reps.join(comp, reps["id"] == comp["node"], "left").select("fp", F.coalesce("component", "id").alias("group_id"), (F.col("component").isNotNull() | (F.col("n") > 1)).alias("grouped"))
    return fps.join(rep_group.where("grouped"), "fp").select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept")).distinct()
