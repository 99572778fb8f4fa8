"""Operator 8, benchmark decontamination by SimHash of item-sized windows.

A text's words are its lower-case runs of letters and digits. Every benchmark item of n words is
compared with the windows of n words of every document (a shorter document is one window):

1. Only windows that could pass are formed: the distinct 3-word shingles that a document shares
   with an item must weigh at least ``least`` of the item's, or no window's similarity can reach
   ``least``. This loses nothing. A shingle weighs as many bytes as its words have.
2. Each window's 64-bit SimHash over its words is looked up in a multi-index: four blocks of 16
   bits, each listing the items within a quarter of the radius in that block. By pigeonhole this
   finds every item within the radius; the Hamming distance of the whole is then checked.
3. What remains is verified exactly: weighted Jaccard similarity of the 3-word shingle sets.

The best window of each document and item is reported, the first of equal ones.

The index is sent to the tasks, so its size is checked: a benchmark beyond ``chunk_chars``
characters is worked through in several passes of at most about that size each.

Defined results: null or empty texts match nothing, on either side; items of fewer than three words
have no shingle and match nothing; rows with a null doc_id or item_id are ignored; repeated items
are each reported, wholly equal ones once; a repeated document gives equal rows once. Empty tables
give no rows, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import textvec as tv
from postlake.llm.common import only

RADIUS = 15
LEAST = 0.4
SHINGLE = 3
CHUNK_CHARS = 8_000_000
_BLOCKS = 4
_SALT = tv.U(0x5851F42D4C957F2D)
_FILTER = 1 << 20


def _fold(data: np.ndarray) -> np.ndarray:
    low = data.copy()
    low[(data >= 65) & (data <= 90)] |= 32
    return low


def window_fingerprints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n words of h from each start on; a bit is set if most words set it."""
    bits = np.unpackbits(tv.mix(h ^ _SALT).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    c = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=c[1:])
    return np.packbits((c[starts + n] - c[starts]) * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


class Index:
    """What the tasks need of a benchmark of bounded size."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, least: float = LEAST):
        self.radius, self.least = radius, least
        self.ids, self.words, fps, sh, sw, so, self.weight = [], [], [], [], [], [0], []
        for item, text in items:
            raw = np.frombuffer((text or "").lower().encode(), np.uint8)
            h, s, e, _ = tv.words(_fold(raw), np.array([0, len(raw)]))
            if len(h) < SHINGLE:
                continue
            x, first = np.unique(tv.shingles(h, SHINGLE), return_index=True)
            w = np.convolve(e - s, np.ones(SHINGLE, np.int64), "valid")[first]
            self.ids.append(item)
            self.words.append(len(h))
            self.weight.append(int(w.sum()))
            fps.append(window_fingerprints(h, np.array([0]), len(h))[0])
            sh.append(x)
            sw.append(w)
            so.append(so[-1] + len(x))
        self.fps = np.array(fps, np.uint64)
        self.items_sh, self.items_w, self.so = sh, sw, np.array(so)
        flat = np.concatenate([*sh, np.zeros(0, tv.U)])
        order = np.argsort(flat, kind="stable")
        self.sh, self.sh_item = flat[order], tv.owners(self.so)[order]
        self.sh_w = np.concatenate([*sw, np.zeros(0, np.int64)])[order]
        self.filter = np.zeros(_FILTER, bool)
        self.filter[(self.sh >> tv.U(44)).astype(np.int64)] = True
        reach = radius // _BLOCKS
        flips = np.array([sum(1 << b for b in c) for r in range(reach + 1) for c in combinations(range(16), r)], np.int64)
        self.blocks = []
        for k in range(_BLOCKS):
            own = ((self.fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            value = (own[:, None] ^ flips).ravel()
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.searchsorted(value[order], np.arange(65537)), np.repeat(np.arange(len(own)), len(flips))[order]))

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all within the radius."""
        pairs = []
        for k, (offs, items) in enumerate(self.blocks):
            v = ((fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            count = offs[v + 1] - offs[v]
            pairs.append((np.repeat(np.arange(len(fps)), count) << 32) | items[tv.ranges(offs[v], count)])
        p = np.unique(np.concatenate(pairs))
        w, i = p >> 32, p & 0xFFFFFFFF
        d = np.bitwise_count(fps[w] ^ self.fps[i]).astype(np.int64)
        ok = d <= self.radius
        return w[ok], i[ok], d[ok]

    def similarity(self, shingles: np.ndarray, weights: np.ndarray, item: int) -> float:
        x, first = np.unique(shingles, return_index=True)
        w = weights[first]
        both = int(w[np.isin(x, self.items_sh[item], assume_unique=True)].sum())
        return both / (int(w.sum()) + self.weight[item] - both)

    def find(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, Hamming distance, similarity) of the best windows."""
        h, s, e, wo = tv.words(_fold(data), offs)
        x = tv.shingles(h, SHINGLE)
        at = np.flatnonzero(self.filter[(x >> tv.U(44)).astype(np.int64)] & tv.within(wo, SHINGLE))
        lo, hi = np.searchsorted(self.sh, x[at], "left"), np.searchsorted(self.sh, x[at], "right")
        hits = tv.ranges(lo, hi - lo)
        pos = np.repeat(at, hi - lo)
        if not len(pos):
            return []
        item = self.sh_item[hits]
        doc = np.searchsorted(wo, pos, "right") - 1
        pair = doc * len(self.ids) + item
        # the bound of step 1, over distinct shingles
        order = np.lexsort((pos, hits, pair))
        pair, hits, pos = pair[order], hits[order], pos[order]
        fresh = np.concatenate([[True], (pair[1:] != pair[:-1]) | (hits[1:] != hits[:-1])])
        pairs, inverse = np.unique(pair, return_inverse=True)
        shared = np.bincount(inverse, self.sh_w[hits] * fresh)
        owner, which = pairs // len(self.ids), pairs % len(self.ids)
        good = shared >= self.least * np.array(self.weight)[which]
        cut = np.searchsorted(pair, pairs)
        cut = np.append(cut, len(pair))
        weights = (e - s).astype(np.int64)
        best: dict[tuple[int, int], tuple] = {}
        done = set()
        could = set(pairs[good].tolist())
        for g in np.flatnonzero(good):
            d, n_item = int(owner[g]), self.words[which[g]]
            a, b = int(wo[d]), int(wo[d + 1])
            n = min(n_item, b - a)
            p = np.unique(pos[cut[g] : cut[g + 1]])
            lo, hi = np.maximum(p - n + SHINGLE, a), np.minimum(p, b - n)
            starts = np.unique(tv.ranges(lo, np.maximum(hi - lo + 1, 0)))
            starts = starts[[(d, n_item, int(t)) not in done for t in starts]] if len(starts) else starts
            if not len(starts):
                continue
            done.update((d, n_item, int(t)) for t in starts)
            base = int(starts[0])
            top = int(starts[-1]) + n
            for w, i, dist in zip(*self.near(window_fingerprints(h[base:top], starts - base, n))):
                if self.words[i] != n_item or d * len(self.ids) + int(i) not in could:
                    continue
                t = int(starts[w])
                sh = x[t : t + n - SHINGLE + 1]
                wt = weights[t : t + n]
                sim = self.similarity(sh, np.convolve(wt, np.ones(SHINGLE, np.int64), "valid"), i)
                if sim >= self.least:
                    key = (d, int(i))
                    new = (-sim, t - a, n, int(dist))
                    if key not in best or new < best[key]:
                        best[key] = new
        return [(d, i, t, n, dist, -sim) for (d, i), (sim, t, n, dist) in best.items()]


def _find_batches(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in tv.pieces(tv.column(batch, 1), lower=True):
            rows = index.find(data, offs) if index.ids else []
            if rows:
                d, it, t, n, dist, sim = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(d)), pa.array([index.ids[k] for k in it], pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(dist, pa.int32()), pa.array(np.round(sim, 6))],
                    ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"],
                )


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = LEAST, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): what documents hold of items."""
    items = only(benchmark, item_id="item_id", text="text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-total // chunk_chars) or 1
    src = only(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    out = None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        rows = sorted((r.item_id, r.text) for r in part.collect())  # about chunk_chars characters
        found = src.mapInArrow(partial(_find_batches, index=Index(rows, radius, least)), "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, hamming int, similarity double")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
