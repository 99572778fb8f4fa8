"""Operator 9, suffix-array dedup: passages of ``words`` words or more that occur more than once.

A text's words are its lower-case runs of letters and digits. A window is ``words`` consecutive
words; a passage is a maximal run of window starts that all occur again somewhere in the corpus, in
the same document or another. Every occurrence is reported; ``first`` marks the windows that have
no equal at a smaller (doc_id, position), which is what a deduplication keeps.

Plan: equal windows have to meet, and a whole corpus fits no suffix array. Each window goes to its
minimiser, the smallest hash of the ``gram``-word grams in it: equal windows have equal minimisers,
and neighbours mostly share theirs, so windows travel as segments. One shuffle by minimiser finds
the segments that have an equal segment, meet a different one or hold a window twice. The first need no
sorting. Of the others one copy of each distinct segment is fetched, and per minimiser a generalised suffix array
(suffixes.py) over them groups equal windows wherever they lie in their segments.

Defined results: null texts and those of fewer than ``words`` words have no window; a null doc_id is
ignored; a row that is repeated counts as one text, the same doc_id with other texts as several,
whose positions are their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm import textvec as tv
from postlake.llm.common import only, settled
from postlake.llm.suffixes import shared, suffix_array

WORDS = 50
GRAM = 16
#: Symbols that one suffix array takes at least, where minimisers allow.
TOGETHER = 60_000


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = tv._powers(len(h) + 1)
    c = np.zeros(len(h) + 1, tv.U)
    np.cumsum(h * p[: len(h)], out=c[1:])
    return c, q


def segments(data: np.ndarray, offs: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, minimiser, hash of the content, holds a window twice) of each
    segment. The last is asked of windows as far apart as one place of a minimiser lets them be."""
    h, _, _, wo = tv.words(data, offs)
    n = len(h) - words + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(bool)
    c, q = _prefix(h)
    g = len(h) - gram + 1
    low = tv.mix((c[gram:] - c[:g]) * q[:g])
    width, reach = words - gram + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    ok = tv.within(wo, words)
    doc = tv.owners(wo)[:n]
    fresh = ok.copy()
    fresh[1:] &= ~(ok[:-1] & (low[1:] == low[:-1]) & (doc[1:] == doc[:-1]))
    at = np.flatnonzero(fresh)
    alive = np.concatenate([[0], np.cumsum(ok)])
    nxt = np.append(at[1:], n)
    count = alive[nxt] - alive[at]
    end = at + count + words - 1
    content = tv.mix((c[end] - c[at]) * q[at] + count.astype(tv.U))
    own = np.cumsum(fresh) - 1
    window = (c[words : words + n] - c[:n]) * q[:n] + own.astype(tv.U)
    twice = np.zeros(len(at), bool)
    for d in range(1, min(width, n)):
        k = np.flatnonzero(window[d:] == window[:-d])
        k = k[ok[k] & ok[k + d] & (own[k] == own[k + d])]
        twice[own[k]] = True
    return doc[at], at - wo[doc[at]], count, low[at].view(np.int64), content.view(np.int64), twice


def _segment_batches(batches: Iterator[pa.RecordBatch], words: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in tv.pieces(tv.column(batch, "text"), lower=True):
            doc, at, count, low, content, twice = segments(data, offs, words, gram)
            keys = [batch.column(k).slice(i, j - i).take(pa.array(doc)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(low), pa.array(content), pa.array(twice)], ["doc_id", "txt", "at", "n", "m", "c", "twice"])


def _token_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The word hashes of the wanted segments of each text."""
    for batch in batches:
        wanted = batch.column("wanted")
        for i, j, data, offs in tv.pieces(tv.column(batch, "text"), lower=True):
            h, _, _, wo = tv.words(data, offs)
            part = wanted.slice(i, j - i)
            size = np.asarray(part.value_lengths())
            flat = part.flatten()
            at, n = flat.field("at").to_numpy() + np.repeat(wo[:-1], size), flat.field("n").to_numpy()
            cols = [pa.array([h[a : a + k + words - 1].tobytes() for a, k in zip(at, n)], pa.binary())]
            yield pa.RecordBatch.from_arrays([flat.field("m"), flat.field("c"), *[flat.field(k) for k in ("doc_id", "txt", "at")], *cols], ["m", "c", "doc_id", "txt", "at", "tokens"])


def grouped_windows(tokens: list[np.ndarray], spots: list[tuple], words: int) -> list[list[tuple[int, int, int]]]:
    """For each distinct segment, runs (from, to, state) that cover its windows. state 0: the window
    is nowhere else among the segments; 1: it is, at a smaller spot; 2: it is, and this is the
    smallest. spots: (doc_id, text, first word) of the segments' first occurrences."""
    size = np.array([len(t) for t in tokens])
    ends = np.cumsum(size)
    starts = ends - size
    symbols = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(tokens)), size)
    order = suffix_array(symbols)
    # equal windows lie together in the array, among them what runs on into the next segment
    cls = np.concatenate([[0], np.cumsum(~shared(symbols, order, words))])
    inside = (ends[owner] - np.arange(len(symbols)) >= words)[order]
    where, cls = order[inside], cls[inside]
    many = np.bincount(cls)[cls] > 1
    where, cls = where[many], cls[many]
    who = owner[where]
    texts = {key: k for k, key in enumerate(sorted({x[:2] for x in spots}))}
    rank = np.array([texts[x[:2]] for x in spots])[who]
    at = np.array([x[2] for x in spots])[who] + where - starts[who]
    by = np.lexsort((at, rank, cls))
    lead = np.zeros(len(by), bool)
    lead[by[np.diff(cls[by], prepend=-1) != 0]] = True
    state = np.zeros(len(symbols), np.int8)
    state[where] = 1 + lead
    out = []
    for s, e in zip(starts, ends):
        x = state[s : e - words + 1]
        cut = np.flatnonzero(np.diff(x, prepend=-1))
        out.append(list(zip(cut.tolist(), np.append(cut[1:], len(x)).tolist(), x[cut].tolist())))
    return out


def _group_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by minimiser and content; a suffix array takes whole minimisers only."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        runs = grouped_windows([np.frombuffer(r[5], tv.U) for r in rows], [r[2:5] for r in rows], words)
        cols = zip(*[(r[0], r[1], *x) for r, own in zip(rows, runs) for x in own])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["m", "c", "a", "b", "state"])

    held: list[tuple] = []
    total = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[:2] == held[-1][:2]:
                continue  # a row of the table that is repeated
            if total >= TOGETHER and row[0] != held[-1][0]:
                yield flush(held)
                held, total = [], 0
            held.append(row)
            total += len(row[5]) // 8
    if held:
        yield flush(held)


def repeated_passages(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, first): maximal runs of repeated windows, as word spans."""
    src = only(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("txt"), "text")
    seg = src.mapInArrow(partial(_segment_batches, words=words, gram=gram), "doc_id bigint, txt bigint, at int, n int, m bigint, c bigint, twice boolean")
    by_c, by_m = Window.partitionBy("m", "c"), Window.partitionBy("m")
    spot = F.struct("doc_id", "txt", "at")
    # the windows by minimiser and by (minimiser, content) share one shuffle; a repeated row isn't a copy
    seg = seg.repartition("m")
    seg = seg.withColumn("least", F.min(spot).over(by_c)).withColumn("most", F.max(spot).over(by_c)).withColumn("copied", F.col("least") != F.col("most"))
    # one place of a minimiser serves at most words-gram+1 windows: a longer segment is periodic and may repeat
    # within itself; so may a shorter one, which tells by ``twice``
    mixed = (F.min("c").over(by_m) != F.max("c").over(by_m)) | (F.col("n") > words - gram + 1) | F.col("twice")
    seg = seg.withColumn("mixed", mixed).where("copied or mixed").withColumn("own", F.col("least") == spot).drop("least", "most", "twice")
    seg = settled(seg)
    wanted = seg.where("own and mixed").groupBy("doc_id", "txt").agg(F.collect_set(F.struct("m", "c", "doc_id", "txt", "at", "n")).alias("wanted"))
    texts = src.join(wanted, ["doc_id", "txt"]).select("text", "wanted")
    tokens = texts.mapInArrow(partial(_token_batches, words=words), "m bigint, c bigint, doc_id bigint, txt bigint, at int, tokens binary")
    runs = tokens.repartition("m").sortWithinPartitions("m", "c", "doc_id", "txt", "at").mapInArrow(partial(_group_batches, words=words), "m bigint, c bigint, a int, b int, state int")
    per = runs.groupBy("m", "c").agg(F.collect_list(F.struct("a", "b", "state")).alias("runs"))
    alone = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(0).alias("state")))
    spans = seg.join(per, ["m", "c"], "left").select("doc_id", "txt", "at", "own", "copied", F.explode(F.coalesce("runs", alone)).alias("r"))
    spans = spans.where("copied or r.state > 0").select("doc_id", "txt", (F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b"), (F.col("own") & (F.col("r.state") != 1)).alias("first"))
    return merged(spans, words)


def merged(spans: DataFrame, words: int) -> DataFrame:
    """Joins the runs of window starts of each text that touch, and turns them into word spans."""
    w = Window.partitionBy("doc_id", "txt", "first").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = spans.distinct().withColumn("fresh", F.when(before >= F.col("a"), 0).otherwise(1)).withColumn("k", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = part.groupBy("doc_id", "txt", "first", "k").agg(F.min("a").alias("start_word"), (F.max("b") + words - 1).alias("end_word"))
    return out.select("doc_id", F.col("start_word").cast("bigint"), F.col("end_word").cast("bigint"), "first")
