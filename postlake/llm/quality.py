"""Operator 3, quality classifier: Bradley-Terry pairwise ranking.

Each labelled document is preferred (quality 1 and not toxic) or not; a preference pair is one of
each. A linear score is fitted by logistic loss on the pair's feature difference, so that
P(a beats b) = sigmoid(score(a) - score(b)). The threshold is a low quantile of the scores that
preferred documents outside the fit reach: the score below which at most ``loss_quantile`` of what
should stay falls. Documents below it are rejected.

Features: presence of hashed lower-case words, and the shape of the text (capitals, symbols,
repetition, bars, digits, word length) in quantised steps. Only the fit is bounded: at most
``sample`` labelled documents, of those that a seeded hash of doc_id gives to it (one in two), half
preferred and a quarter each of low quality and toxic; ``pairs`` preference pairs are drawn from
them, and words of fewer than ``least`` sampled documents weigh nothing. The threshold is exact and comes
from all preferred documents that the fit did not see; scoring covers every document in whole.

Defined results: a null text scores as the empty text, and a very long one in whole; rows with a null
doc_id are scored like any other; labels with null quality and toxic are ignored, a null of one counts
as good; a document labelled more than once counts once a distinct label, and a doc_id that is repeated in
the documents is fitted on its smallest text; equal scores are kept or rejected together, and a
score at the threshold is kept; without labels of both kinds nothing is rejected and every score is 0;
if every preferred document is in the fit, these give the threshold. An empty table gives no rows;
further columns are ignored, and kept by ``kept``.
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

BITS = 18
SAMPLE = 12_000
LOSS_QUANTILE = 0.005
_LETTER = tv._table(lambda b: chr(b).isalpha() or b >= 128)
_UPPER = tv._table(lambda b: 65 <= b <= 90)
_LOWER = tv._table(lambda b: 97 <= b <= 122)
_SYMBOL = tv._table(lambda b: b < 128 and not chr(b).isalnum() and b not in b" \t\n\r\v\f.,")
_BAR = tv._table(lambda b: b == ord("|"))
_DIGIT = tv._table(lambda b: 48 <= b <= 57)
_STEPS = 24
_SHAPES = 7


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, as one array with offsets. The first
    _SHAPES * _STEPS numbers are shapes, the rest hashed words."""
    n = len(offs) - 1
    low = data.copy()
    low[_UPPER[data]] |= 32  # ASCII only: enough to fold words, and no second copy of the text
    h, s, e, wo = tv.words(low, offs)
    col = (h >> tv.U(64 - BITS)).astype(np.int64) + _SHAPES * _STEPS
    who = tv.owners(wo)
    key = np.unique((who << 24) | col)
    who_u, col_u = key >> 24, key & 0xFFFFFF

    def share(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[data])])
        return (c[offs[1:]] - c[offs[:-1]]).astype(np.float64)

    size = np.maximum(np.diff(offs), 1)
    count = np.diff(wo)
    words = np.maximum(count, 1)
    upper, lower = share(_UPPER), share(_LOWER)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[wo[:-1][np.diff(wo) > 0]] = False  # not with another text's last word
    same = np.concatenate([[0], np.cumsum(again)])
    shape = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            np.minimum(share(_SYMBOL) / size * 5, 1),
            np.minimum(share(_BAR) / words, 1),
            np.minimum(share(_DIGIT) / size * 4, 1),
            (same[wo[1:]] - same[wo[:-1]]) / words,
            np.bincount(who_u, minlength=n) / words * np.minimum(1, np.log2(words + 1) / 10),
            np.minimum(share(_LETTER) / words / 16, 1),
        ]
    )
    step = np.minimum((np.sqrt(np.clip(shape, 0, 1)) * (_STEPS - 1)).astype(np.int64), _STEPS - 1) + np.arange(_SHAPES)[:, None] * _STEPS
    key = np.sort(np.concatenate([key, ((np.arange(n) << 24) | step).ravel()]))
    return key & 0xFFFFFF, np.searchsorted(key, np.arange(n + 1) << 24)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in tv.pieces(tv.column(batch, "text")):
            f, fo = features(data, offs)
            cols = [batch.column(k).slice(i, j - i) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(fo.astype(np.int32)), pa.array(f.astype(np.int32)))], ["doc_id", "kind", "f"])


def fit(kinds: np.ndarray, flat: np.ndarray, offs: np.ndarray, rounds: int = 1000, pairs: int = 60_000, least: int = 12, l1: float = 1e-4, l2: float = 3e-4, rate: float = 0.1, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature number, scores of the rows). kinds: 0 preferred, 1 low quality, 2 toxic.

    Full-batch Adam on mean log(1+exp(score(bad)-score(good))) plus an L2 term on shapes and an L1 term on words, by whose
    soft threshold common words that tell nothing weigh nothing, however long a text is. Words in
    fewer than ``least`` rows are left out: they can't be told from noise."""
    width = _SHAPES * _STEPS + (1 << BITS)
    w = np.zeros(width)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(kinds == 0), np.flatnonzero(kinds != 0)
    rows = np.repeat(np.arange(len(kinds)), np.diff(offs))
    seen = np.bincount(flat, minlength=width)
    use = (seen >= least)[flat]
    rows, cols = rows[use], flat[use]
    names, cols = np.unique(cols, return_inverse=True)
    if not len(good) or not len(bad) or not len(names):
        return w, np.zeros(len(kinds))
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    v, m1, m2 = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    word = names >= _SHAPES * _STEPS
    for t in range(1, rounds + 1):
        s = np.bincount(rows, v[cols], len(kinds))
        g = -1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30))) / pairs
        by_row = np.bincount(a, g, len(kinds)) - np.bincount(b, g, len(kinds))
        grad = np.bincount(cols, by_row[rows], len(names)) + np.where(word, np.sign(v) * l1, v * l2)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        v -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-4)
        v[word & (np.abs(v) < 0.15) & (t > rounds // 2)] = 0
    w[names] = v
    return w, np.bincount(rows, v[cols], len(kinds))


class Model:
    """Weights of fixed size and a threshold; it travels with the task."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights.astype(np.float32), float(threshold)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        f, fo = features(data, offs)
        c = np.concatenate([[0.0], np.cumsum(self.weights[f].astype(np.float64))])
        return np.round(c[fo[1:]] - c[fo[:-1]], 6)


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, kind): 0 preferred, 1 low quality, 2 toxic."""
    good = "coalesce(quality, 1) = 1 and coalesce(toxic, 0) = 0"
    kind = F.expr(f"case when {good} then 0 when coalesce(toxic, 0) = 1 then 2 else 1 end")
    known = only(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null and not (quality is null and toxic is null)")
    return known.select(F.col("doc_id").cast("bigint").alias("doc_id"), kind.alias("kind")).distinct()


def _chosen(known: DataFrame, sample: int, seed: int) -> DataFrame:
    """The documents to fit on: at most ``sample``, and never more than those whose hash allows it."""
    mine = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2)) == 0)
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    picks = [mine.where(F.col("kind") == k).orderBy(*order).limit(n) for k, n in ((0, sample // 2), (1, sample // 4), (2, sample // 4))]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


def _weights(docs: DataFrame, chosen: DataFrame) -> np.ndarray | None:
    """The fitted weights; None without both kinds."""
    # the broadcast side holds at most ``sample`` rows of two integers, whatever the input's size
    rows = only(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_feature_batches, "doc_id bigint, kind int, f array<int>").toArrow().sort_by([("doc_id", "ascending"), ("kind", "ascending")]).combine_chunks()
    kinds = got.column("kind").to_numpy()
    if not ((kinds == 0).any() and (kinds != 0).any()):
        return None
    lists = got.column("f").combine_chunks()
    offs = np.asarray(lists.offsets)
    return fit(kinds, np.asarray(lists.flatten()), offs - offs[0])[0]


def quantile(values: DataFrame, share: float) -> float | None:
    """The value of ``score`` at rank floor(share * (n - 1)), exactly, over scores of six decimals. Two
    counts: by hundredths, and by value within one hundredth, so at most 10,000 rows of it come here."""
    steps = values.select(F.round(F.col("score") * 1_000_000).cast("bigint").alias("v")).withColumn("bin", F.expr("floor(v / 10000)"))
    bins = sorted((r["bin"], r["count"]) for r in steps.groupBy("bin").count().collect())
    if not bins:
        return None
    rank = int(share * (sum(n for _, n in bins) - 1))
    for own, n in bins:
        if rank < n:
            break
        rank -= n
    for v, n in sorted((r["v"], r["count"]) for r in steps.where(F.col("bin") == own).groupBy("v").count().collect()):
        if rank < n:
            return v / 1_000_000
        rank -= n
    raise AssertionError("counts differ between two reads")


def _trained(docs: DataFrame, labels: DataFrame, sample: int, loss_quantile: float, seed: int) -> tuple["Model", DataFrame | None]:
    """The model, and the scores of all documents that its threshold was taken from."""
    known = _labelled(labels)
    chosen = _chosen(known, sample, seed)
    w = _weights(docs, chosen)
    if w is None:
        return Model(np.zeros(_SHAPES * _STEPS + (1 << BITS)), -np.inf), None
    scores = settled(scored(docs, Model(w, -np.inf)).select("doc_id", "score"))
    good = known.where("kind = 0")
    held = good.join(F.broadcast(chosen.where("kind = 0").select("doc_id")), "doc_id", "left_anti")
    at = quantile(scores.join(held, "doc_id"), loss_quantile)
    if at is None:
        at = quantile(scores.join(good, "doc_id"), loss_quantile)
    return Model(w, at - 5e-7), scores


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, loss_quantile: float = LOSS_QUANTILE, seed: int = 7) -> "Model":
    return _trained(docs, labels, sample, loss_quantile, seed)[0]


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, loss_quantile: float = LOSS_QUANTILE, seed: int = 7) -> DataFrame:
    """(doc_id, score, kept) of every document, trained on the labels; texts are scored once."""
    model, scores = _trained(docs, labels, sample, loss_quantile, seed)
    return scored(docs, model) if scores is None else scores.withColumn("kept", F.col("score") >= model.threshold)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in tv.pieces(tv.column(batch, 1)):
            s = model.scores(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s), pa.array(s >= model.threshold)], ["doc_id", "score", "kept"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, kept) of every document."""
    src = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint"), "text")
    return src.mapInArrow(partial(_score_batches, model=model), "doc_id bigint, score double, kept boolean")


def _keep_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [model.scores(data, offs) >= model.threshold for _, _, data, offs in tv.pieces(tv.column(batch, "text"))]
        yield batch.filter(pa.array(np.concatenate(ok) if ok else np.zeros(0, bool)))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't rejected, with all their columns, in one pass and no join."""
    return docs.mapInArrow(partial(_keep_batches, model=model), docs.schema)
