import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.llm import ctw
from postlake.llm.ctw import log_gamma, log_kt, scored

SCHEMA = "doc_id bigint, text string, bits double, row bigint"


def brute(texts, depth):
    """The definition, node by node, in logarithms."""
    n = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)
    paths = lambda data, i: [bytes(data[max(0, i - d) : i]).rjust(d, b"\0") for d in range(depth + 1)]
    steps = lambda byte: [((256 | byte) >> (8 - k), (byte >> (7 - k)) & 1) for k in range(8)]
    data = [t.encode() for t in texts]
    for x in data:
        for i, byte in enumerate(x):
            c = paths(x, i)
            for node, bit in steps(byte):
                for d in range(depth + 1):
                    n[c[d], node][bit] += 1
                    if d:
                        kids[c[d - 1], node].add((c[d], node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    pw = {}
    for key in sorted(n, key=lambda k: -len(k[0])):
        pe = kt(*n[key])
        pw[key] = pe if len(key[0]) == depth else np.logaddexp(pe, sum(pw[k] for k in kids[key])) - math.log(2)
    out = []
    for x in data:
        total = 0
        for i, byte in enumerate(x):
            c = paths(x, i)
            for node, bit in steps(byte):
                p = 0.5
                for d in range(depth, -1, -1):
                    key = c[d], node
                    if key in n:
                        a, b = n[key]
                        stay = 1 if d == depth else math.exp(kt(a, b) - math.log(2) - pw[key])
                        p = stay * (b + 0.5) / (a + b + 1) + (1 - stay) * p
                    else:
                        p = 0.5
                total -= math.log2(p if bit else 1 - p)
        out.append(total)
    return out


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "é ü ñ \U0001f600", "the cat sat on the mat"]


@pytest.mark.parametrize("depth,size", [(0, 10**6), (3, 40), (6, 10**6), (7, 40)])
def test_against_the_definition(spark, depth, size):
    df = spark.createDataFrame([(i, t, 0.0, 0) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r for r in scored(df, depth=depth, batch_bytes=size, bucket_bytes=size).collect()}
    for i, want in enumerate(brute(TEXTS, depth)):
        size = len(TEXTS[i].encode())
        assert got[i].n_bytes == size and abs(got[i].bits - want) < 1e-3 * max(1, want)
        assert (got[i].bits_per_byte is None) == (size == 0)


def test_unseen_contexts_of_another_corpus(spark):
    frame = lambda t: spark.createDataFrame([(0, t, 0.0, 0)], SCHEMA)
    got = scored(frame("zzz"), frame("ab"), depth=2).first()
    assert 20 < got.bits < 40  # bytes never seen cost about 8 bits and more, and no path fails


def test_prose_is_cheaper_than_noise(spark):
    prose = "it was a bright cold day in april and the clocks were striking thirteen " * 40
    r = random.Random(3)  # noise that doesn't repeat: a phrase that comes again is no noise to a model of contexts
    noise = "".join(chr(r.randrange(33, 127)) for _ in range(60))
    rows = [(i, prose, 0.0, 0) for i in range(20)] + [(99, noise, 0.0, 0)]
    got = {r.doc_id: r.bits_per_byte for r in scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] < 1 < got[99]


def test_odd_rows(spark):
    rows = [(1, None, 0.0, 0), (2, "", 0.0, 0), (None, "abc", 0.0, 0), (3, "abc", 0.0, 0), (3, "abc", 0.0, 0), (4, "long text " * 40000, 0.0, 0)]
    got = scored(spark.createDataFrame(rows, SCHEMA)).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [(r.doc_id, r.n_bytes) for r in got] == [(None, 3), (1, 0), (2, 0), (3, 3), (3, 3), (4, 400000)]
    assert got[0].bits == got[3].bits == got[4].bits and got[1].bits == 0 and got[1].bits_per_byte is None
    assert scored(spark.createDataFrame([], SCHEMA)).collect() == []


def test_log_gamma():
    x = np.concatenate([np.arange(1, 400) / 2, [1e4, 1e9, 1e15]])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    assert abs(log_kt(np.array([0]), np.array([0]))[0]) < 1e-12


def test_a_rare_byte_among_many(spark, monkeypatch):
    """One 'a' among 1e8 'q' of the same context: its rare bit costs what its own ratio says."""
    pack = ctw._pack_batches

    def many(batches, depth, buckets):
        for batch in pack(batches, depth, buckets):
            n = [ctw._unzip(x, np.uint32) * np.where(ctw._unzip(g, np.uint64) & np.uint64(255) == ord("q"), 10**8, 1).astype(np.uint32) for g, x in zip(batch.column("grams").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([ctw._zip(x) for x in n], pa.binary())], batch.schema.names)

    monkeypatch.setattr(ctw, "_pack_batches", many)
    df = spark.createDataFrame([(0, "q" * 9 + "a", 0.0, 0), (1, "q" * 9, 0.0, 0)], SCHEMA)
    for depth in (0, 3):
        got = {r.doc_id: r.bits for r in scored(df, depth=depth).collect()}
        # 'qqq' stands before 12 of the 18 'q'; the four bits after the rare one were seen once, at 3/4 each
        low, high = (math.log2((n + 2) / 1.5) + 4 * math.log2(4 / 3) for n in (18e8 if depth == 0 else 12e8, 18e8))
        assert math.isfinite(got[1]) and low - 1e-3 < got[0] - got[1] < high + 1e-3
