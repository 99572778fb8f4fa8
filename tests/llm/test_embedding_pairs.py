import numpy as np
import pytest

from postlake.llm.embedding_pairs import linked, near_pairs, possible, quantised

SCHEMA = "vec_id bigint, embedding array<float>, a bigint, cosine double, block int"


def made(n=700, dim=24, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + r.normal(size=(n - n // 2, dim)) * r.choice([0, 0.05, 0.2, 0.4], size=(n - n // 2, 1))
    return (x * r.uniform(0.1, 9, size=(n, 1))).astype(np.float32)


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_against_brute_force(spark, threshold):
    x = made()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    a, b = np.nonzero(np.triu(s >= threshold, 1))
    want = {(int(i), int(j)): s[i, j] for i, j in zip(a, b)}
    df = spark.createDataFrame([(i, v.tolist(), 0, 0.0, 0) for i, v in enumerate(x)], SCHEMA)
    got = {(r.vec_a, r.vec_b): r.cosine for r in near_pairs(df, threshold, block=100).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


@pytest.mark.parametrize("block", [3, 4000])
def test_links_against_brute_force(spark, block):
    """Blocks of three make super-tiles of several blocks; copies are one class, equal similarities all count."""
    x = made(160, 8)
    x = np.concatenate([x, x[:40], x[:9], -x[:5], x[:5] * 2])
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cls = [min(j for j in range(len(x)) if (x[j] == x[i]).all()) for i in range(len(x))]
    near = y @ y.T >= 0.8
    want = {(i, cls[i], cls.count(cls[i]), sum(near[i, c] for c in set(cls)) - 1) for i in range(len(x))}
    df = spark.createDataFrame([(i, v.tolist(), 0, 0.0, 0) for i, v in enumerate(x)], SCHEMA)
    got = linked(df, 0.8, block=block).collect()
    assert len(got) == len(x) and {tuple(r) for r in got} == want and any(r.links > 2 for r in got)


def test_the_bound_loses_nothing_and_excludes_most():
    x = made(900, 48).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, *f = quantised(x)
    got = {(int(i), int(j)) for a, b in possible(q, f, q, f, 0.8, True, tile=128) for i, j in zip(a, b)}
    s = np.triu(x @ x.T, 1)
    want = set(zip(*(k.tolist() for k in np.nonzero(s >= 0.8))))
    assert want <= got and len(got) < 1.2 * len(want) + 50


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, None]), (10, [0.0, 1.0]), (11, [3.0, 0.001, 0.0])]
    got = near_pairs(spark.createDataFrame([(*r, 0, 0.0, 0) for r in rows], SCHEMA), 0.95).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1.0), (8, 11, 1.0)]
    assert near_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    got = linked(spark.createDataFrame([(*r, 0, 0.0, 0) for r in rows], SCHEMA), 0.95).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, 1), (2, 2, 1, 1), (8, 8, 1, 1), (10, 10, 1, 0), (11, 11, 1, 1)]
    # an id of two vectors that are near
    got = linked(spark.createDataFrame([(1, v, 0, 0.0, 0) for v in ([1.0, 0.0], [2.0, 0.0])], SCHEMA), 0.95).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 1)] * 2
    assert linked(spark.createDataFrame([], SCHEMA)).collect() == []
