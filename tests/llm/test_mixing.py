import random
from collections import Counter, defaultdict

import numpy as np

from postlake.llm.mixing import apportioned, mixed, target_weights

DOCS = "doc_id bigint, text string, source string, block string, shard string"
WEIGHTS = "source string, weight bigint, total string"


def docs(spark, n=400, seed=2):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 40)), r.choice(["a", "a", "a", "b", "c", None]), "", "") for i in range(n)]
    return rows, spark.createDataFrame([(i, t.replace("w", "w "), *x) for i, t, *x in rows], DOCS)


def test_quotas_follow_the_greedy_rule(spark):
    _, df = docs(spark)
    weights = {"a": 5, "b": 3, None: 2}
    got = mixed(df, spark.createDataFrame([(k, v, "") for k, v in weights.items()], WEIGHTS), block_tokens=25, shards=3, shard_blocks=12).collect()
    every = mixed(df, spark.createDataFrame([(k, 1, "") for k in ("a", "b", "c", None)], WEIGHTS), block_tokens=25, shards=3, shard_blocks=10**6).collect()
    have = defaultdict(Counter)
    for r in {(r.shard, r.source, r.block) for r in every}:
        have[r[0]][r[1]] += 1
    took = defaultdict(Counter)
    for r in {(r.shard, r.source, r.block) for r in got}:
        took[r[0]][r[1]] += 1
    for shard, avail in have.items():
        seats = Counter()
        for _ in range(12):
            free = [s for s in weights if seats[s] < avail[s]]
            seats[min(free, key=lambda s: (-weights[s] / (2 * seats[s] + 1), s or ""))] += 1
        assert {k: v for k, v in seats.items() if v} == dict(took[shard])


def test_blocks_are_equal_and_disjoint(spark):
    _, df = docs(spark)
    got = mixed(df, target_weights(df), block_tokens=30, shards=2).collect()
    size = Counter()
    spans = defaultdict(list)
    for r in got:
        assert 0 <= r.first_token < r.end_token
        size[r.source, r.block] += r.end_token - r.first_token
        spans[r.doc_id].append((r.first_token, r.end_token))
    last = {s: max(b for x, b in size if x == s) for s, _ in size}
    assert all(n == 30 if b < last[s] else 0 < n <= 30 for (s, b), n in size.items())
    for x in spans.values():
        x.sort()
        assert all(a[1] <= b[0] for a, b in zip(x, x[1:]))


def test_every_token_has_a_block(spark):
    """The whole share takes all: short last blocks, and a source smaller than a block."""
    rows, df = docs(spark, 60)
    df = df.unionByName(spark.createDataFrame([(999, "just two", "tiny", "", "")], DOCS))
    got = mixed(df, target_weights(df), block_tokens=37, shards=3, share=1.0).collect()
    took = Counter()
    for r in got:
        took[r.doc_id] += r.end_token - r.first_token
    assert took == Counter({i: len(t.split()) for i, t, *_ in rows} | {999: 2})


def test_apportionment_is_the_greedy_rule():
    r = random.Random(9)
    for _ in range(300):
        k = r.randint(1, 7)
        w, n = np.array([r.choice([1, 2, 3, 7, 100]) for _ in range(k)], float), np.array([r.randint(1, 40) for _ in range(k)])
        name, seats = r.sample([None, "a", "b", "c", "d", "e", "\u00e9"], k), r.randint(0, 150)
        want = [0] * k
        for _ in range(min(seats, n.sum())):
            free = [i for i in range(k) if want[i] < n[i]]
            want[min(free, key=lambda i: (-w[i] / (2 * want[i] + 1), name[i] is not None, name[i] or ""))] += 1
        assert apportioned(w, name, n, seats).tolist() == want
    # a source of half of all blocks is a number, not rows
    assert apportioned(np.array([3.0, 1.0]), ["a", "b"], np.array([10**12, 10**12]), 10**9).tolist() == [750_000_000, 250_000_000]


def test_odd_rows(spark):
    rows = [(1, "a b c", "x", "", ""), (1, "a b c", "x", "", ""), (2, None, "x", "", ""), (3, " \n", "x", "", ""), (None, "a b", "x", "", ""), (4, "w " * 30000, "y", "", ""), (5, "a b c", None, "", "")]
    weights = [("x", 1, ""), ("x", 1, ""), ("y", None, ""), (None, 1, ""), ("z", 4, "")]
    got = mixed(spark.createDataFrame(rows, DOCS), spark.createDataFrame(weights, WEIGHTS), block_tokens=3, shards=1, shard_blocks=100).collect()
    assert sorted((r.source or "", r.doc_id, r.first_token, r.end_token) for r in got) == [("", 5, 0, 3), ("x", 1, 0, 3), ("x", 1, 0, 3)]
    empty = spark.createDataFrame([], DOCS)
    assert mixed(empty, target_weights(empty)).collect() == []
