import random
import re

import numpy as np
import pyarrow as pa

from postlake.llm import textvec as tv
from postlake.llm.simhash_dups import BLOCKS, RADIUS_SHARE, WIDTH, connected, families, fingerprints, grouped, near, near_duplicates

SCHEMA = "doc_id bigint, text string, group_id string, fp string"


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))


def corpus(seed, originals=150):
    r = random.Random(seed)
    vocabulary = [word(r) for _ in range(3000)]
    rows = []
    for i in range(originals):
        w = [r.choice(vocabulary) for _ in range(r.randint(40, 400))]
        rows.append(" ".join(w))
        for _ in range(r.choice([0, 0, 1, 3])):
            c = list(w)
            for _ in range(int(len(c) * r.choice([0, 0.02, 0.05, 0.08]))):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            rows.append(" ".join(c))
    return rows


ALL = (1 << 64) - 1
RADIUS = int(RADIUS_SHARE * WIDTH * BLOCKS)


def mixed(x):
    """The finaliser in whole numbers."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & ALL
    return x ^ (x >> 31)


def fingerprint(text):
    """The definition, a bit at a time, in one whole number; None without words."""
    words = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()))
    own = [int(tv.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) >> 8 for w in words]
    out = 0
    for block in range(BLOCKS):
        lane, low = divmod(block, 2)
        votes = [mixed((u * (2 * lane + 1) + 0xA0761D6478BD642F + lane) & ALL) for u in own]
        for b in range(WIDTH):
            ones = sum(v >> (32 * low + b) & 1 for v in votes)
            out |= (2 * ones > len(own)) << (32 * block + b)
    return out if own else None


def brute(texts):
    fp = [fingerprint(t) for t in texts]
    close = np.zeros((len(fp), len(fp)), bool)
    for i, a in enumerate(fp):
        for j in range(i, len(fp)):
            close[i, j] = close[j, i] = a is not None and fp[j] is not None and (a ^ fp[j]).bit_count() <= RADIUS
    return close


def test_fingerprints_by_the_definition():
    texts = [*corpus(4, 20), "", "one", "Zwei zwei \u00e9t\u00e9"]
    has, fp = fingerprints(*tv.raw(pa.array([t.lower() for t in texts])))
    for t, h, x in zip(texts, has, fp):
        want = fingerprint(t)
        assert h == (want is not None) and int.from_bytes(x.tobytes(), "little") == (want or 0)


def test_recall_against_brute_force(spark):
    texts = corpus(1)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    group = {r.doc_id: r.group_id for r in near_duplicates(df).collect()}
    close = brute(texts)
    a, b = np.nonzero(np.triu(close, 1))
    assert len(a) > 100
    met = sum(group.get(int(x)) is not None and group.get(int(x)) == group.get(int(y)) for x, y in zip(a, b))
    assert met >= 0.9 * len(a)
    for doc, g in group.items():
        assert doc == g or close[doc].sum() > 1


def test_recall_by_distance(spark):
    """All pairs within the guarantee, and nine in ten at the radius itself; none beyond it."""
    r = np.random.default_rng(0)
    n, bits = 1000, WIDTH * BLOCKS

    def packed(x):
        wide = np.zeros((BLOCKS, 32), np.uint8)
        wide[:, :WIDTH] = x.reshape(BLOCKS, WIDTH)
        return np.packbits(wide, bitorder="little").tobytes()

    rows, steps = [], ((3 * BLOCKS - 1, 1.0), (75, 0.97), (RADIUS, 0.9), (RADIUS + 1, None))
    for distance, _ in steps:
        for _ in range(n):
            x = r.integers(0, 2, bits)
            y = x.copy()
            y[r.choice(bits, distance, replace=False)] ^= 1
            rows += [(len(rows), packed(x)), (len(rows) + 1, packed(y))]
    got = {(x.doc_id, x.group_id) for x in grouped(spark.createDataFrame(rows, "doc_id bigint, fp binary"), bucket_bytes=400_000).collect() if not x.kept}
    assert all(a == g + 1 for a, g in got)
    for k, (_, least) in enumerate(steps):
        met = sum(g // (2 * n) == k for _, g in got)
        assert not met if least is None else met >= least * n


def test_families_are_the_components():
    r = np.random.default_rng(1)
    part = r.integers(0, 1 << 60, (80, 1), dtype=np.uint64)
    for k in range(30, 80):
        part[k] = part[r.integers(0, k)] ^ np.uint64(1 << int(r.integers(0, 60)))
    want = np.arange(80)
    for _ in range(80):
        for i in range(80):
            for j in range(80):
                if int(part[i, 0] ^ part[j, 0]).bit_count() <= 1:
                    want[i] = want[j] = min(want[i], want[j])
    assert (families(part, 1) == want).all()
    assert (families(np.zeros((50_000, 7), np.uint64), 3) == 0).all()  # one pass, not all pairs


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(40)) * 2000 + " "
    rows = [(5, None, None, None), (6, "", None, None), (7, " \n", None, None), (None, "a b c d", None, None), (3, long, None, None), (2, long + "x1", None, None),
            (1, "one two three", None, None), (1, "one two three", None, None), (9, "one two three", None, None), (4, "wholly other words here", None, None)]
    got = {(r.doc_id, r.group_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, True), (9, 1, False), (2, 2, True), (3, 2, False)}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_copies_and_chains(spark):
    rows = [(i, "the same words in every one of these", "", "") for i in range(3000)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3000 and {r.group_id for r in got} == {0}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 900), (900, 950)], "src long, dst long")
    label = {r.node: r.component for r in connected(chain).collect()}
    assert all(label[i] == 0 for i in range(201)) and label[1000] == label[950] == label[900] == 900


def test_large_family_of_near_fingerprints(spark):
    """A large family doesn't travel once for each variant that it shares with a stranger, and loses no link."""
    r = np.random.default_rng(2)
    n, bits = 3000, WIDTH * BLOCKS
    base = r.integers(0, 2, bits)

    def flipped(x, count, among=np.arange(bits)):
        y = x.copy()
        y[r.choice(among, count, replace=False)] ^= 1
        return y

    rows = [flipped(base, r.integers(1, 21)) for _ in range(n)]
    # near one member alone, by its block 3; strangers with a block of the family; a crowd of strangers with a block in common
    for k in (1500, 2200):
        rows.append(flipped(rows[k], 92, np.setdiff1d(np.arange(bits), np.arange(3 * WIDTH, 4 * WIDTH))))
    for k in range(3):
        rows.append(r.integers(0, 2, bits))
        rows[-1][k * WIDTH : (k + 1) * WIDTH] = base[k * WIDTH : (k + 1) * WIDTH]
    shared = r.integers(0, 2, WIDTH)
    for _ in range(40):
        rows.append(np.concatenate([flipped(shared, 1, np.arange(WIDTH)), r.integers(0, 2, bits - WIDTH)]))
    rows += [flipped(rows[-1], 55), flipped(rows[-2], 55)]
    fp = np.packbits(np.array(rows, np.uint8), axis=1, bitorder="little")
    label = families(fp, RADIUS)
    assert (label[[n, n + 1]] == 0).all() and (label[n + 2 : n + 45] != 0).all()
    assert (near(fp[n : n + 2, None], fp[None, :n]) <= RADIUS).sum() < 10
    sizes = np.bincount(label, minlength=len(fp))
    want = {(i, int(x)) for i, x in enumerate(label) if sizes[x] > 1}

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(fp)], "doc_id bigint, fp binary")
    before = shuffled()
    assert {(x.doc_id, x.group_id) for x in grouped(table).collect()} == want
    assert shuffled() - before < 2_500 * len(fp)
