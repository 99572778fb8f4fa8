import random

import numpy as np

from postlake.llm.decontaminate import LEAST, RADIUS, Index, contaminated

DOCS = "doc_id bigint, text string, item_id string, similarity string"
ITEMS = "item_id bigint, text string, doc_id string"


def make(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(8, 40))) for i in range(25)]
    docs = []
    for d in range(120):
        w = text(r.randint(5, 120)).split()
        if d % 3 == 0:
            p = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                p[r.randrange(len(p))] = r.choice(vocabulary)
            k = r.randrange(len(w))
            w[k:k] = p
        docs.append((d, " ".join(w).upper() if d % 2 else ", ".join(w)))
    return docs, items


def brute(docs, items):
    def fingerprint(words):
        from postlake.llm import textvec as tv
        from postlake.llm.decontaminate import window_fingerprints

        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        h, *_ = tv.words(raw, np.array([0, len(raw)]))
        return int(window_fingerprints(h, np.array([0]), len(h))[0])

    def shingles(w):
        return {tuple(w[k : k + 3]): sum(map(len, w[k : k + 3])) for k in range(len(w) - 2)}

    out = {}
    for i, t in items:
        iw = t.lower().split()
        a, fa = shingles(iw), fingerprint(iw)
        for d, text in docs:
            dw = text.lower().replace(",", "").split()
            n = min(len(iw), len(dw))
            for k in range(len(dw) - n + 1):
                b = shingles(dw[k : k + n])
                both = sum(a[x] for x in a.keys() & b.keys())
                sim = both / (sum(a.values()) + sum(b.values()) - both) if b else 0
                if sim >= LEAST:
                    dist = (fa ^ fingerprint(dw[k : k + n])).bit_count()
                    if dist <= RADIUS:
                        out[d, i] = min(out.get((d, i), (9, 0)), (-round(sim, 6), k))
    return out


def test_against_brute_force(spark):
    docs, items = make()
    want = brute(docs, items)
    assert len(want) > 25
    for chunk in (10**9, 300):  # one pass, and many
        got = contaminated(spark.createDataFrame([(*x, "", "") for x in docs], DOCS), spark.createDataFrame([(*x, "") for x in items], ITEMS), chunk_chars=chunk)
        assert {(r.doc_id, r.item_id): (-r.similarity, r.start_word) for r in got.collect()} == want


def test_multi_index_finds_all_within_radius():
    r = random.Random(1)
    index = Index([(i, " ".join(str(r.random()) for _ in range(9))) for i in range(60)])
    fps = index.fps.copy()
    flips = [r.sample(range(64), RADIUS) for _ in fps]
    moved = np.array([int(f) ^ sum(1 << b for b in x) for f, x in zip(fps, flips)], np.uint64)
    w, i, d = index.near(moved)
    assert {(k, k) for k in range(len(fps))} <= set(zip(w.tolist(), i.tolist())) and d.max() <= RADIUS


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog"
    docs = [(1, None, "", ""), (2, "", "", ""), (None, item, "", ""), (3, item, "", ""), (3, item, "", ""), (4, "x " * 30000 + item, "", ""), (5, "brown fox", "", ""), (6, "quick brown fox jumps over the lazy", "", "")]
    items = [(7, item, ""), (7, item, ""), (8, item, ""), (9, None, ""), (10, "two words", ""), (None, item, "")]
    got = {(r.doc_id, r.item_id, r.start_word) for r in contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(d, i, s) for d, s in ((3, 0), (4, 30000), (6, 0)) for i in (7, 8)}
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contaminated(none[0], spark.createDataFrame(items, ITEMS)).collect() == []
    assert contaminated(spark.createDataFrame(docs, DOCS), none[1]).collect() == []
