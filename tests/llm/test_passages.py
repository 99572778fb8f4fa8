import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm.passages import repeated_passages
from postlake.llm.suffixes import suffix_array

SCHEMA = "doc_id bigint, text string, first string, m bigint"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "abcab" * 500 + "x", "".join(chr(97 + bin(i).count("1") % 2) for i in range(4096))])
def test_suffix_array_of_repetitive_texts(text):
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array(np.frombuffer(text.encode(), np.uint8)).tolist() == want


def brute(rows, words):
    """(doc, first word, first or not) of the repeated windows."""
    where = defaultdict(list)
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t}):
        w = t.lower().split()
        for k in range(len(w) - words + 1):
            where[tuple(w[k : k + words])].append((d, k))
    return {(d, k, (d, k) == min(x)) for x in where.values() if len(x) > 1 for d, k in x}


def windows(df, words):
    return {(r.doc_id, k, r.first) for r in df.collect() for k in range(r.start_word, r.end_word - words + 1)}


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [[r.choice(vocabulary) for _ in range(r.randint(10, 60))] for _ in range(8)]
    rows = []
    for d in range(150):
        w = []
        for _ in range(r.randint(1, 4)):
            w += [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
            if r.random() < 0.5:
                p = r.choice(shared)
                a = r.randrange(len(p))
                w += p[a:] if r.random() < 0.5 else p
        rows.append((d, " ".join(w)))
    rows += [(200 + k, rows[k][1]) for k in range(20)]  # whole copies
    rows += [(300, "again and " * 60), (301, "same " * 90), (302, "again and " * 33 + "same " * 70)]
    df = spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA)
    for words, gram in ((12, 4), (20, 16)):
        want = brute(rows, words)
        assert len(want) > 500
        assert windows(repeated_passages(df, words, gram), words) == want


def test_spans_and_odd_rows(spark):
    p = [f"p{i}" for i in range(60)]
    text = lambda x: " ".join(x)
    rows = [(1, text(["a", *p, "b"]), "", 0), (2, text(["c", "d", *p]), "", 0), (2, text(["c", "d", *p]), "", 0), (3, text(p[:49]), "", 0), (4, None, "", 0), (5, "", "", 0),
            (None, text(p), "", 0), (6, text([f"q{i}" for i in range(30000)] + p), "", 0)]
    got = {tuple(r) for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, 61, True), (2, 2, 62, False), (6, 30000, 30060, False)}
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_short_periodic_texts(spark):
    """A sentence that is said again and again, alone in the corpus: its repeats lie within one short segment."""
    rows, r = [], random.Random(8)
    for d in (1, 3, 5, 10, 15, 34):
        for more in (0, 1, 7, 20, 35):
            k = len(rows)
            w = [f"t{k}x{i % d}" for i in range(50 + d + more)]
            around = [[f"t{k}{side}{i}" for i in range(r.choice([0, 60]))] for side in "ab"]
            rows.append((k, " ".join(around[0] + w + around[1])))
    rows += [(100 + k, t) for k, t in rows[::4]]
    got = windows(repeated_passages(spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA)), 50)
    assert got == brute(rows, 50)
