import random
import re

import duckdb
import numpy as np
import pytest

from postlake.llm import line_dedup as ld

SCHEMA = "doc_id bigint, text string, line string, sig string"


def brute(docs, num=ld.NUM, den=ld.DEN):
    places = sorted({(d, i, tuple(sorted(set(re.findall(r"[^\W_]+", x.lower()))))) for d, t in docs for i, x in enumerate(t.split("\n"))})
    gone = set()
    for k, (d, i, s) in enumerate(places):
        for e, j, r in places[:k]:
            if s and r and (e, j) != (d, i):
                both = len(set(s) & set(r))
                if den * both >= num * (len(s) + len(r) - both):
                    gone.add((d, i))
                    break
    return gone


def corpus(seed, n=60, vocabulary=120):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.6)) for _ in range(vocabulary)]
    lines, docs = [], []
    for d in range(n):
        own = []
        for _ in range(r.randint(0, 6)):
            if lines and r.random() < 0.5:
                x = r.choice(lines).split()
                for _ in range(r.choice([0, 0, 1, 2, 5])):
                    if x:
                        x[r.randrange(len(x))] = r.choice(words)
                r.shuffle(x)
            else:
                x = [r.choice(words) for _ in range(r.randint(0, 40))]
            own.append(" ".join(x))
        lines += own
        docs.append((d, "\n".join(own)))
    return docs


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed,num,den", [(1, 4, 5), (2, 4, 5), (3, 1, 2), (4, 1, 1)])
def test_against_brute_force(spark, seed, num, den):
    docs = corpus(seed)
    got = {(r.doc_id, r.line) for r in ld.removed_lines(frame(spark, docs), num, den).collect()}
    assert got == brute(docs, num, den) and len(got) > 20


def test_against_sql(spark, tmp_path):
    docs = [*corpus(5), (100, "Élan Vital\nélan vital!"), (101, None), (None, "a b c")]
    frame(spark, docs).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = set(con.execute(ld.oracle()).fetchall())
    assert {tuple(r) for r in ld.removed_lines(frame(spark, docs)).collect()} == want and (100, 1) in want


def test_no_filter_loses_a_match():
    r = np.random.default_rng(0)
    for _ in range(20):
        sets = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(60)]
        rows = []
        for k, s in enumerate(sets):
            p = np.zeros(2, np.uint64)
            for t in s:
                p[int(t) % 2] ^= np.uint64(1) << np.uint64(t)
            rows += [(t, len(s), i, k, *p) for i, t in enumerate(s[: len(s) - -(-4 * len(s) // 5) + 1])]
        e = np.array(rows, ld._ENTRY)
        e = e[np.lexsort((e["pos"], e["n"], e["key"]))]
        i, j, _ = ld.candidates(e, 4, 5)
        got = set(zip(np.minimum(e["sig"][i], e["sig"][j]).tolist(), np.maximum(e["sig"][i], e["sig"][j]).tolist()))
        want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
        assert want <= got


def test_second_round_finds_what_the_likeliest_candidate_misses(spark):
    # b shares much with several; only one of them matches
    base = [f"t{k}" for k in range(20)]
    docs = [(0, " ".join(base[:15] + ["p", "q", "r", "s", "u"])), (1, " ".join(base[:17] + ["v", "w", "x"])), (2, " ".join(base)), (3, " ".join(base[:18] + ["y", "z"]))]
    got = {(r.doc_id, r.line) for r in ld.removed_lines(frame(spark, docs)).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    long = " ".join(f"word{k}" for k in range(60000))
    docs = [(1, None), (2, ""), (3, "\n\n"), (None, "same line here"), (4, "same line here\n--\nSame, LINE here"), (5, "--\nsame line here"), (5, "--\nsame line here"),
            (6, long), (7, long + " more"), (8, "alone\nsame line here")]
    df = frame(spark, docs)
    removed = ld.removed_lines(df)
    assert {(r.doc_id, r.line) for r in removed.collect()} == {(4, 2), (5, 1), (7, 0), (8, 1)}
    left = [tuple(r)[:2] for r in ld.without_lines(df, removed).collect()]
    want = [(1, None), (2, ""), (3, "\n\n"), (None, "same line here"), (4, "same line here\n--"), (5, "--"), (5, "--"), (6, long), (8, "alone")]
    assert sorted(left, key=str) == sorted(want, key=str)
    assert ld.without_lines(df, removed).columns == df.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert ld.removed_lines(empty).collect() == [] and ld.without_lines(empty, ld.removed_lines(empty)).collect() == []
