"""Every stage of the pipeline against a brute-force version of it, on its own input."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import test_decontaminate
import test_line_dedup
import test_simhash_dups

import corpus_pipeline
from postlake.llm import mixing, quality
from postlake.llm import textvec as tv

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fixture(spark, folder):
    plain, items = test_decontaminate.make(7)
    docs = [(d, t, "en", "web" if d % 3 else "books", len(t)) for d, t in plain[:60]]
    # preferred documents of one vocabulary, rejected ones of another, and copies, near copies and odd rows
    docs += [(100 + i, " ".join(f"good{(i * k) % 37} calm words" for k in range(40)) + f"\nline {i} of its own", "en", "web", 0) for i in range(40)]
    docs += [(200 + i, " ".join(f"JUNK{(i * k) % 31} $$$ || buy" for k in range(40)), "en", "spam", 0) for i in range(40)]
    docs += [(300 + i, docs[60 + i][1], "en", "books", 0) for i in range(5)]
    docs += [(310 + i, " ".join([*docs[i][1].split()[:-1], "changed"]), "en", "books", 0) for i in range(10)]
    # near copies of which line dedup takes all but three lines; a very long text; a row that is repeated
    for i in range(6):
        words = [f"good{(i * 131 + k * 17) % 900} calm{i}" if k % 2 else f"words{k} {i}tail" for k in range(60)]
        lines = [words[k : k + 6] for k in range(0, 60, 6)]
        docs.append((320 + i, "\n".join(" ".join(x) for x in lines), "en", "web", 0))
        near = [[*x[:5], f"other{i} new{k}"] if k in (1, 4, 8) else x for k, x in enumerate(lines)]
        docs.append((340 + i, "\n".join(" ".join(x) for x in near), "en", "books", 0))
    docs += [(350, " ".join(f"good{k % 37} calm words long{k}" for k in range(15_000)), "en", "web", 0), docs[3]]
    docs += [(400, None, None, None, None), (401, "", "en", "web", 0), (None, "no id here", "en", "web", 0)]
    labels = [(d, 1, 0) for d in range(100, 140)] + [(d, 0, 0) for d in range(200, 240)] + [(d, 1, 0) for d in range(60)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    fixture(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    seen.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs)
    return folder, seen


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_order_and_columns(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing"]
    for df in staged[1][1:-1]:
        assert df.columns == staged[1][0].columns and df.dtypes == staged[1][0].dtypes


def test_quality(spark, staged):
    folder, seen = staged
    model = quality.train(seen[0], spark.read.parquet(f"{folder}/labels.parquet"))
    want = []
    for d, t in rows(seen[0]):
        s = model.scores(*tv.raw(pa.array([t or ""])))[0]
        if s >= model.threshold:
            want.append((d, t))
    got = rows(seen[1])
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = {d for d, _ in got}
    assert set(range(100, 140)) <= ids and not ids & set(range(200, 240))


def test_lines(staged):
    before, after = rows(staged[1][1]), rows(staged[1][2])
    gone = test_line_dedup.brute([(d, t) for d, t in before if d is not None and t is not None])
    want = []
    for d, t in before:
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if (d, k) not in gone]
        if len(left) == len(lines):
            want.append((d, t))
        elif "\n".join(left).strip():
            want.append((d, "\n".join(left)))
    assert sorted(after, key=str) == sorted(want, key=str) and gone


def test_copies(staged):
    before, after = rows(staged[1][2]), rows(staged[1][3])
    ids = {d for d, _ in before if d is not None}
    known = {(d, t) for d, t in [*before, *rows(staged[1][0])] if d in ids and t}
    # a document is held against the others as it is and as it was
    prints = {}
    for d, t in known:
        if (fp := test_simhash_dups.fingerprint(t)) is not None:
            prints.setdefault(fp, set()).add(d)
    group = {min(x): min(x) for x in prints.values()}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    linked = {min(x) for x in prints.values() if len(x) > 1}
    for a, x in prints.items():
        for b, y in prints.items():
            if (a ^ b).bit_count() <= test_simhash_dups.RADIUS and min(x) != min(y):
                linked |= {min(x), min(y)}
                p, q = sorted((top(min(x)), top(min(y))))
                group[q] = p
    drop = {d for x in prints.values() if min(x) in linked for d in x if top(min(x)) < d}
    assert sorted(after, key=str) == sorted([r for r in before if r[0] not in drop], key=str) and drop
    # no near copy goes on as what line dedup left of it
    assert set(range(320, 326)) <= {d for d, _ in after} and not set(range(340, 346)) & {d for d, _ in after}
    assert set(range(340, 346)) <= ids


def test_contamination(spark, staged):
    folder, seen = staged
    before, after = rows(seen[3]), rows(seen[4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    plain = [(d, t.replace("\n", " ")) for d, t in before if d is not None and t]
    hit = {d for d, _ in test_decontaminate.brute(plain, items)}
    assert sorted(after, key=str) == sorted([r for r in before if r[0] not in hit], key=str) and hit


def test_mixing(spark, staged):
    folder, seen = staged
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/3/*.parquet'")
    want = sorted(con.execute(mixing.oracle()).fetchall(), key=str)
    assert sorted([tuple(r) for r in seen[5].collect()], key=str) == want
    assert sorted([tuple(r) for r in corpus_pipeline.run(spark, folder).collect()], key=str) == want


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_further_columns_with_clashing_names(spark, staged):
    folder, seen = staged
    names = ["score", "kept", "line", "sig", "group_id", "component", "item_id", "block", "shard", "k", "a b"]
    extra = seen[0]
    for n in names:
        extra = extra.withColumn(n, extra["doc_id"])
    docs = extra
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            docs.write.parquet(f"{folder}/x{k}")
            docs = spark.read.parquet(f"{folder}/x{k}")
            assert docs.columns == extra.columns
            assert sorted(map(str, rows(docs))) == sorted(map(str, rows(seen[k + 1])))
            assert docs.where("not (score <=> doc_id)").count() == 0
    assert sorted([tuple(r) for r in docs.collect()], key=str) == sorted([tuple(r) for r in seen[5].collect()], key=str)
